"""Packing of tokenised documents into sequences: a cutting-stock program over length-histogram patterns, solved by column generation."""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairfold.llm.text import matching, plain_text, rows_of, stored

CAPACITY = 1024
TOKENIZER = "byte_bpe_50k.json"
END = 0  # the id behind every document
PIVOTS = 250  # columns that may enter the linear programs of a plan; what they leave over is cut, not dropped
PADDING = 1e-4  # share of padding at which a linear program is good enough
ROUNDS = 8  # linear programs over what rounding left of the one before
KNOWN = 400_000  # pieces of text whose ids a task remembers at a time
LONGEST = 48  # bytes of a piece worth remembering
PIECES = "part long, length long, nth long, doc_id long, start long, doc_tokens long, ids binary"
_ARROW = pa.schema([
    ("part", pa.int64()), ("length", pa.int64()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()),
])
# characters that every version of Unicode classifies alike: texts of these alone may take the faster engine
_COMMON = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xCA)])
# a byte-level pre-tokenizer always cuts before a space that something visible follows; the lead bytes left out begin the white space beyond ASCII
_CUT = re.compile(rb"(?= [!-~\xC3-\xE0\xE4-\xF4])")


def _engine(told: dict):
    """The merges of a tokenizer's file as ranks for ``tiktoken``, which gives the same ids in a third of the time; None for another kind of tokenizer.

    That holds for a byte-level BPE with the usual pattern whose merges have their ids in order, as the rank of a merge is then its id.
    """
    import public_tokenizers
    import tiktoken

    step = told["pre_tokenizer"] or {}
    plain = step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space") and told["normalizer"] is None
    model = told["model"]
    if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    vocabulary = model["vocab"]
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if len(vocabulary) != 256 + len(merged) or any(vocabulary[a + b] != 256 + k for k, (a, b) in enumerate(merged)):
        return None
    # the visible characters that stand for bytes: printable ones for themselves, the others from U+0100 on
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items()}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts; what the faster engine may not take goes piece by piece: equal pieces of a batch, and those seen before, are encoded once."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.special = [t["content"].encode() for t in told["added_tokens"]]
        self.fast = _engine(told)
        self.known: dict[bytes, bytes] = {}

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def bytes(self) -> np.ndarray:
        """A byte-level token has a character for each byte."""
        vocabulary = self.tokenizer.get_vocab()
        out = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            out[i] = len(token)
        return out

    def _alone(self, pieces: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _joined(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces that begin at a cut are encoded one behind the other, and told apart by the bytes that their ids stand for."""
        out = []
        for lo in range(0, len(pieces), 30_000):
            some = pieces[lo : lo + 30_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([*map(len, some)])) + 1)
            held, begins = ids.tobytes(), [0, *ends[:-1].tolist()]
            out += [held[b:e] for b, e in zip(begins, ends.tolist(), strict=True)]
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        quick = [self.fast is not None and not t.translate(None, _COMMON) and not any(s in t for s in self.special) for t in texts]
        others = iter(self.by_pieces([t for t, q in zip(texts, quick, strict=True) if not q]))
        return [self.fast.encode_to_numpy(t.decode(), disallowed_special=()).astype("<u4").tobytes() if q else next(others) for t, q in zip(texts, quick, strict=True)]

    def by_pieces(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        # a special token takes the white space beside it out of the cutting rule
        cut = [[t] if any(s in t for s in self.special) else _CUT.split(t) for t in texts]
        begins = list({pieces[0] for pieces in cut}.difference(known))
        others = list(set().union(*(pieces[1:] for pieces in cut)).difference(known))
        known.update(zip(begins, self._alone(begins), strict=True))
        known.update(zip(others, self._joined(others), strict=True))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        for p in (*begins, *others):
            if len(p) > LONGEST:
                del known[p]
        return out


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Whole sequences cut from the front of every document, and what is left of it, each with its number ``nth`` among the task's pieces of its length."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, nth, part = Encoder(path), Counter(), TaskContext.get().partitionId()

        def answer(waiting):
            out = []
            for (doc_id, _), ids in zip(waiting, encode([t for _, t in waiting]), strict=True):
                ids += END.to_bytes(4, "little")
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    out.append((part, length, nth[length], doc_id, start, n, ids[4 * start : 4 * (start + length)]))
                    nth[length] += 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

        waiting, size = [], 0
        for row in rows_of(batches):
            waiting.append(row)
            size += len(row[1]) + 50
            if size >= 1 << 20:
                yield answer(waiting)
                waiting, size = [], 0
        if waiting:
            yield answer(waiting)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text")).mapInArrow(task, PIECES)


class Pattern(NamedTuple):
    counts: dict[int, int]  # pieces by length
    times: float


def _cost(capacity: int) -> np.ndarray:
    """Places that a sequence of each length takes: a power of two needs no padding."""
    size = np.arange(capacity + 1)
    return np.where(size & (size - 1) == 0, size, capacity).astype(float)


def _knapsack(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest value of pieces that fill each size exactly, and the last piece used; ``value`` is by length, -inf where there is none."""
    best, last = np.full(len(value), -np.inf), np.zeros(len(value), np.int64)
    best[0] = 0.0
    back = np.full(len(value), -np.inf)  # best, last size first, so that both operands are slices
    back[-1] = 0.0
    for c in range(1, len(value)):
        sums = value[1 : c + 1] + back[len(value) - c :]
        k = sums.argmax()
        best[c] = back[len(value) - 1 - c] = sums[k]
        last[c] = k + 1
    return best, last


def _reachable(lengths: list[int], capacity: int) -> int:
    """Bit n is set if pieces of the lengths can fill n exactly."""
    bits, every = 1, (1 << capacity + 1) - 1
    for n in lengths:
        step = n
        while step <= capacity:
            bits |= bits << step & every
            step *= 2
    return bits


def _fill(first: int, lengths: list[int], bits: int, cost: np.ndarray, capacity: int) -> Counter | None:
    """A pattern with a piece of length ``first`` that is not padded, if there is one: the largest sizes, then the largest pieces."""
    held = set(lengths)
    for size in range(capacity, first - 1, -1):
        if cost[size] > size or not bits >> (size - first) & 1:
            continue
        counts, rest = Counter([first]), size - first
        while rest:
            n = next((n for n in range(rest, 0, -1) if n in held and bits >> (rest - n) & 1), None)
            if n is None:
                return None  # the bits are older than the lengths
            counts[n] += 1
            rest -= n
        return counts
    return Counter([first])


def _first_patterns(demand: dict[int, int], cost: np.ndarray, capacity: int) -> list[tuple[Counter, float, int]]:
    """Patterns from the longest pieces down, each used until one length is used up: pattern, times, that length.

    A pattern holds none of the lengths used up before, so the patterns are a triangular basis.
    """
    left, out = dict(demand), []
    bits = _reachable(list(left), capacity)
    while left:
        first = max(left)
        counts = _fill(first, list(left), bits, cost, capacity)
        if counts is None or sum(counts) == first and len(counts) == 1 and cost[first] > first:
            bits = _reachable(list(left), capacity)
            counts = _fill(first, list(left), bits, cost, capacity)
        if any(n not in left for n in counts):
            raise AssertionError("a pattern needs a length that is used up")
        gone = min(counts, key=lambda n: left[n] / counts[n])
        times = left[gone] / counts[gone]
        out.append((counts, times, gone))
        for n, k in counts.items():
            left[n] -= times * k
        del left[gone]
        left = {n: max(k, 0.0) for n, k in left.items()}
    return out


def patterns(demand: dict[int, int], capacity: int = CAPACITY, pivots: int = PIVOTS) -> tuple[list[Pattern], int]:
    """Patterns and how often (a fraction) to use each, so that all pieces of ``demand`` are placed with the least padding; and the pivots left.

    The linear program has one row per length and starts with the patterns of ``_first_patterns``.  Its dual prices
    value the lengths, the knapsack over all sizes finds the pattern that saves most at these prices, and
    that column enters, until none saves anything or less than ``PADDING`` of the places are padding.
    """
    lengths = sorted(demand)
    if not lengths:
        return [], pivots
    cost, row = _cost(capacity), {n: i for i, n in enumerate(lengths)}
    times, prices, inverse = np.zeros(len(lengths)), np.zeros(len(lengths)), np.zeros((len(lengths), len(lengths)))
    columns: list[Counter] = [Counter()] * len(lengths)
    start = _first_patterns(demand, cost, capacity)
    for n in lengths:
        inverse[row[n], row[n]] = 1.0
    for counts, used, gone in start:  # a triangular basis: each length's row is ready when its own pattern comes
        at = row[gone]
        inverse[at] /= counts[gone]
        for n, k in counts.items():
            if n != gone:
                inverse[row[n]] -= k * inverse[at]
        columns[at], times[at], prices[at] = counts, used, cost[sum(n * k for n, k in counts.items())]
    least = float(sum(n * k for n, k in demand.items()))
    # few elements of a column are not zero; plain sums, as threads of a linear algebra library do not get on with a driver
    while pivots and (prices * times).sum() > least * (1 + PADDING):
        pivots -= 1
        value = np.full(capacity + 1, -np.inf)
        value[lengths] = np.einsum("i,ij->j", prices, inverse)
        best, last = _knapsack(value)
        saved = best[1:] - cost[1:]
        size = int(saved.argmax()) + 1
        if saved[size - 1] <= 1e-6:
            break
        price, counts = cost[size], Counter()
        while size:
            counts[int(last[size])] += 1
            size -= int(last[size])
        change = sum(k * inverse[:, row[n]] for n, k in counts.items())
        ratio = np.where(change > 1e-9, times / np.where(change > 1e-9, change, 1.0), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        pivot, by = inverse[out] / change[out], ratio[out]
        some = np.flatnonzero(change)
        inverse[some] -= change[some, None] * pivot
        inverse[out] = pivot
        times = np.maximum(times - by * change, 0.0)
        times[out], prices[out], columns[out] = by, price, counts
    return [Pattern(c, float(t)) for c, t in zip(columns, times, strict=True) if t > 0], pivots


class Plan(NamedTuple):
    ranges: list[tuple]  # length, from rank, to rank, pieces of it in a sequence, first sequence, offset, and place in the stream or None
    full: int  # whole sequences of the stream
    first: int  # the stream's first sequence
    tail: list[tuple[int, int, int]]  # sequence, begin and end in the stream of each power of two behind them


def plan(demand: dict[int, int], capacity: int = CAPACITY, pivots: int = PIVOTS) -> Plan:
    """Whole numbers of patterns without padding, as ranges of ranks within each length; the rest is one stream, cut into whole sequences.

    Fractions are rounded down; then patterns, the largest fraction first, are used once more while enough
    pieces are left; then the same again with what is left.  Pieces that no pattern without padding takes lie one behind the other in the stream; what is
    left of it at the end becomes sequences whose lengths are powers of two, which need no padding.
    """
    left, used = dict(demand), {n: 0 for n in demand}
    ranges: list[tuple] = []
    sequence = 0

    def use(counts: dict[int, int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for n, k in sorted(counts.items(), reverse=True):
            ranges.append((n, used[n], used[n] + times * k, k, sequence, offset, None))
            used[n] += times * k
            left[n] -= times * k
            offset += n * k
        sequence += times

    cost = _cost(capacity)
    if demand.get(capacity):
        use({capacity: 1}, demand[capacity])
    for _ in range(ROUNDS):
        before = sequence
        found, pivots = patterns({n: k for n, k in left.items() if k}, capacity, pivots)
        found = [p for p in found if cost[size := sum(n * k for n, k in p.counts.items())] == size]
        for p in found:
            if times := min(int(p.times + 1e-6), *(left[n] // k for n, k in p.counts.items())):
                use(p.counts, times)
        for p in sorted(found, key=lambda p: int(p.times + 1e-6) - p.times):
            if all(left[n] >= k for n, k in p.counts.items()):
                use(p.counts, 1)
        if sequence == before:
            break
    place = 0
    for n in sorted(left, reverse=True):
        if left[n]:
            ranges.append((n, used[n], demand[n], 1, sequence, 0, place))
            place += n * left[n]
    full, rest = divmod(place, capacity)
    tail, begin = [], full * capacity
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            tail.append((sequence + full + len(tail), begin, begin + (1 << bit)))
            begin += 1 << bit
    return Plan(ranges, full, sequence, tail)


def _of_stream(place: Column, length: Column, made: Plan, capacity: int) -> Column:
    """The pieces of a stretch of the stream: sequence, offset, cut (from where in the stretch) and n."""

    def part(sequence: Column, begin: Column, end: Column) -> Column:
        lo, hi = F.greatest(place, begin), F.least(place + length, end)
        return F.struct(sequence.cast("long").alias("sequence_id"), (lo - begin).cast("long").alias("offset"), (lo - place).cast("long").alias("cut"), (hi - lo).cast("long").alias("n"))

    k = F.floor(place / capacity).cast("long")
    whole = [F.when(k + i < made.full, part(made.first + k + i, (k + i) * capacity, (k + i + 1) * capacity)) for i in (0, 1)]
    ends = [part(F.lit(s), F.lit(b), F.lit(e)) for s, b, e in made.tail]
    return F.filter(F.array(*whole, *ends), lambda p: p["n"] > 0)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, pivots: int = PIVOTS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document is the ids of its text by the tokenizer file at ``path`` (without special ones added; those that
    stand in the text count as such) and the id 0.  Sequences hold up to ``capacity`` ids; one that is shorter is
    padded unless its length is a power of two.  Documents give whole sequences first; the lengths of what is
    left of them are packed by ``patterns``, and pieces go to places by their rank within their length.  ``ids``
    are little-endian 32-bit numbers, ``start`` is the piece's first id within the document, ``offset`` within
    the sequence; the pieces of a sequence fill it from 0 without a gap, and no sequence is padded.

    A NULL text is empty, so that its document is the id 0 alone; a NULL doc_id is an id like any other.
    Repeated rows are documents of their own.  Texts of any length are read whole.  An empty table gives an
    empty result, further columns are ignored.

    The driver gets one count per length (at most ``capacity``), however many documents there are, and gives back
    ranges of ranks.  A rank is the piece's number in its task plus the pieces of that length in earlier tasks; ids
    are written once and move no more unless those counts are too many to broadcast.
    """
    spark = docs.sparkSession
    pieces = stored(tokenised(docs, path, capacity), compression="zstd")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    made = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity, pivots)
    schema = "for_length long, lo long, hi long, per long, first long, base long, place long"
    ranges = spark.createDataFrame(made.ranges, schema)  # at most two for each length of each of ``capacity`` patterns
    ranked = matching(pieces, counts.drop("n"), ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before"))
    on = (F.col("length") == F.col("for_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    k = F.col("rank") - F.col("lo")
    one = F.array(F.struct(
        (F.col("first") + F.floor(k / F.col("per"))).cast("long").alias("sequence_id"), (F.col("base") + k % F.col("per") * F.col("length")).alias("offset"),
        F.lit(0).cast("long").alias("cut"), F.col("length").alias("n"),
    ))
    several = _of_stream(F.col("place") + k * F.col("length"), F.col("length"), made, capacity)
    found = ranked.join(F.broadcast(ranges), on).withColumn("p", F.explode(F.when(F.col("place").isNull(), one).otherwise(several)))
    ids = F.when(F.col("p.n") == F.col("length"), F.col("ids")).otherwise(F.substring("ids", (F.col("p.cut") * 4 + 1).cast("int"), (F.col("p.n") * 4).cast("int")))
    return found.select("doc_id", (F.col("start") + F.col("p.cut")).alias("start"), F.col("p.n").alias("length"), ids.alias("ids"), "doc_tokens", "p.sequence_id", "p.offset")
