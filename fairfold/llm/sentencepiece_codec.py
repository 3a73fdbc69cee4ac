"""Subword encoding as a relational lattice over an existing piece vocabulary, and decoding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairfold.llm.pieces import MODEL, SPACE, Vocabulary, decoded, lattices, load, ranks
from fairfold.llm.text import plain_text, rows_of, run_id, shuffle_partitions, stored

CHUNK = 2_000_000  # words a task packs at a time
UNSPELT = 1 << 23  # marks the code of a character without a piece
LONG_WORD = 100  # characters; longer words are folded outside the expression, whose states grow with the word

_PACKED = "key long, chunk long, a binary, b binary, c binary"


def word_pattern(vocabulary: Vocabulary) -> str:
    """Words no piece reaches across: the best segmentation of a text is that of its words.

    The pieces themselves say where a text may be cut: before a space that follows anything else, and
    around line feeds and between letters and other characters if no piece spans these.
    """
    held = [t for n in vocabulary.hashes for t in (vocabulary.text[i] for i in vocabulary.hashes[n][1].tolist())]
    if any(SPACE in t.lstrip(SPACE) for t in held):
        raise ValueError("a piece holds a space after another character")
    apart = not any(a.isalpha() != b.isalpha() for t in held for a, b in zip(t.lstrip(SPACE), t.lstrip(SPACE)[1:], strict=False))
    lines = not any("\n" in t and t != "\n" for t in held)
    feed, other = ("\n|", "\n") if lines else ("", "")
    if apart:
        return rf"{feed}{SPACE}*(?:[^\W\d_]+|(?:[\d_]|[^\w{SPACE}{other}])+)|{SPACE}+"
    return rf"{feed}{SPACE}*[^{SPACE}{other}]+|{SPACE}+"


def _planes(numbers: np.ndarray) -> bytes:
    """Integers below 2^24 as three compressed byte planes."""
    return b"".join(len(z).to_bytes(4, "little") + z for z in (zlib.compress((numbers >> s).astype(np.uint8).tobytes(), 1) for s in (0, 8, 16)))


def _from_planes(packed: bytes) -> np.ndarray:
    out, at = 0, 0
    for shift in (0, 8, 16):
        n = int.from_bytes(packed[at : at + 4], "little")
        out = out + (np.frombuffer(zlib.decompress(packed[at + 4 : at + 4 + n]), np.uint8).astype(np.int64) << shift)
        at += 4 + n
    return out


def _pack(pattern: str, buckets: int):
    """A run of documents as its distinct words, dealt to hash buckets, and word numbers for each document."""

    def pack(batches: Iterable[pa.RecordBatch]):
        split = re.compile(pattern).findall
        ids: list = []
        marks: list[int] = []
        parts: list[np.ndarray] = []
        numbers: dict[str, int] = {}
        size = number = 0

        def flush(number):
            words = list(numbers)
            flat = np.concatenate(parts)
            # frequent words get small numbers
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            home = np.fromiter((xxhash.xxh64_intdigest(words[i]) % buckets for i in order.tolist()), np.int64, len(words))
            lengths = np.array([len(p) for p in parts], np.int64)
            nulls = np.array([i is None for i in ids], bool)
            head = nulls.tobytes() + np.array([0 if i is None else i for i in ids], np.int64).tobytes() + np.array(marks, np.uint64).tobytes() + lengths.tobytes()
            body = _planes(rank[flat])
            chunk = run_id(number, head + body)
            rows = [(-1 - chunk % buckets, chunk, head, body, home.astype(np.uint16).tobytes())]
            by: dict[int, list[str]] = {}
            for i, b in zip(order.tolist(), home.tolist(), strict=True):
                by.setdefault(b, []).append(words[i])
            rows += [(b, chunk, _packed_words(own), b"", b"") for b, own in by.items()]
            for x in (ids, marks, parts, numbers):
                x.clear()
            return _rows(rows)

        for doc_id, text in rows_of(batches):
            whole = SPACE + text.decode("utf-8", "replace").replace(" ", SPACE) if text else ""
            ids.append(doc_id)
            marks.append(xxhash.xxh64_intdigest(text))
            parts.append(np.array([numbers.setdefault(w, len(numbers)) for w in split(whole)], np.int64))
            size += len(parts[-1])
            if size >= CHUNK or len(numbers) > 8_000_000:
                yield flush(number)
                number += 1
                size = 0
        if ids:
            yield flush(number)

    return pack


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())] + [pa.array([r[j] for r in rows], pa.binary()) for j in (2, 3, 4)],
        ["key", "chunk", "a", "b", "c"],
    )


def _packed_words(words: list[str]) -> bytes:
    """Their number, their lengths in characters and themselves one behind the other: no character is needed to part them."""
    lengths = np.array([len(w) for w in words], "<u4").tobytes()
    return zlib.compress(len(words).to_bytes(4, "little") + lengths + "".join(words).encode(), 1)


def _words_of(packed: bytes) -> list[str]:
    held = zlib.decompress(packed)
    n = int.from_bytes(held[:4], "little")
    ends = np.cumsum(np.frombuffer(held, "<u4", n, 4)).tolist()
    text = held[4 + 4 * n :].decode()
    return [text[b:e] for b, e in zip([0, *ends[:-1]], ends, strict=True)]


def _distinct(table: pa.Table) -> pa.Table:
    words: dict[str, None] = {}
    for packed in table["a"].to_pylist():
        words.update(dict.fromkeys(_words_of(packed)))
    return pa.table([pa.array([table["key"][0].as_py()] * len(words), pa.int64()), pa.array(list(words), pa.string())], ["key", "word"])


def piece_weights(vocabulary: Vocabulary) -> np.ndarray:
    """Log weights by the rank of the vocabulary's scores; bytes, which have none, weigh least."""
    rank, log_total = ranks(vocabulary)
    out = -np.log(rank + 10.0) - log_total
    out[vocabulary.byte] = out.min()
    return out


def best_path(vocabulary: Vocabulary, logp: np.ndarray, word: str) -> list[int]:
    """The heaviest segmentation of one word; ties go to the longer last piece."""
    _, lattice = next(lattices(vocabulary, [word], 1, mark=""))
    weights = lattice.weights(logp)
    best, back = [0.0], [(0, [0])]
    for j in range(1, len(word) + 1):
        options = [(best[j - n] + float(weights[n][0, j - n]), n) for n in sorted(weights, reverse=True) if n <= j and np.isfinite(weights[n][0, j - n])]
        score, n = max(options, key=lambda o: (o[0], o[1]))
        piece = int(lattice.edges[n][0, j - n])
        best.append(score)
        back.append((j - n, [piece] if piece >= 0 else lattice.bytes_of(ord(word[j - 1])).tolist()))
    out: list[int] = []
    while j:
        j, ids = back[j]
        out = ids + out
    return out


def encode_words(words: DataFrame, vocabulary: Vocabulary, pieces) -> DataFrame:
    """``key, word, ids``: the heaviest segmentation of each distinct word of up to LONG_WORD characters.

    Every substring up to the longest piece's length is exploded and equi-joined to the piece table, which
    is as large as the given vocabulary and broadcast.  The words are hash-partitioned before, so the edges
    of a word meet again without an exchange; the Viterbi recursion folds over them in order of their ends,
    and a second fold walks back.
    """
    spark = words.sparkSession
    logp = piece_weights(vocabulary)
    rank, log_total = ranks(vocabulary)
    table = spark.createDataFrame(
        [(vocabulary.text[i], int(rank[i]) << 24 | i) for n in vocabulary.hashes for i in vocabulary.hashes[n][1].tolist()], "piece string, code long"
    )
    most = max(vocabulary.hashes)
    length = F.char_length("word")
    spread = words.where(length <= LONG_WORD).repartition(4 * shuffle_partitions(spark), "word")
    starts = spread.select("key", "word", F.explode(F.sequence(F.lit(1), length)).alias("start"))
    spans = starts.select("key", "word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), length - F.col("start") + 1))).alias("size"))
    edges = spans.withColumn("piece", F.substring(F.col("word"), F.col("start"), F.col("size"))).join(F.broadcast(table), "piece", "left")
    # an edge is one number: end, begin, rank of the piece, piece; sorted, they come in order of their ends.
    # A character without a piece is spelt by its bytes: their number stands for the rank, its code for the piece
    spelt = F.shiftleft(F.octet_length("piece").cast("long"), 24) + UNSPELT + F.ascii("piece")
    begin = F.shiftleft((F.col("start") - 1).cast("long"), 42)
    end = F.shiftleft((F.col("start") + F.col("size") - 1).cast("long"), 50)
    edges = edges.where("code is not null or size = 1").select("key", "word", (end + begin + F.coalesce("code", spelt)).alias("edge"))
    lattice = edges.groupBy("key", "word").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    low = (1 << 24) - 1

    def step(s, e):
        place, found = F.shiftright(e, 24).bitwiseAND((1 << 18) - 1), e.bitwiseAND(low)
        weight = F.when(found >= UNSPELT, place * float(logp[vocabulary.byte[0]])).otherwise(-F.log(place + F.lit(10.0)) - log_total)
        score = F.element_at(s["best"], F.shiftright(e, 42).bitwiseAND(255).cast("int") + 1) + weight
        own = e.bitwiseAND((1 << 50) - 1)
        n = F.size(s["best"])
        added = F.struct(F.array_append(s["best"], score).alias("best"), F.array_append(s["back"], own).alias("back"))
        better = F.struct(F.array_append(F.slice(s["best"], 1, n - 1), score).alias("best"), F.array_append(F.slice(s["back"], 1, n - 1), own).alias("back"))
        return F.when(n == F.shiftright(e, 50), added).when(score > F.element_at(s["best"], -1), better).otherwise(s)

    start = F.struct(F.array(F.lit(0.0)).alias("best"), F.array(F.lit(0).cast("long")).alias("back"))
    lattice = lattice.select("key", "word", F.aggregate("edges", start, step, lambda s: s["back"]).alias("back"))
    walked = F.aggregate(
        F.reverse("back"), F.struct(F.size("back").alias("at"), (F.size("back") - 1).alias("end"), F.array().cast("array<int>").alias("ids")),
        lambda s, b: F.when(
            (s["at"] - 1 == s["end"]) & (s["end"] > 0),
            F.struct((s["at"] - 1).alias("at"), F.shiftright(b, 42).cast("int").alias("end"), F.array_prepend(s["ids"], b.bitwiseAND(low).cast("int")).alias("ids")),
        ).otherwise(F.struct((s["at"] - 1).alias("at"), s["end"].alias("end"), s["ids"].alias("ids"))),
        lambda s: s["ids"],
    )
    # still unspelt: -1 less the character's code
    short = lattice.select("key", "word", F.transform(walked, lambda i: F.when(i >= UNSPELT, UNSPELT - i - 1).otherwise(i)).alias("ids"))
    sent = spark.sparkContext.broadcast(logp)

    def fold(batches: Iterable[pa.RecordBatch]):
        held = Vocabulary(*pieces.value)
        for batch in batches:
            ids = [best_path(held, sent.value, w) for w in batch["word"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["word"], pa.array(ids, pa.list_(pa.int32()))], ["key", "word", "ids"])

    long = words.where(length > LONG_WORD).mapInArrow(fold, "key long, word string, ids array<int>")
    return short.unionByName(long)


def _answer(pieces):
    """In one bucket: the pieces of each run's words, in the order in which the run lists them."""

    def answer(packed: pa.Table, encoded: pa.Table) -> pa.Table:
        vocabulary = Vocabulary(*pieces.value)
        byte, narrow = vocabulary.byte, len(vocabulary.text) <= 1 << 16
        codes = dict(zip(encoded["word"].to_pylist(), encoded["ids"].to_pylist(), strict=True))
        for word, ids in codes.items():
            if min(ids) < 0:  # a character without a piece
                codes[word] = [x for i in ids for x in ([i] if i >= 0 else byte[list(chr(-i - 1).encode("utf-8", "replace"))].tolist())]
        out = []
        for key, chunk, a in zip(*(packed[n].to_pylist() for n in ("key", "chunk", "a")), strict=True):
            own = [codes[w] for w in _words_of(a)]
            sizes = np.array([len(x) for x in own], np.int32).tobytes()
            out.append((key, chunk, b"", zlib.compress(sizes, 1), zlib.compress(np.array([i for x in own for i in x], np.uint16 if narrow else np.int32).tobytes(), 1)))
        return pa.Table.from_batches([_rows(out)])

    return answer


def _assemble(pieces):
    """A run's documents: the pieces of their words in order, decoded again and compared with the text."""

    def assemble(table: pa.Table) -> pa.Table:
        vocabulary = Vocabulary(*pieces.value)
        byte_of = {int(i): b for b, i in enumerate(vocabulary.byte.tolist()) if i != vocabulary.unknown}
        key, a, b, c = (table[n].to_pylist() for n in ("key", "a", "b", "c"))
        at = next(i for i, x in enumerate(a) if x)
        docs = len(a[at]) // 25
        nulls = np.frombuffer(a[at], bool, docs)
        ids, marks, lengths = (np.frombuffer(a[at], kind, docs, offset=docs + 8 * docs * j) for j, kind in enumerate((np.int64, np.uint64, np.int64)))
        home, ranks = np.frombuffer(c[at], np.uint16), _from_planes(b[at])
        sizes, starts, flat, held = np.zeros(len(home), np.int64), np.zeros(len(home), np.int64), [], 0
        for i in range(len(key)):
            if i != at:
                own = np.frombuffer(zlib.decompress(b[i]), np.int32)
                mine = np.flatnonzero(home == key[i])
                sizes[mine] = own
                starts[mine] = held + np.concatenate(([0], np.cumsum(own[:-1])))
                flat.append(np.frombuffer(zlib.decompress(c[i]), np.uint16 if len(vocabulary.text) <= 1 << 16 else np.int32))
                held += len(flat[-1])
        flat = np.concatenate(flat) if flat else np.empty(0, np.int32)
        edges = np.concatenate(([0], np.cumsum(lengths)))
        good, codes = [], []
        for d in range(docs):
            own = ranks[edges[d] : edges[d + 1]]
            n = sizes[own]
            where = np.repeat(starts[own] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(own) else np.empty(0, np.int64)
            codes.append(flat[where])
            good.append(xxhash.xxh64_intdigest(decoded(vocabulary.text, byte_of, codes[-1].tolist()).encode("utf-8", "replace")) == int(marks[d]))
        counts = np.array([len(x) for x in codes], np.int64)
        return pa.table(
            [
                pa.array([None if z else i for z, i in zip(nulls.tolist(), ids.tolist(), strict=True)], pa.int64()), pa.array(counts),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(np.concatenate(codes), pa.int32())), pa.array(good),
            ],
            ["doc_id", "n_pieces", "ids", "round_trip"],
        )

    return assemble


def encode_texts(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """One row per document: doc_id, n_pieces, ids, round_trip.

    A text is encoded as the segmentation of greatest weight over the pieces of ``model_file``, whose own
    scores rank the weights; a space goes before the text and spaces are written as ``SPACE``.
    ``round_trip`` says that decoding ``ids`` gives the text again; it is false only for texts that
    hold the space sign itself.  NULL and empty texts have no pieces.  Repeated rows are encoded each; a
    NULL doc_id stays NULL.  An empty table gives an empty result; further columns are ignored.

    Only distinct words go through the lattice.  Runs of documents are packed as word numbers, their
    words meet the encoded ones bucket by bucket, and each run is put together again by itself.
    """
    spark = docs.sparkSession
    vocabulary = load(model_file)
    pieces = spark.sparkContext.broadcast(tuple(vars(vocabulary).values()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    buckets = min(60_000, max(16, 2 * shuffle_partitions(spark)))
    packed = stored(texts.mapInArrow(_pack(word_pattern(vocabulary), buckets), _PACKED))
    runs, dealt = packed.where("key < 0"), packed.where("key >= 0")
    words = dealt.select("key", "a").groupBy("key").applyInArrow(_distinct, "key long, word string")
    encoded = stored(encode_words(words, vocabulary, pieces))
    answers = dealt.groupBy("key").cogroup(encoded.groupBy("key")).applyInArrow(_answer(pieces), _PACKED)
    return runs.unionByName(answers).groupBy("chunk").applyInArrow(_assemble(pieces), "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def decode_ids(encoded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """``doc_id, text`` of encoded documents (doc_id, ids)."""
    vocabulary = load(model_file)
    pieces = encoded.sparkSession.sparkContext.broadcast((vocabulary.text, {int(i): b for b, i in enumerate(vocabulary.byte.tolist()) if i != vocabulary.unknown}))

    def decode(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            text = [None if x is None else decoded(*pieces.value, x) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(decode, "doc_id long, text string")
