"""Language-model scores: marginal text probability over all subword segmentations."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairfold.llm.pieces import MODEL, Vocabulary, lattices, load, prior
from fairfold.llm.text import plain_text, rows_of, run_id, shuffle_partitions, space_words, stored

CHUNK = 2_000_000  # words a task packs at a time
ROUNDS = 2  # expectation-maximisation rounds for the piece weights
CLASSES = 15  # values of the class column with word counts of their own; all others share one more
NOBODY = 255  # class of documents that teach nothing
CONCENTRATION = 4000.0  # how closely the words of one text keep to the corpus; smaller: burstier

_PACKED = "key long, chunk long, a binary, b binary, c binary, d binary"
_SCORED = "doc_id long, n_words long, n_known long, base double, model double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _learns(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


def _pack(buckets: int):
    """Deal the distinct words of a run of documents out to hash buckets, with who holds them how often."""

    def pack(batches: Iterable[pa.RecordBatch]):
        ids: list = []
        parts: list[np.ndarray] = []
        classes: list[int] = []
        numbers: dict[bytes, int] = {}
        size = number = 0

        def flush(number):
            n = np.array([len(p) for p in parts], np.int64)
            doc = np.repeat(np.arange(len(parts), dtype=np.int64), n)
            pair = np.concatenate(parts) + doc * len(numbers)
            pair, times = np.unique(pair, return_counts=True)
            doc, word = np.divmod(pair, max(1, len(numbers)))
            words = list(numbers)
            home = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(buckets)
            known = np.array([0 if i is None else i for i in ids], np.int64)
            nulls = np.array([i is None for i in ids], bool)
            mask = zlib.compress(np.array([k if _learns(i) else NOBODY for i, k in zip(ids, classes, strict=True)], np.uint8).tobytes(), 1)
            head = nulls.tobytes() + known.tobytes() + n.tobytes()
            chunk = run_id(number, head)
            rows = [(-1 - chunk % buckets, chunk, head, b"", b"", b"")]
            order = np.argsort(home, kind="stable")
            within = np.empty(len(words), np.int64)
            edge = np.searchsorted(home[order], np.arange(buckets + 1))
            within[order] = np.arange(len(words)) - np.repeat(edge[:-1], np.diff(edge))
            by = np.argsort(home[word], kind="stable") if len(word) else np.empty(0, np.int64)
            pairs = np.searchsorted(home[word][by], np.arange(buckets + 1)) if len(word) else np.zeros(buckets + 1, int)
            for b in range(buckets):
                if edge[b] < edge[b + 1]:
                    mine = by[pairs[b] : pairs[b + 1]]
                    held = doc[mine].astype(np.uint16).tobytes() + within[word[mine]].astype(np.uint32).tobytes() + times[mine].astype(np.uint32).tobytes()
                    rows.append((b, chunk, zlib.compress(b" ".join(words[i] for i in order[edge[b] : edge[b + 1]]), 1), zlib.compress(held, 1), mask, b""))
            ids.clear()
            parts.clear()
            classes.clear()
            numbers.clear()
            return _rows(rows)

        for doc_id, text, of in rows_of(batches):
            words = space_words(text.lower())
            ids.append(doc_id)
            classes.append(of)
            parts.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64))
            size += len(words)
            if size >= CHUNK or len(ids) >= 60_000:
                yield _batch(flush(number))
                number += 1
                size = 0
        if ids:
            yield _batch(flush(number))

    return pack


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())] + [pa.array([r[j] for r in rows], pa.binary()) for j in (2, 3, 4, 5)],
        ["key", "chunk", "a", "b", "c", "d"],
    )


def _batch(table: pa.Table) -> pa.RecordBatch:
    return table.combine_chunks().to_batches()[0]


def _held(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zlib.decompress(packed)
    n = len(raw) // 10
    return np.frombuffer(raw[: 2 * n], np.uint16), np.frombuffer(raw[2 * n : 6 * n], np.uint32), np.frombuffer(raw[6 * n :], np.uint32)


def _count(table: pa.Table) -> pa.Table:
    """In one bucket: each distinct word once with its count in training texts (chunk -1), holders renumbered to it."""
    key, chunk, a, b, c, _ = (table[n].to_pylist() for n in ("key", "chunk", "a", "b", "c", "d"))
    if key[0] < 0:
        return table
    numbers: dict[bytes, int] = {}
    out, held = [], []
    for i in range(len(key)):
        place = np.array([numbers.setdefault(w, len(numbers)) for w in zlib.decompress(a[i]).split(b" ")], np.uint32)
        doc, word, times = _held(b[i])
        held.append((doc, place[word], times, np.frombuffer(zlib.decompress(c[i]), np.uint8)))
    total = np.zeros((CLASSES + 1, len(numbers)), np.int64)
    for i, (doc, word, times, of) in enumerate(held):
        for k in np.unique(of[of != NOBODY]):
            here = of[doc] == k
            total[k] += np.bincount(word[here], times[here], len(numbers)).astype(np.int64)
        out.append((key[i], chunk[i], b"", zlib.compress(doc.tobytes() + word.tobytes() + times.tobytes(), 1), b"", b""))
    whole = np.concatenate((total, total.sum(axis=0, keepdims=True)))
    told = np.array([whole.sum(axis=1), (whole > 0).sum(axis=1), (whole == 1).sum(axis=1), (whole == 2).sum(axis=1)], np.int64)
    out.append((key[0], -1, zlib.compress(b" ".join(numbers), 1), zlib.compress(total.tobytes(), 1), told.tobytes(), b""))
    return _rows(out)


def _totals(batches: Iterable[pa.RecordBatch]):
    """Tokens, types, types seen once and twice of every class, all classes last."""
    told = np.zeros(4 * (CLASSES + 2), np.int64)
    for _, _, _, _, c, _ in rows_of(batches):
        told += np.frombuffer(c, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(told)), pa.int32()), pa.array(told)], ["i", "n"])


def _expect(pieces, logp):
    """Expected uses of each piece over the distinct training words of a bucket."""

    def expect(batches: Iterable[pa.RecordBatch]):
        vocabulary = Vocabulary(*pieces.value)
        counts = np.zeros(len(logp.value))
        for _, _, a, b, _, _ in rows_of(batches):
            total = np.frombuffer(zlib.decompress(b), np.int64).reshape(CLASSES + 1, -1).sum(axis=0)
            words = [w.decode("utf-8", "replace") for w, n in zip(zlib.decompress(a).split(b" "), total.tolist(), strict=True) if n]
            for _, lattice in lattices(vocabulary, words):
                counts += lattice.expected(lattice.weights(logp.value), len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["piece", "n"])

    return expect


def learnt_weights(words: DataFrame, vocabulary: Vocabulary, pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of the pieces: the vocabulary's own scores, then re-estimated on the distinct training words.

    Only one number per piece of the given vocabulary reaches the driver.
    """
    first = prior(vocabulary)
    logp = first
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast(logp)
        found = words.mapInArrow(_expect(pieces, sent), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts = np.exp(first) * 100.0  # pieces that were not used keep a little weight
        for r in found:
            counts[r["piece"]] += r["n"]
        logp = np.log(counts / counts.sum())
    return logp


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, seven steps up."""
    shift = np.zeros_like(x)
    for i in range(7):
        shift += np.log(x + i)
    y = x + 7.0
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _score(pieces, logp, told: np.ndarray, concentration: float):
    """In one bucket: what its words add to the scores of the documents that hold them."""
    tokens, types, once, twice = told
    discount = np.clip(np.where(once > 0, once / np.maximum(1, once + 2 * twice), 0.5), 0.05, 0.95)
    classes = np.flatnonzero(tokens[:-1])

    def mixed_in(count, k, below):
        """Counts of one class less the discount, which goes to what is expected without that class."""
        if not tokens[k]:
            return below
        with np.errstate(divide="ignore"):
            seen = np.log(np.maximum(count - discount[k], 0.0) / tokens[k])
        return np.logaddexp(seen, np.log(discount[k] * types[k] / tokens[k]) + below)

    def score(table: pa.Table) -> pa.Table:
        key, chunk, a, b, _, _ = (table[n].to_pylist() for n in ("key", "chunk", "a", "b", "c", "d"))
        if key[0] < 0:
            return table
        at = chunk.index(-1)
        total = np.frombuffer(zlib.decompress(b[at]), np.int64).reshape(CLASSES + 1, -1)
        whole = total.sum(axis=0)
        words = [w.decode("utf-8", "replace") for w in zlib.decompress(a[at]).split(b" ")]
        vocabulary = Vocabulary(*pieces.value)
        spelt = np.zeros(len(words))
        for block, lattice in lattices(vocabulary, words):
            spelt[block] = lattice.forward(lattice.weights(logp.value))[lattice.length]
        every = mixed_in(whole, -1, spelt)
        mass = [np.log(concentration) + mixed_in(total[k], k, every) for k in classes] or [np.log(concentration) + every]
        out = []
        for i in range(len(key)):
            if i == at:
                continue
            doc, word, times = _held(b[i])
            here = np.flatnonzero(np.bincount(doc))
            sums = [np.bincount(doc, times * np.log10(whole[word] + 1.0))[here].tobytes()]
            for m in mass:
                # rising factorial mass (mass+1) ... (mass+times-1), its first factor in log space
                own = m[word]
                more = np.flatnonzero(times > 1)
                rest = np.exp(np.maximum(own[more], -700.0)) + 1.0
                own[more] += log_gamma(rest + times[more] - 1.0) - log_gamma(rest)
                sums.append(np.bincount(doc, own)[here].astype(np.float32).tobytes())
            known = np.bincount(doc, times * (whole[word] > 0))[here].astype(np.uint32)
            out.append((0, chunk[i], b"", here.astype(np.uint16).tobytes(), b"".join(sums), known.tobytes()))
        return _rows(out)

    return score


def _sum_up(concentration: float, ends: float, shares: np.ndarray):
    """A run's documents with the sums of their words over all buckets, added in an order of their own."""

    def sum_up(table: pa.Table) -> pa.Table:
        a, b, c, d = (table[n].to_pylist() for n in ("a", "b", "c", "d"))
        head = next(x for x in a if x)
        docs = len(head) // 17
        nulls, ids, n = np.frombuffer(head[:docs], bool), np.frombuffer(head[docs : 9 * docs], np.int64), np.frombuffer(head[9 * docs :], np.int64)
        base, sums, known = np.zeros(docs), np.zeros((len(shares), docs)), np.zeros(docs, np.int64)
        for i in sorted(range(len(b)), key=lambda i: (b[i], c[i])):
            if b[i]:
                here = np.frombuffer(b[i], np.uint16)
                base[here] += np.frombuffer(c[i], np.float64, len(here))
                sums[:, here] += np.frombuffer(c[i], np.float32, offset=8 * len(here)).reshape(len(shares), -1)
                known[here] += np.frombuffer(d[i], np.uint32)
        drawn = log_gamma(np.array([concentration])) - log_gamma(concentration + n)
        # the class is not given: the text's probability sums over all of them
        model = np.logaddexp.reduce(np.log(shares)[:, None] + sums, axis=0) + drawn + n * np.log1p(-ends) + np.log(ends)
        return pa.table(
            [pa.array([None if z else i for z, i in zip(nulls.tolist(), ids.tolist(), strict=True)], pa.int64()), pa.array(n), pa.array(known), pa.array(base), pa.array(model / np.log(10))],
            ["doc_id", "n_words", "n_known", "base", "model"],
        )

    return sum_up


def text_scores(
    docs: DataFrame, model_file: str = MODEL, class_column: str | None = None, rounds: int = ROUNDS, concentration: float = CONCENTRATION
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the add-one unigram over words and one end token.  ``score`` is log10 of the text's
    marginal probability: each word's probability sums over all segmentations into pieces of an existing
    vocabulary (forward recursion in log space) and over the whole-word path of words seen in training;
    the words of one text are drawn around these probabilities (Dirichlet compound, with
    ``concentration``), and an end closes the text.  With ``class_column`` (a language, say) training
    texts also count for their class; the class of a scored text is not looked at: its probability is the
    sum over the CLASSES most frequent classes and the rest.  Piece weights start from the vocabulary's scores and
    are re-estimated on all distinct training words.  Held-out documents teach nothing.

    NULL and empty texts are the end token alone.  A NULL doc_id is not held out.  Repeated rows count
    and are scored each.  Without any training text every word is spelt from the vocabulary's scores.
    Characters without a piece are spelt by their bytes.  Further columns are ignored.
    """
    spark = docs.sparkSession
    vocabulary = load(model_file)
    pieces = spark.sparkContext.broadcast(tuple(vars(vocabulary).values()))
    of = F.lit(0)
    names: list = []
    learning = docs.where(~held_out(F.col("doc_id")))
    if class_column is not None:
        top = learning.where(F.col(class_column).isNotNull()).groupBy(F.col(class_column).cast("string").alias("k")).count()
        names = [r["k"] for r in top.orderBy(F.desc("count"), "k").limit(CLASSES).collect()]
        for i, name in enumerate(names):
            of = F.when(F.col(class_column).cast("string") == name, i + 1).otherwise(of)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"), of.cast("int").alias("of"))
    buckets = max(16, shuffle_partitions(spark) // 2)
    counted = stored(texts.mapInArrow(_pack(buckets), _PACKED).groupBy("key").applyInArrow(_count, _PACKED))
    words = counted.where("chunk = -1")
    told = np.zeros(4 * (CLASSES + 2), np.int64)
    for r in words.mapInArrow(_totals, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        told[r["i"]] = r["n"]
    told = told.reshape(4, -1)
    tokens, types = int(told[0, -1]), int(told[1, -1])
    learnt = learning.count()
    logp = spark.sparkContext.broadcast(learnt_weights(words, vocabulary, pieces, rounds))
    scored = counted.groupBy("key").applyInArrow(_score(pieces, logp, told, concentration), _PACKED)
    n, v = tokens + learnt, types + (learnt > 0)
    used = told[0, :-1][told[0, :-1] > 0]
    shares = used / used.sum() if len(used) else np.ones(1)
    summed = scored.groupBy("chunk").applyInArrow(_sum_up(concentration, (learnt + 1) / (n + 2), shares), _SCORED)
    n_tokens = F.col("n_words") + 1
    return summed.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), n_tokens.alias("n_tokens"), (F.col("n_known") + int(learnt > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(learnt + 1)) - n_tokens * float(np.log10(n + v + 1))).alias("base_score"),
        F.col("model").alias("score"),
    )
