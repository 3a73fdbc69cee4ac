"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairfold.llm.text import alphanumeric_words, matching, rows_of, stored, word_hashes

THRESHOLD = 0.7
MAX_EXAMPLES = 20_000  # labelled rows that are examples, half of them of each label at most; every task holds the index of all of them
NEIGHBOURS = 15
BLOCK = 64  # examples per block of the index
TOGETHER = 64  # texts that are searched at a time
OPENED = 8  # blocks opened first
LONG_SHARE, LONG_BYTES = 1 / 16, 1 << 26  # terms that more of the examples hold have long lists, bounded by blocks first; what these lists take at most
BEGINNINGS = (6, 8)  # bytes of a word's beginning that count as a term of their own
PRIOR_WEIGHT = 0.5  # votes of the prior beside the neighbours' similarities
EVEN, HALF_GAIN = 0.02, 20.0  # weight of a term that both labels hold alike; likelihood ratio that gives half of what is above


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def term_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of all lower-cased words and of the beginnings of longer ones (marked ``*``)."""
    words = alphanumeric_words(text.decode("utf-8", "replace").lower().encode())
    return np.unique(word_hashes(words + [w[:n] + b"*" for n in BEGINNINGS for w in words if len(w) > n]), return_counts=True)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``first[0] .. first[0] + size[0] - 1``, then those of the next, as one array."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def smallest(values: np.ndarray) -> np.ndarray:
    """Numbers of 0 and above in the narrowest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


@dataclass
class Index:
    """Postings of all terms of the examples; what tasks are sent is counts, weights follow from them.

    Term t's list is ``held[start[t]:start[t + 1]]`` (examples, ascending) with ``counts`` and, derived,
    ``weight``.  The longest lists, as many as LONG_BYTES hold, also stand block by block in a row each of
    ``long_weight``, with zeros for examples without the term and their maxima in ``block_max``.
    """

    terms: np.ndarray
    factor: np.ndarray  # idf by term, times how far the labels differ in it
    size: np.ndarray  # of each term's list
    held: np.ndarray
    counts: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    prior: float  # share of label 1 among examples without any term

    def __post_init__(self):
        n, size = len(self.labels), self.size.astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(size)))
        self.held = self.held.astype(np.int64)
        weight = (1.0 + np.log(self.counts)) * np.repeat(self.factor, size)
        self.weight = (weight / np.sqrt(np.bincount(self.held, weight * weight, n))[self.held] if len(weight) else weight).astype(np.float32)
        blocks = n // BLOCK + 1
        many = np.flatnonzero(size > LONG_SHARE * n)
        many = many[np.argsort(-size[many], kind="stable")][: LONG_BYTES // (4 * BLOCK * blocks)]
        self.long_row = np.full(len(self.terms), -1)
        self.long_row[many] = np.arange(len(many))
        self.long_weight = np.zeros((len(many), blocks, BLOCK), np.float32)
        place = _ranges(self.start[many], size[many])
        example = self.held[place]
        self.long_weight[np.repeat(np.arange(len(many)), size[many]), example // BLOCK, example % BLOCK] = self.weight[place]
        self.block_max = self.long_weight.max(axis=2)

    def vectors(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms of the index that each text (hashes, counts) holds, and their weights in a vector of length 1."""
        if not len(self.terms):
            return [(np.empty(0, np.int64), np.empty(0))] * len(texts)
        hashes, where = np.unique(np.concatenate([t[0] for t in texts]), return_inverse=True)
        at = np.searchsorted(self.terms, hashes)  # all texts' terms in order: neighbours in the vocabulary are looked up together
        at[at == len(self.terms)] = 0
        at = np.where(self.terms[at] == hashes, at, -1)[where]
        out, begin = [], 0
        for own, counts in texts:
            found = at[begin : begin + len(own)]
            begin += len(own)
            counts, found = counts[found >= 0], found[found >= 0]
            w = (1.0 + np.log(counts)) * self.factor[found]
            out.append((found, w / np.sqrt(w @ w) if len(w) else w))
        return out

    def vector(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.vectors([(hashes, counts)])[0]

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([(at, w)], k)[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the k examples of greatest positive cosine, to six digits, ties by example order; exact.

        Short lists are added up first.  A block's bound is the best of these sums in it and, at most, what
        its maxima of the long lists add.  The blocks of the greatest bounds are opened first, then all
        others that could reach the k-th best cosine found in them.  Vectors for which these are many get
        the long lists' share of all examples by one matrix product for the lot.
        """
        blocks = self.block_max.shape[1]
        share = np.zeros((len(queries), len(self.long_weight)), np.float32)
        exact = np.zeros((len(queries), blocks * BLOCK))
        whole, left = [], []
        for q, (at, w) in enumerate(queries):
            row = self.long_row[at]
            long, short, part = row[row >= 0], at[row < 0], w[row < 0]
            size = self.start[short + 1] - self.start[short]
            place = _ranges(self.start[short], size)
            exact[q] = np.bincount(self.held[place], np.repeat(part, size) * self.weight[place], blocks * BLOCK)
            if not len(long):
                continue
            share[q, long] = w[row >= 0]
            by_block = exact[q].reshape(blocks, BLOCK)
            bound = by_block.max(axis=1) + share[q, long] @ self.block_max[long]
            first = np.argpartition(-bound, OPENED)[:OPENED] if blocks > OPENED else np.arange(blocks)
            self._open(by_block, first, share[q, long], long)
            # the k-th best so far stands in the opened blocks, or there are too few of them: then all others are opened
            best = by_block[first].ravel()
            kth = np.partition(best, -k)[-k] if len(best) > k else 0.0
            bound[first] = -1.0
            some = np.flatnonzero(bound >= kth - 1e-6)
            if 4 * len(some) < blocks:
                self._open(by_block, some, share[q, long], long)
            else:
                whole.append(q)
                left.append(some)
        if whole:
            dense = (share[whole] @ self.long_weight.reshape(len(self.long_weight), -1)).reshape(len(whole), blocks, BLOCK)
            for q, some, added in zip(whole, left, dense, strict=True):
                exact[q].reshape(blocks, BLOCK)[some] += added[some]
        return [self._best(cosines, k) for cosines in exact]

    def _open(self, by_block: np.ndarray, some: np.ndarray, share: np.ndarray, long: np.ndarray):
        """Add what the long lists give in some blocks."""
        by_block[some] += (share @ self.long_weight[long[:, None], some].reshape(len(long), -1)).reshape(len(some), BLOCK)

    def _best(self, cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        # rounding keeps the order: what is not among the k best before it only ties with them afterwards
        kth = np.partition(cosines, -k)[-k] if len(cosines) > k else 0.0
        found = np.flatnonzero((cosines >= kth - 2e-6) & (cosines > 0))
        value = np.round(cosines[found], 6)
        order = np.argsort(-value, kind="stable")[:k]
        order = order[value[order] > 0]
        return found[order], value[order]

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None = None) -> list[tuple[list[float], list[int]]]:
        """What each text's neighbours say (its own example in ``but`` aside), and the ids of the nearest three.

        Share of label 1, weighted by closeness and drawn towards the prior, the greatest cosine of either
        label, and the mean of all; nothing for a text without any term of the index.
        """
        out = []
        for begin in range(0, len(texts), TOGETHER):
            some = self.vectors(texts[begin : begin + TOGETHER])
            for number, (found, cosine) in enumerate(self.nearest_of(some, k + (but is not None)), begin):
                if but is not None:
                    found, cosine = found[found != but[number]][:k], cosine[found != but[number]][:k]
                if not len(found):
                    out.append(([], []))
                    continue
                toxic = self.labels[found] > 0
                share = (float(cosine[toxic].sum()) + PRIOR_WEIGHT * self.prior) / (float(cosine.sum()) + PRIOR_WEIGHT)
                most = [float(cosine[x].max(initial=0.0)) for x in (toxic, ~toxic)]
                out.append(([min(1.0, max(0.0, share)), *most, float(cosine.mean())], self.ids[found[:3]].tolist()))
        return out

    def score(self, told: list[float], curve: np.ndarray | None) -> float:
        """Probability of label 1 from the vote and the similarities it rests on."""
        if not told or curve is None:
            return told[0] if told else self.prior
        return float(1 / (1 + np.exp(-np.clip(np.array([1.0, *told]) @ curve, -30, 30))))


def examples(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """``id, label`` of at most ``limit`` labelled rows, each label by its smallest hashes.

    A doc_id labelled more than once counts as toxic if any of its labels says so.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label")).where(
        "id is not null and label in (0, 1)"
    ).groupBy("id").agg(F.max("label").alias("label")).where(~held_out(F.col("id")))
    order = (F.xxhash64("id"), F.col("id"))
    return usable.where("label = 1").orderBy(*order).limit(limit // 2).unionByName(usable.where("label = 0").orderBy(*order).limit(limit - limit // 2))


def _counted(batches: Iterable[pa.RecordBatch]):
    """``id, label, terms, counts`` of examples (id, label, text)."""
    for batch in batches:
        for doc_id, label, text in rows_of([batch]):
            terms, counts = term_counts(text)
            columns = [pa.array([doc_id], pa.int64()), pa.array([label], pa.int32()), pa.array([terms.view(np.int64)], pa.list_(pa.int64())), pa.array([counts.astype(np.int32)], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "terms", "counts"])


def _frequencies(terms):
    """How many of a task's texts hold each of the broadcast terms, by its number; -1 counts the texts."""

    def count(batches: Iterable[pa.RecordBatch]):
        known = terms.value
        held, n = np.zeros(len(known), np.int64), 0
        for batch in batches:
            for begin in range(0, batch.num_rows, TOGETHER):
                texts = [term_counts(text)[0] for (text,) in rows_of([batch.slice(begin, TOGETHER)])]
                own, texts_with = np.unique(np.concatenate(texts), return_counts=True)
                at = np.searchsorted(known, own)
                at[at == len(known)] = 0
                held[at[known[at] == own]] += texts_with[known[at] == own]
                n += len(texts)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(held[some], n))], ["term", "n"])

    return count


def scores(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS, keyed: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, neighbours (up to 3 example doc_ids); with ``keyed`` also row, the hash of the text.

    Examples are a bounded sample (``max_examples``) of the labelled rows outside the held-out third, with
    all their words and the beginnings of longer ones; everything else covers all documents: document
    frequencies for the idf, and an exact search for each.  Of several texts of a labelled doc_id the first in
    order is the example.  A term weighs by its idf and by how far the
    labels of the examples differ in it, smoothly and never by nothing.  Words that no example holds say
    nothing and are left out of a vector's length.  NULL and empty texts, and texts without any term of the
    examples, get the share of label 1 among examples of that kind.  Without examples of both labels the
    score is the vote as it is, 0 when there are no examples at all.  Very long texts are read whole.
    Repeated rows get equal scores; a NULL doc_id is not held out; an empty table gives an empty result; further
    columns are ignored.
    """
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = stored(examples(docs, labels, max_examples))
    with_text = matching(read.withColumnRenamed("doc_id", "id"), chosen, ["id"])
    if not with_text.groupBy("id").count().where("count > 1").isEmpty():  # else their texts need not be shuffled
        with_text = with_text.groupBy("id", "label").agg(F.min("text").alias("text"))
    with_text = with_text.select("id", "label", "text")
    held = with_text.mapInArrow(_counted, "id long, label int, terms array<long>, counts array<int>").toArrow()  # bounded by max_examples
    ids, marks, size = (x.to_numpy() for x in (held["id"], held["label"], pa.compute.list_value_length(held["terms"])))
    # task by task, so that no copy of all terms is made
    lists = [c.flatten().to_numpy().view(np.uint64) for c in held["terms"].chunks]
    vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.unique(x) for x in lists)]))
    at = np.concatenate([np.empty(0, np.int32), *(np.searchsorted(vocabulary, x).astype(np.int32) for x in lists)])
    counts = np.concatenate([np.empty(0, np.uint8), *(smallest(c.flatten().to_numpy()) for c in held["counts"].chunks)])
    del held, lists
    df, n_docs = np.zeros(len(vocabulary), np.int64), 0
    if len(vocabulary):
        known = spark.sparkContext.broadcast(vocabulary)
        found = read.select("text").mapInArrow(_frequencies(known), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        known.destroy()
        term, n = found["term"].to_numpy(), found["n"].to_numpy()
        n_docs = int(n[term < 0].sum())
        df[term[term >= 0]] = n[term >= 0]
    fields = index_fields(ids, marks, size, at, counts, vocabulary, df, n_docs)
    del at, counts
    parts = spark.sparkContext.broadcast(fields)
    curve = fit_curve(spark, parts, fields[5], k)

    def score(batches: Iterable[pa.RecordBatch]):
        seen: dict[int, tuple[float, list[int]]] = {}
        index = Index(*parts.value)
        for batch in batches:
            ids, keys = batch["doc_id"].to_pylist(), batch["row"].to_pylist()
            if len(seen) > 50_000:
                seen.clear()
            new = {row: i for i, row in enumerate(keys) if row not in seen}
            rows = list(new)
            at = pa.array(list(new.values()), pa.int64())
            for begin in range(0, len(rows), TOGETHER):
                texts = [term_counts(text) for (text,) in rows_of([batch.select(["text"]).take(at[begin : begin + TOGETHER])])]
                for row, (told, evidence) in zip(rows[begin : begin + TOGETHER], index.votes(texts, k), strict=True):
                    seen[row] = index.score(told, curve), evidence
            got = [seen[row] for row in keys]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array(keys, pa.int64())],
                ["doc_id", "score", "neighbours", "row"],
            )

    return read.withColumn("row", F.xxhash64("text")).mapInArrow(score, "doc_id long, score double, neighbours array<long>, row long").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "neighbours", *(["row"] if keyed else [])
    )


def fit_curve(spark, parts, labels: np.ndarray, k: int) -> np.ndarray | None:
    """Logistic calibration on the examples' own votes, each found without itself; a little ridge, Newton steps."""
    if len(set(labels)) < 2:
        return None

    def votes(batches: Iterable[pa.RecordBatch]):
        index = Index(*parts.value)
        by_example = np.argsort(index.held, kind="stable")  # each example's terms again, ascending
        cuts = np.searchsorted(index.held[by_example], np.arange(len(index.labels) + 1))
        terms = np.repeat(index.terms, index.size)[by_example]
        for batch in batches:
            at = batch["id"].to_pylist()
            own = [slice(cuts[e], cuts[e + 1]) for e in at]
            told = [vote for vote, _ in index.votes([(terms[x], index.counts[by_example[x]]) for x in own], k, at)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(told, pa.list_(pa.float64()))], ["id", "told"])

    tasks = max(1, min(spark.sparkContext.defaultParallelism, len(labels) // 50))
    found = spark.range(0, len(labels), 1, tasks).mapInArrow(votes, "id long, told array<double>").where("size(told) > 0").collect()
    found.sort(key=lambda r: r["id"])
    y = np.array([labels[r["id"]] for r in found])
    if len(set(y)) < 2:
        return None
    x = np.array([[1.0, *r["told"]] for r in found])
    curve = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        slope = x.T @ (p - y) + 0.1 * curve
        curve = curve - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(curve)), slope)
    return curve


def contrast(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How far the labels differ in each term: from EVEN towards 1 with the likelihood ratio of its counts of examples."""
    if not n_toxic or not n_clean:
        return np.ones(len(toxic))
    a, b, share = toxic.astype(float), clean.astype(float), (toxic + clean) / (n_toxic + n_clean)
    gain = np.zeros(len(a))
    for x, expected in ((a, n_toxic * share), (b, n_clean * share), (n_toxic - a, n_toxic * (1 - share)), (n_clean - b, n_clean * (1 - share))):
        some = x > 0
        gain[some] += 2 * x[some] * np.log(x[some] / expected[some])
    gain = np.maximum(gain, 0.0)
    return EVEN + (1 - EVEN) * gain / (gain + HALF_GAIN)


def index_fields(ids: np.ndarray, label: np.ndarray, size: np.ndarray, at: np.ndarray, counts: np.ndarray, terms: np.ndarray, df: np.ndarray, n_docs: int) -> tuple:
    """What tasks are sent of the index: of each example its id, label and ``size`` numbers (``at``) and counts of terms, one behind the other.

    The driver makes nothing but this: lists are filled example by example, weights follow in the tasks.
    """
    cuts = np.concatenate(([0], np.cumsum(size, dtype=np.int64))).tolist()
    toxic, clean = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    for e, y in enumerate(label.tolist()):
        (toxic if y > 0 else clean)[at[cuts[e] : cuts[e + 1]]] += 1  # an example's terms are distinct
    n_toxic = int(label.sum())
    factor = (np.log((1 + n_docs) / (1 + df)) + 1.0) * contrast(toxic, clean, n_toxic, len(label) - n_toxic)
    # examples with the same weightiest term stand together, so that few blocks matter to a query
    heaviest = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own = at[lo:hi]
        heaviest.append(int(own[np.argmax((1.0 + np.log(counts[lo:hi].astype(float))) * factor[own])]) if hi > lo else -1)
    order = sorted(range(len(ids)), key=lambda e: (heaviest[e], ids[e], e))
    listed = toxic + clean
    place = np.cumsum(listed) - listed  # where the next example of a term goes
    held, again = np.zeros(len(at), np.min_scalar_type(max(0, len(ids) - 1))), np.zeros_like(counts)
    for number, e in enumerate(order):
        own = at[cuts[e] : cuts[e + 1]]
        held[place[own]] = number
        again[place[own]] = counts[cuts[e] : cuts[e + 1]]
        place[own] += 1
    size, label = size[order], label[order].astype(float)
    base = float(label.mean()) if len(label) else 0.0
    prior = float((label[size == 0].sum() + base) / ((size == 0).sum() + 1))
    return terms, factor.astype(np.float32), smallest(listed), held, again, label, ids[order].astype(np.int64), prior


def build_index(vectors: list[tuple], terms: np.ndarray, df: np.ndarray, n_docs: int) -> Index:
    """The index over the examples ``(id, label, hashes, counts)``."""
    ids, label, size = (np.array([f(v) for v in vectors], np.int64) for f in (lambda v: v[0], lambda v: v[1], lambda v: len(v[2])))
    at = np.searchsorted(terms, np.concatenate([v[2] for v in vectors])).astype(np.int32) if vectors else np.empty(0, np.int32)
    counts = smallest(np.concatenate([v[3] for v in vectors])) if vectors else np.empty(0, np.uint8)
    return Index(*index_fields(ids, label, size, at, counts, terms, df, n_docs))
