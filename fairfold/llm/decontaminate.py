"""Benchmark passages in training text, found through a stored positional inverted index."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairfold.llm.text import BROADCAST_ROWS, alphanumeric_words, matching, rows_of, stored

WINDOW = 10
_INDEX = "row long, doc_id long, n_words long, term string, positions array<int>"


def _words_udf(width: int):
    """Windows of the items: (item, its terms in order); a short item is one window."""

    def windows(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            out: list[tuple] = []
            for item, text in rows_of([batch]):
                words = [w.decode("utf-8", "replace") for w in alphanumeric_words(text)]
                out += [(item, words[i : i + width]) for i in range(max(1, len(words) - width + 1)) if words]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.string()))], ["item_id", "terms"]
            )

    return windows


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``window, terms, items``: each distinct word sequence once, with the sorted items that contain it; those without item_id name none."""
    rows = items.select(
        F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return (
        rows.mapInArrow(_words_udf(width), "item_id string, terms array<string>")
        .groupBy("terms").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        .select(F.monotonically_increasing_id().alias("window"), "terms", "items")
    )


def positional_index(spark: SparkSession, docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings ``row, doc_id, n_words, term, positions`` of every document, one row for each of its terms.

    Only terms that some test window contains can be asked for, so only those are stored: the term list
    is shipped to the tasks up to BROADCAST_ROWS terms; a longer list filters by a join instead.  A
    document without any such term keeps one row with a NULL term, so that every document is present.
    ``row`` tells rows with equal doc_id apart.
    """
    small = vocabulary.count() <= BROADCAST_ROWS
    wanted = spark.sparkContext.broadcast({r[0] for r in vocabulary.collect()} if small else None)

    def index(batches: Iterable[pa.RecordBatch]):
        known = None if wanted.value is None else {t.encode() for t in wanted.value}
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                ids, lengths, terms, positions, rows, sizes = [], [], [], [], [], []
                for row, doc_id, text in rows_of([batch.slice(begin, 512)]):
                    words = alphanumeric_words(text)
                    found: dict[bytes, list[int]] = {}
                    for i, w in enumerate(words):
                        if known is None or w in known:
                            found.setdefault(w, []).append(i)
                    for term, at in found.items() or ((None, []),):
                        rows.append(row)
                        ids.append(doc_id)
                        lengths.append(len(words))
                        terms.append(term and term.decode("utf-8", "replace"))
                        positions += at
                        sizes.append(len(at))
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.string()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(positions, pa.int32())),
                    ],
                    ["row", "doc_id", "n_words", "term", "positions"],
                )

    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    out = numbered.mapInArrow(index, _INDEX)
    if not small:
        kept = out.join(vocabulary, "term", "left_semi")
        out = kept.unionByName(out.groupBy("row", "doc_id", "n_words").agg(F.lit(None).cast("string").alias("term"), F.array().cast("array<int>").alias("positions")))
    return stored(out)


def matches(index: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """``row, start, size, window`` of every place where all terms of a window stand.

    With ``slop`` 0 these are exact phrases: term i of the window at ``start + i``.  With ``slop`` s they
    are proximity matches: the anchor term at its place and every other term within s words of its own.
    The lists are intersected from the rarest term on: the rarest one proposes the starts, the second
    rarest (on documents that hold both) keeps few of them, and the others are checked together.
    """
    counts = index.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum(F.size("positions")).alias("n"))
    placed = windows.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    # a window with a term that no document holds cannot occur
    # a term that most windows hold is not dealt to one task: the counts, one row a term, go to the windows
    ranked = matching(placed, stored(counts), ["term"], "left").groupBy("window", "size").agg(
        F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("by_rarity"), F.count("n").alias("known")
    ).where("known = size").select("window", "size", "by_rarity")
    ranked = stored(ranked)
    postings = index.where(F.col("term").isNotNull()).select("row", "term", "positions")

    first = ranked.select("window", "size", F.col("by_rarity")[0]["term"].alias("term"), F.col("by_rarity")[0]["offset"].alias("offset"), F.get("by_rarity", F.lit(1)).alias("next"))
    rarest = matching(postings, stored(first.select("term").distinct()), ["term"], "left_semi")
    starts = rarest.join(first, "term").select("row", "window", "size", "next", F.explode("positions").alias("p"), "offset").select(
        "row", "window", "size", (F.col("p") - F.col("offset")).alias("start"), F.col("next")["term"].alias("term"), F.col("next")["offset"].alias("offset")
    ).where("start >= 0" if slop == 0 else "true")

    def stands(p, start, offset):
        return F.exists(p, lambda x: F.abs(x - start - offset) <= slop) if slop else F.array_contains(p, start + offset)

    alone = starts.where(F.col("term").isNull()).select("row", "start", "size", "window")
    pairs = starts.where(F.col("term").isNotNull()).join(postings, ["row", "term"]).where(
        stands(F.col("positions"), F.col("start"), F.col("offset"))
    ).select("row", "start", "size", "window")
    pairs = stored(pairs.unionByName(alone))
    rest = ranked.select("window", F.explode(F.slice("by_rarity", 3, F.greatest(F.size("by_rarity") - 2, F.lit(0)))).alias("t"))
    rest = rest.select("window", F.col("t.term").alias("term"), F.col("t.offset").alias("offset"))
    # few documents are left: only their lists are read on
    left = stored(pairs.select("row").distinct())
    full = pairs.where("size > 2").join(rest, "window").join(matching(postings, left, ["row"], "left_semi"), ["row", "term"]).where(
        stands(F.col("positions"), F.col("start"), F.col("offset"))
    ).groupBy("row", "start", "size", "window").agg(F.count("*").alias("n")).where("n = size - 2").drop("n")
    return full.unionByName(pairs.where("size <= 2"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids.

    With ``slop`` the words of a window that stand within ``slop`` of their places are hit, each once.
    NULL and empty texts have no words and are clean; items without words are never found; those
    without item_id count for n_hit and contaminated, but not as items; equal windows of several items count for each of them; repeated documents are judged each for
    themselves.  Empty tables give an empty result, or clean documents.  Further columns are ignored.
    """
    spark = docs.sparkSession
    windows = stored(item_windows(items, width))
    vocabulary = stored(windows.select(F.explode("terms").alias("term")).distinct())
    index = positional_index(spark, docs, vocabulary)
    found = stored(matches(index, windows, slop))
    if slop:  # the words found, not all between them
        placed = windows.select("window", F.posexplode("terms").alias("offset", "term"))
        postings = matching(index.where(F.col("term").isNotNull()).select("row", "term", "positions"), stored(found.select("row").distinct()), ["row"], "left_semi")
        near = F.filter("positions", lambda p: F.abs(p - F.col("start") - F.col("offset")) <= slop)
        hit = found.select("row", "start", "window").join(placed, "window").join(postings, ["row", "term"]).select("row", F.explode(near).alias("p"))
    else:
        hit = found.select("row", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("p"))
    hit = hit.groupBy("row", "p").agg(F.lit(1)).groupBy("row").agg(F.count("*").alias("n_hit"))
    of_item = found.select("row", "window").distinct().join(windows.select("window", "items"), "window")
    of_item = of_item.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))
    # one narrow row per document: the first of its index rows
    whole = index.groupBy("row", "doc_id", "n_words").agg(F.lit(1)).select("row", "doc_id", "n_words")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return whole.join(hit.join(of_item, "row"), "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), ids.alias("item_ids"),
    )
