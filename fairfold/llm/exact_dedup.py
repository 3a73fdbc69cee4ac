"""Exact duplicates by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairfold.llm.text import SPACE, plain_text, shuffle_partitions, stored

FANOUT = 16  # runs merged at once in one round


def digests(docs: DataFrame) -> DataFrame:
    """One narrow row per document: its digest, two further checks of equality, and what ranks it."""
    text = plain_text()
    normal = F.regexp_replace(text, SPACE + "+", "")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("points"), normal.alias("normal"),
    ).select(
        "doc_id", "points", F.unhex(F.sha2("normal", 256)).alias("digest"),
        F.xxhash64("normal").alias("check"), F.octet_length("normal").cast("long").alias("bytes"),
    )


def _merged(runs: DataFrame, *also: str) -> DataFrame:
    """Merge equal digests; a digest counts as equal only with the same second hash and length."""
    return runs.groupBy(*also, "digest", "check", "bytes").agg(F.min("best").alias("best"), F.sum("members").alias("members"))


def tree_merge(runs: DataFrame, partitions: int) -> DataFrame:
    """Rounds in which groups of FANOUT partitions exchange slices of their sorted runs and merge them.

    A digest belongs in the end to the partition its leading bits name.  Written in base FANOUT, round
    r makes the r-th digit of the partition number right: a partition sends its run in FANOUT slices to
    the FANOUT partitions that differ from it in this digit alone.  So every round moves each surviving
    digest once, equal digests collapse in every round before they move again, no partition ever holds
    more than its share, and no root gathers everything.  A digest held by a third of all rows meets
    in 1/FANOUT of the partitions first, and is one row in each of them from then on.
    """
    rounds = 1
    while FANOUT**rounds < partitions:
        rounds += 1
    home = F.pmod(F.xxhash64("digest"), F.lit(FANOUT**rounds))
    level = runs.withColumn("at", F.pmod(F.spark_partition_id().cast("long"), F.lit(FANOUT**rounds)))
    for r in range(rounds):
        step = FANOUT**r
        moved = F.col("at") - F.pmod(F.floor(F.col("at") / step), F.lit(FANOUT)) * step + F.pmod(F.floor(home / step), F.lit(FANOUT)) * step
        # the repartition is the exchange; grouping by (at, ...) then needs no other one
        level = level.withColumn("at", moved.cast("long")).repartition(partitions, "at").sortWithinPartitions("at", "digest")
        level = _merged(level, "at")
    return level.drop("at")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space.  The row with most code points in its
    original text stays, then the smallest doc_id.  NULL counts as empty text; empty texts are equal to
    each other.  Repeated rows with one doc_id: each has its own result row, and only as many are kept
    as carry the winning (code points, doc_id), i.e. identical winners stay together.  A NULL doc_id
    ranks last among equals.  An empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    narrow = stored(digests(docs))
    best = F.struct((-F.col("points")).alias("rank"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))
    runs = narrow.select("digest", "check", "bytes", best.alias("best"), F.lit(1).cast("long").alias("members"))
    groups = tree_merge(runs, shuffle_partitions(spark))
    # most texts are their own group; only real groups travel to the members
    groups = groups.where("members > 1")
    key = ["digest", "check", "bytes"]
    return narrow.join(groups, key, "left").select(
        "doc_id",
        F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("members", F.lit(1)).cast("long").alias("group_size"),
        (F.col("members").isNull() | (F.col("points") == -F.col("best.rank")) & F.col("doc_id").eqNullSafe(F.col("best.id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
