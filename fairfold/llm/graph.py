"""Connected components as rounds of joins: no links or components ever reach the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairfold.llm.text import removed, stored, stored_at

FOREST = 1_000_000  # nodes that a task connects at a time


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of a link; the component is its smallest node.

    Alternating stars: first each node hands its larger neighbours to the smallest node it sees, then
    each node links its smaller neighbours to the smallest of them.  Both keep connectivity, and after
    logarithmically many rounds every component is one star.  A hub's links meet one row of its own in a
    join; they are not split, so one task reads them.  Two rounds are one job; then one count over the nodes says whether all are stars.
    """
    one, two = F.col(a), F.col(b)
    links = links.where(one != two).select(F.greatest(one, two).alias("u"), F.least(one, two).alias("v"))
    links = links.mapInArrow(_forest, "u long, v long").distinct()
    links, path = stored_at(links)
    while not _all_stars(links):
        before = path
        links, path = stored_at(_round(_round(links)))
        removed(links.sparkSession, before)
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of what up to FOREST links of a task connect: fewer links, and shorter ways between their ends."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = y
        return x

    def stars() -> pa.RecordBatch:
        ends = [(x, y) for x in list(root) if (y := top(x)) != x]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([e[j] for e in ends], pa.int64()) for j in (0, 1)], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            x, y = top(u), top(v)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > FOREST:
            yield stars()
    yield stars()


def _all_stars(links: DataFrame) -> bool:
    """Every larger end has one link, and is no link's smaller end."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("n")), F.struct(F.col("v").alias("node"), F.lit(0).alias("n")))).alias("e"))
    nodes = ends.select("e.*").groupBy("node").agg(F.sum("n").alias("up"), F.min("n").alias("low"))
    return nodes.where("up > 1 or up = 1 and low = 0").agg(F.count("*")).first()[0] == 0


def _round(links: DataFrame) -> DataFrame:
    """Larger neighbours to the smallest node in sight, then smaller neighbours to the smallest of them."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
    large = links.join(low, "v").select("u", F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(
        F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
    )
    return small.select("e.*").where("u > v").distinct()


def links_in_families(items: DataFrame, link, limit: int, pivots: int, schema: str = "a long, b long") -> DataFrame:
    """``node, component`` of items that link within their family; items are ``family, id`` and what ``link`` reads.

    ``link`` gets one task's items as an Arrow table with two more columns, member and probe, and returns
    links (a, b) between linked members and probes of a family, as few as connect them.  A family of up
    to ``limit`` items is one task's (with other small ones).  A larger one is cut into blocks of that
    size, with the same ``pivots`` items in each of them; these tie most linked items together.  The
    items that are then outside the family's main group meet all items of the family, block by block.  So
    no link is lost, no task holds more than two blocks, and linked copies never meet pair by pair.
    """
    columns = [c for c in items.columns if c not in ("family", "id")]
    sizes = stored(items.groupBy("family").agg(F.count("*").alias("size")))
    total, largest = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    sized = items.join(sizes, "family")
    yes, no, first = F.lit(True), F.lit(False), F.lit(0).cast("long")

    def task(df, member, probe, *of):
        named = F.xxhash64(*of) if of else F.pmod(F.xxhash64("family"), F.lit(max(1, 4 * int(total) // limit)))
        return df.select(named.alias("task"), "family", "id", *columns, member.alias("member"), probe.alias("probe"))

    small = task(sized.where(F.col("size") <= limit), yes, yes)
    if largest <= limit:
        return components(small.groupBy("task").applyInArrow(link, schema))
    large = sized.where(F.col("size") > limit).withColumn("blocks", F.ceil(F.col("size") / (limit - pivots)).cast("long"))
    large = large.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("by", F.xxhash64("id", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("family").orderBy("by", "id"))
    chosen = large.select("family", "id", "by").withColumn("rank", rank).where(F.col("rank") <= pivots).select("family", "id")
    every = F.explode(F.sequence(first, F.col("blocks") - 1))
    diagonal = large.unionByName(large.join(chosen, ["family", "id"]).withColumn("block", every)).dropDuplicates(["family", "id", "block"])
    links = stored(small.unionByName(task(diagonal, yes, yes, "family", "block")).groupBy("task").applyInArrow(link, schema))
    tied = components(links).withColumnRenamed("node", "id")
    tied = large.join(tied, "id", "left").withColumn("component", F.coalesce("component", "id"))
    main = tied.groupBy("family", "component").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    tied = stored(tied.join(main, "family"))
    outside = tied.where("component != main")
    probing = task(outside.withColumn("other", every), no, yes, "family", "block", "other")
    facing = tied.join(outside.select("family", F.col("block").alias("from")).distinct(), "family")
    facing = task(facing, yes, no, "family", "from", "block")
    more = probing.unionByName(facing).groupBy("task").applyInArrow(link, schema)
    return components(links.unionByName(more))
