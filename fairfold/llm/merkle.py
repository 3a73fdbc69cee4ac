"""Merkle manifest of a table: levels of aligned blocks as concatenated hex strings, hashed and proved by fixed-width substrings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairfold.llm.text import shuffle_partitions, stored

ARITY = 3
LEVELS = 5  # levels that one block folds
WIDTH = ARITY**LEVELS  # nodes of a block: its lowest level is a string of 243 * 64 characters
HEX = 64
BROADCAST_TREES = 10_000  # roots with their paths; beyond that the join shuffles
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def leaf(*values: Column) -> Column:
    """Hash of a row's values: each is ``-`` if NULL, else its UTF-8 byte count, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way up give."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, the place among the rows of one ``tree`` in the given order, and ``size``, their number.

    Rows are sorted over all partitions by (tree, order), so that a tree with a third of all rows lies in
    a third of the partitions.  A place is the row's distance from its tree's first row in the partition
    plus the tree's rows in earlier partitions; only (tree, partition) counts are gathered for that.
    """
    ranged = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "tree", *order).sortWithinPartitions("tree", *order)
    placed = stored(ranged.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(runs.select(
        F.col("tree").alias("run_tree"), F.col("part").alias("run_part"), (F.col("first") - F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("shift"),
        F.sum("n").over(Window.partitionBy("tree")).alias("size"),
    ))
    if runs.count() <= BROADCAST_TREES:
        runs = F.broadcast(runs)
    joined = placed.join(runs, F.col("tree").eqNullSafe(F.col("run_tree")) & (F.col("part") == F.col("run_part")))
    return joined.withColumn("pos", F.col("at") - F.col("shift")).drop("at", "part", "run_tree", "run_part", "shift")


def _parents(level: Column) -> Column:
    """The next level's string: the hash of every ARITY digests of this one."""
    step = ARITY * HEX
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / step).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * step + 1, F.lit(step)), 256)), "")


def _top() -> Column:
    return F.coalesce(*(F.col(f"level_{j}") for j in range(LEVELS, -1, -1)))


def _blocks(nodes: DataFrame, carry: Sequence[str]) -> DataFrame:
    """One row per WIDTH consecutive nodes of a tree, with one string per level; a level that the tree does not have is NULL."""
    member = F.struct("pos", "digest", *carry)
    out = nodes.groupBy("tree", "size", F.expr(f"pos div {WIDTH}").alias("block")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    out = out.withColumn("level_0", F.array_join(F.transform("members", lambda m: m["digest"]), ""))
    for j in range(LEVELS):
        level = F.col(f"level_{j}")
        out = out.withColumn(f"level_{j + 1}", F.when((F.col("size") > WIDTH) | (F.length(level) > HEX), _parents(level)))
    return out


def _members(blocks: DataFrame) -> DataFrame:
    """One row per node again, with its ``path``: what flanks it in its run on every level, then the path of its block."""
    rows = blocks.withColumn("m", F.explode("members")).withColumn("i", (F.col("m.pos") - F.col("block") * WIDTH).cast("int"))
    segments = []
    for j in range(LEVELS):
        node = F.floor(F.col("i") / ARITY**j).cast("int")
        first = F.floor(node / ARITY).cast("int") * ARITY
        level = F.col(f"level_{j}")
        left = F.substring(level, first * HEX + 1, (node - first) * HEX)
        right = F.substring(level, (node + 1) * HEX + 1, (first + ARITY - 1 - node) * HEX)
        segments.append(F.when(F.col(f"level_{j + 1}").isNotNull(), F.struct(left.alias("left"), right.alias("right"))))
    own = F.filter(F.array(*segments), lambda s: s.isNotNull()).cast(_PATH)
    return rows.select("tree", "m.*", F.concat(own, F.col("above")).alias("path"), "root")


def _climbed(nodes: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Blocks of nodes with ``above``, the path from the block to its tree's root, and that ``root``.

    The tops of a tree's blocks are the nodes of the same job once more, until one block holds the tree:
    logarithmically many rounds, each with 1/WIDTH of the rows of the one before.
    """
    blocks = stored(_blocks(nodes, carry))
    whole = blocks.where(F.col("size") <= WIDTH).withColumn("above", F.array().cast(_PATH)).withColumn("root", _top())
    parts = blocks.where(F.col("size") > WIDTH)
    if parts.isEmpty():
        return whole
    tops = parts.select("tree", F.col("block").alias("pos"), F.expr(f"(size + {WIDTH - 1}) div {WIDTH}").alias("size"), _top().alias("digest"))
    upper = _members(_climbed(tops)).select(F.col("tree").alias("up_tree"), F.col("pos").alias("up_pos"), F.col("path").alias("above"), "root")
    joined = parts.join(upper, F.col("tree").eqNullSafe(F.col("up_tree")) & (F.col("block") == F.col("up_pos"))).drop("up_tree", "up_pos")
    return whole.unionByName(joined)


def manifest(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, the columns of ``carry``, leaf, subroot, root, path.

    A leaf is the hash of doc_id, source, lang, n_chars and text (``leaf``).  Leaves of one source ascend
    by doc_id; every three consecutive nodes become their hash until one is left, the subroot.  Subroots
    by source (NULL first, then bytewise) give the root in the same way.  ``path`` holds the siblings to the
    left and right of the document's node on each level, from its leaf to the root; ``folded`` and
    ``proof_digest`` read it.

    NULL values are written as ``-``; a NULL source is a source of its own, a NULL doc_id comes first in
    it.  Rows of one doc_id stand by leaf; repeated rows have one leaf and a place of their own each.  A
    text of any length takes part only in the first pass, after that rows are digests.  Further columns
    are ignored unless carried; carried ones may not be called tree, size, pos, digest or row.  An empty
    table gives an empty result.
    """
    rows = docs.select(
        F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(*map(F.col, FIELDS)).alias("digest"), *carry,
    )
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))  # equal rows in an order, so that many of them can be cut apart
    own = ("doc_id", *carry)
    blocks = _climbed(numbered(rows, ["doc_id", "digest", "row"]), own)
    subroots = blocks.where("block = 0").select(F.lit(0).alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest"))
    tops = stored(_members(_climbed(numbered(subroots, ["source"]), ["source"])).select(
        F.col("source").alias("top_source"), F.col("path").alias("top_path"), F.col("root").alias("top_root"),
    ))
    if tops.count() <= BROADCAST_TREES:
        tops = F.broadcast(tops)
    joined = blocks.join(tops, F.col("tree").eqNullSafe(F.col("top_source"))).withColumn("above", F.concat("above", "top_path"))
    joined = joined.withColumn("root", F.struct(F.col("root").alias("sub"), F.col("top_root").alias("top")))
    return _members(joined).select(*own, F.col("digest").alias("leaf"), F.col("root.sub").alias("subroot"), F.col("root.top").alias("root"), "path")
