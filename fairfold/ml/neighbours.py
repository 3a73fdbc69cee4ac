"""Exact nearest neighbours by metric pruning, as two rounds of joins with blocks of training rows.

Training rows belong to the cell of their nearest pivot; a cell is cut into blocks by the distance to its
pivot.  Distances to the pivots bound from below how near a block's rows can be.  A query first visits the
blocks at its nearest pivots, which gives it a distance its k nearest lie within, then every other block
that this distance does not rule out.  For these visits queries go in groups to bundles of blocks: a vector
is sent once for megabytes of rows, not once for each block.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairfold.session import ensure_checkpoint_dir
from fairfold.spec import RefusedError

MAX_PIVOTS = 512
BLOCK_BYTES = 2 << 20  # of a block's vectors
MAX_BLOCKS = 200_000  # beyond, blocks grow with the table; the list of blocks is 32 bytes each on driver and executors
QUERIES_A_TASK = 20_000  # a block that more queries visit is sent to several tasks; queries of one group
GROUP_BYTES = 8 << 20  # of a group's vectors, and of the blocks in a bundle
MAX_TASKS = 10_000  # of the second round; beyond, a task takes several groups and bundles
CELLS = 4_000_000  # numbers in one piece of a matrix of distances
SLACK = 1e-9  # rounding of bounds

_BLOCK = {
    "cell": T.IntegerType(), "lo": T.DoubleType(), "hi": T.DoubleType(), "n": T.LongType(),
    "labels": T.ArrayType(T.DoubleType()), "body": T.BinaryType(),
}

_GROUP = pa.schema([
    ("group", pa.int64()), ("qids", pa.list_(pa.int64())), ("most", pa.list_(pa.float64())), ("body", pa.binary()),
    ("bundles", pa.list_(pa.struct([("bundle", pa.int32()), ("blocks", pa.list_(pa.int64())), ("visits", pa.binary())]))),
])
_GROUP_SCHEMA = "group long, qids array<long>, most array<double>, body binary, bundles array<struct<bundle:int, blocks:array<long>, visits:binary>>"


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(rows, -1) if rows else np.zeros((0, 1))


def _distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances by differences: equal rows give equal values, whatever stands beside them."""
    out = np.empty((len(points), len(others)))
    step = max(1, CELLS // max(1, others.size))
    for lo in range(0, len(points), step):
        out[lo : lo + step] = ((points[lo : lo + step, None, :] - others[None, :, :]) ** 2).sum(axis=2)
    return out


def _in_cells(pivots: np.ndarray):
    def assign(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            x = _matrix(batch["x"])
            cell, near = np.zeros(len(x), np.int32), np.zeros(len(x))
            step = max(1, CELLS // len(pivots))
            for lo in range(0, len(x), step):
                d = _distances(x[lo : lo + step], pivots)
                cell[lo : lo + step] = d.argmin(axis=1)
                near[lo : lo + step] = np.sqrt(d.min(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near)], [*batch.schema.names, "cell", "near"])

    return assign


def _packed(k: int, size: int):
    """Rows sorted by cell, distance, vector and row id as blocks of at most ``size`` rows of one cell.

    Of equal vectors the ``k`` with the smallest row ids are enough for any query.
    """

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        near, ids = rows["near"].to_numpy(), rows["row_id"].combine_chunks()
        one = [pa.array([rows["cell"][0].as_py()], pa.int32()), pa.array([near.min()]), pa.array([near.max()]), pa.array([len(rows)], pa.int64())]
        labels = pa.ListArray.from_arrays([0, len(rows)], rows["label"].combine_chunks().cast(pa.float64()))
        body = pa.array([_matrix(rows["x"].combine_chunks()).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([*one, labels, body, pa.ListArray.from_arrays([0, len(rows)], ids)], ["cell", "lo", "hi", "n", "labels", "body", "row_ids"])

    def pack(batches: Iterable[pa.RecordBatch]):
        held, last, run = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["x"])
            new = np.append(last is None or not np.array_equal(x[0], last), (x[1:] != x[:-1]).any(axis=1))
            at = np.arange(len(x))
            place = at - np.maximum.accumulate(np.where(new, at, -run))
            last, run = x[-1], int(place[-1]) + 1
            rows = pa.Table.from_batches([batch]).filter(pa.array(place < k))
            held = rows if held is None else pa.concat_tables([held, rows])
            while len(held):
                cells = held["cell"].to_numpy()
                own = int(np.searchsorted(cells, cells[0], "right"))
                if own == len(held) and own <= size:
                    break
                yield block(held.slice(0, min(own, size)))
                held = held.slice(min(own, size))
        if held is not None and len(held):
            yield block(held)

    return pack


class Neighbours:
    """An index over ``row_id, label, x``: pivots, blocks (a table), and the list of blocks."""

    def __init__(self, pivots: np.ndarray, blocks: DataFrame, k: int) -> None:
        self.pivots, self.blocks, self.k = pivots, blocks, k
        listed = blocks.select("block", "cell", "lo", "hi", "n").toPandas().sort_values("block")  # at most MAX_BLOCKS, and one a cell and task
        self.listed = {c: listed[c].to_numpy() for c in listed.columns}
        self.rows = int(self.listed["n"].sum())

    @classmethod
    def build(cls, train: DataFrame, k: int) -> Neighbours:
        """Index all rows of ``train``; answers queries for up to ``k`` neighbours.  Row ids are unique and order equal distances."""
        spark = train.sparkSession
        ensure_checkpoint_dir(spark)
        train = train.select("row_id", "label", F.col("x").cast("array<double>").alias("x"))
        n = train.count()
        if not n:
            raise RefusedError("fit_failed", "no training rows")
        count = min(MAX_PIVOTS, max(1, int(n**0.5)))
        # a bounded number of rows in an order that has nothing to do with their values
        pivots = np.array([r["x"] for r in train.orderBy(F.xxhash64(F.col("row_id").cast("string")), "row_id").limit(count).select("x").collect()], float)
        pivots = np.unique(pivots, axis=0)
        size = max(k, BLOCK_BYTES // (8 * max(1, pivots.shape[1])), -(-n // MAX_BLOCKS))
        id_type = train.schema["row_id"].dataType
        sketch = T.StructType([*train.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())])
        # by range: a cell of many rows goes to several tasks
        order = ("cell", "near", F.xxhash64("x"), "row_id")
        cells = train.mapInArrow(_in_cells(pivots), sketch).repartitionByRange(*order).sortWithinPartitions(*order)
        schema = T.StructType([T.StructField(c, t) for c, t in {**_BLOCK, "row_ids": T.ArrayType(id_type)}.items()])
        return cls(pivots, cells.mapInArrow(_packed(k, size), schema).withColumn("block", F.monotonically_increasing_id()).checkpoint(), k)

    def save(self, folder: str) -> None:
        self.blocks.write.mode("overwrite").parquet(f"{folder}/blocks")
        pivots = [(i, [float(v) for v in p], self.k) for i, p in enumerate(self.pivots)]
        self.blocks.sparkSession.createDataFrame(pivots, "i int, x array<double>, k int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/pivots")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Neighbours:
        rows = spark.read.parquet(f"{folder}/pivots").orderBy("i").collect()
        return cls(np.array([r["x"] for r in rows], float), spark.read.parquet(f"{folder}/blocks"), rows[0]["k"])

    def search(self, queries: DataFrame) -> DataFrame:
        """``qid, near`` for queries (qid, x): the nearest rows as structs (distance, row_id, label), squared distances.

        Exact: ordered by distance and row id, as many as the index was built for or has rows.  ``queries``
        must give the same rows each time it is read.
        """
        k = self.k
        queries = queries.select(F.col("qid").cast("long").alias("qid"), F.col("x").cast("array<double>").alias("x"))
        first = self._visit(queries.mapInArrow(self._asked(False), "qid long, block long").withColumn("most", F.lit(float("inf"))), queries)
        first = _nearest(first, k).checkpoint()
        # rows beyond the k-th of the first visit are not among the nearest; with fewer than k rows in all every block is visited
        most = first.select("qid", F.coalesce(F.get("near", F.lit(k - 1))["distance"], F.lit(float("inf"))).alias("most"))
        second = self._visit_together(queries.join(most, "qid"))
        return _nearest(first.select("qid", F.inline("near")).unionByName(second), k)

    def _visits(self, rest: bool):
        """For vectors and their ``most``: which blocks a query visits first, or all others that may hold a row within ``most``."""
        pivots, k = self.pivots, self.k
        cell, lo, hi, n = (self.listed[c] for c in ("cell", "lo", "hi", "n"))

        def visits(x: np.ndarray, most: np.ndarray | None) -> np.ndarray:
            to = np.sqrt(_distances(x, pivots))
            own = to[:, cell]
            key = own + np.abs(own - (lo + hi) / 2)
            few = min(k, len(cell))
            at = np.argpartition(key, few - 1, axis=1)[:, :few]
            at = np.take_along_axis(at, np.take_along_axis(key, at, axis=1).argsort(axis=1, kind="stable"), axis=1)
            before = np.cumsum(n[at], axis=1) - n[at]
            visited = np.zeros(own.shape, bool)
            np.put_along_axis(visited, at, before < k, axis=1)
            if rest:
                # triangle inequality at the block's pivot, and: its rows are nearer to that pivot than to the query's
                bound = np.maximum(np.maximum(own - hi, lo - own), (own - to.min(axis=1)[:, None]) / 2)
                visited = ~visited & (bound <= np.sqrt(most)[:, None] * (1 + SLACK) + SLACK * (own + hi))
            return visited

        return visits

    def _asked(self, rest: bool):
        """``qid, block`` and, with ``rest``, ``most`` of all visits."""
        visits, block = self._visits(rest), self.listed["block"]

        def asked(batches: Iterable[pa.RecordBatch]):
            step = max(1, CELLS // max(1, len(block)))
            for whole in batches:
                for begin in range(0, whole.num_rows, step):
                    batch = whole.slice(begin, step)
                    most = batch["most"].to_numpy() if rest else None
                    q, b = np.nonzero(visits(_matrix(batch["x"]), most))
                    out = [batch["qid"].take(pa.array(q)), pa.array(block[b])]
                    yield pa.RecordBatch.from_arrays(out + [pa.array(most[q])], ["qid", "block", "most"]) if rest else pa.RecordBatch.from_arrays(out, ["qid", "block"])

        return asked

    def _groups(self):
        """Queries sorted by cell as groups: their vectors, and by bundle the blocks that any of them visits, with a bit for each visit."""
        visits, block, n = self._visits(True), self.listed["block"], self.listed["n"]
        width = 8 * self.pivots.shape[1]
        step = max(1, CELLS // max(1, len(block)))
        size = max(1, min(QUERIES_A_TASK, GROUP_BYTES // width, 16 * step))  # the visits of a group are held as a matrix
        cuts = np.flatnonzero(np.diff((np.cumsum(n) - n) * width // GROUP_BYTES, prepend=-1)).tolist()
        bundles = list(enumerate(zip(cuts, [*cuts[1:], len(block)], strict=True)))

        def group(rows: pa.Table, number: int) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            x, most = _matrix(rows["x"].combine_chunks()), rows["most"].to_numpy()
            visited = np.concatenate([visits(x[at : at + step], most[at : at + step]) for at in range(0, len(x), step)])
            used = []
            for bundle, (begin, end) in bundles:
                some = begin + np.flatnonzero(visited[:, begin:end].any(axis=0))
                if len(some):
                    used.append({"bundle": bundle, "blocks": block[some].tolist(), "visits": np.packbits(visited[:, some]).tobytes()})
            columns = [[TaskContext.get().partitionId() << 32 | number], [rows["qid"].to_pylist()], [most.tolist()], [x.tobytes()], [used]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _GROUP.types, strict=True)], _GROUP.names)

        def groups(batches: Iterable[pa.RecordBatch]):
            held, number = None, 0
            for batch in batches:
                rows = pa.Table.from_batches([batch]).select(["qid", "x", "most"])
                held = rows if held is None else pa.concat_tables([held, rows])
                while len(held) >= size:
                    yield group(held.slice(0, size), number)
                    held, number = held.slice(size), number + 1
            if held is not None and len(held):
                yield group(held, number)

        return groups

    def _visit_together(self, queries: DataFrame) -> DataFrame:
        """``qid, distance, row_id, label`` for queries (qid, x, most): of all blocks but those visited first, the k nearest rows within ``most`` by bundle."""
        sketch = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())])
        # by range, so that the queries of a group are near each other and visit the same blocks
        order = ("cell", "near", "qid")
        sorted_queries = queries.mapInArrow(_in_cells(self.pivots), sketch).repartitionByRange(*order).sortWithinPartitions(*order)
        groups = sorted_queries.mapInArrow(self._groups(), _GROUP_SCHEMA).checkpoint()
        tasks = groups.agg(F.sum(F.size("bundles"))).first()[0] or 1
        id_type = self.blocks.schema["row_ids"].dataType
        asked = groups.withColumn("b", F.explode("bundles")).select(
            "group", "b.bundle", F.lit(None).cast("long").alias("block"), "qids", "most", "body", "b.blocks", "b.visits",
            F.lit(None).cast("array<double>").alias("labels"), F.lit(None).cast(id_type).alias("row_ids"),
        )
        wanted = groups.select("group", F.explode("bundles").alias("b")).select("group", "b.bundle", F.explode("b.blocks").alias("block"))
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("qids", "array<long>"), ("most", "array<double>"), ("blocks", "array<long>"), ("visits", "binary"))]
        blocks = self.blocks.join(wanted, "block").select("group", "bundle", "block", *nothing, "body", "labels", "row_ids")
        together = asked.unionByName(blocks).repartition(min(tasks, MAX_TASKS), "group", "bundle")
        together = together.sortWithinPartitions("group", "bundle", F.col("block").asc_nulls_first())
        return together.mapInArrow(_met(self.k), _found(id_type.elementType))

    def _visit(self, asked: DataFrame, queries: DataFrame) -> DataFrame:
        """``qid, distance, row_id, label``: of each visited block the k nearest rows within ``most``."""
        asked = asked.checkpoint()  # three numbers a visit
        load = asked.groupBy("block").agg(F.ceil(F.count("*") / QUERIES_A_TASK).cast("int").alias("parts"))
        load = F.broadcast(load)  # at most the list of blocks
        id_type = self.blocks.schema["row_ids"].dataType
        visits = asked.join(load, "block").join(queries, "qid").select(
            "block", F.pmod(F.xxhash64("qid"), "parts").cast("int").alias("part"), "qid", "most", "x",
            F.lit(None).cast("binary").alias("body"), F.lit(None).cast("array<double>").alias("labels"), F.lit(None).cast(id_type).alias("row_ids"),
        )
        blocks = self.blocks.join(load, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
            "block", "part", F.lit(None).cast("long").alias("qid"), F.lit(None).cast("double").alias("most"), F.lit(None).cast("array<double>").alias("x"), "body", "labels", "row_ids",
        )
        together = visits.unionByName(blocks).repartition("block", "part").sortWithinPartitions("block", "part", F.col("qid").asc_nulls_first())
        return together.mapInArrow(_compared(self.k), _found(id_type.elementType))


def _compared(k: int):
    """A block's row comes first, the queries that visit it follow and stream by."""

    def compared(batches: Iterable[pa.RecordBatch]):
        rows = labels = ids = rank = None
        for batch in batches:
            is_block = np.flatnonzero(batch["body"].is_valid().to_numpy(zero_copy_only=False)).tolist()
            edges = [0, *is_block, batch.num_rows]
            for i in range(len(edges) - 1):
                begin, end = edges[i], edges[i + 1]
                if i:  # the piece starts with a block
                    labels, ids = batch["labels"][begin].values, batch["row_ids"][begin].values
                    rows = np.frombuffer(batch["body"][begin].as_py()).reshape(len(labels), -1)
                    rank = np.empty(len(labels), np.int64)
                    rank[pa.compute.array_sort_indices(ids).to_numpy()] = np.arange(len(labels))
                    begin += 1
                step = max(1, CELLS // max(1, rows.size if rows is not None else 1))
                for lo in range(begin, end, step):
                    some = batch.slice(lo, min(step, end - lo))
                    d = _distances(_matrix(some["x"]), rows)
                    most = some["most"].to_numpy()
                    at, of = [], []
                    for q in range(len(d)):
                        limit = min(most[q], np.partition(d[q], k - 1)[k - 1]) if k <= d.shape[1] else most[q]
                        near = np.flatnonzero(d[q] <= limit)
                        near = near[np.lexsort((rank[near], d[q][near]))][:k]
                        at.append(near)
                        of.append(np.full(len(near), q))
                    at, of = np.concatenate(at), np.concatenate(of)
                    yield pa.RecordBatch.from_arrays([some["qid"].take(pa.array(of)), pa.array(d[of, at]), ids.take(pa.array(at)), labels.take(pa.array(at))], ["qid", "distance", "row_id", "label"])

    return compared


def _within(x: np.ndarray, most: np.ndarray, rows: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of queries and rows and their distances: for each query its ``k`` nearest rows within ``most``.

    A matrix product leaves out what is too far whatever its rounding; the others are measured by differences.
    """
    found = []
    own = (rows * rows).sum(axis=1)
    step, pairs = max(1, CELLS // max(1, len(rows))), max(1, CELLS // max(1, rows.shape[1]))
    for lo in range(0, len(x), step):
        some, limit = x[lo : lo + step], most[lo : lo + step]
        square = (some * some).sum(axis=1)[:, None] + own
        q, r = np.nonzero(~(square - 2 * (some @ rows.T) > limit[:, None] + SLACK * square))
        d = np.concatenate([np.empty(0), *(((some[q[at : at + pairs]] - rows[r[at : at + pairs]]) ** 2).sum(axis=1) for at in range(0, len(q), pairs))])
        near = d <= limit[q]
        q, r, d = q[near], r[near], d[near]
        at = np.lexsort((rank[r], d, q))
        q, r, d = q[at], r[at], d[at]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((q[first] + lo, r[first], d[first]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _met(k: int):
    """A group of queries comes first, the blocks of a bundle that they visit follow and stream by."""

    class Met:
        def __init__(self, batch: pa.RecordBatch, at: int) -> None:
            self.qids = batch["qids"][at].values
            self.most = batch["most"][at].values.to_numpy().copy()
            self.x = np.frombuffer(batch["body"][at].as_py()).reshape(len(self.qids), -1)
            self.column = {b: i for i, b in enumerate(batch["blocks"][at].as_py())}
            bits = np.frombuffer(batch["visits"][at].as_py(), np.uint8)
            self.visits = np.unpackbits(bits, count=len(self.qids) * len(self.column)).reshape(len(self.qids), -1).astype(bool)
            self.rows: list[tuple[pa.Array, pa.Array]] = []
            self.found = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)]  # query, distance, block, row
            self.new = 0

        def visit(self, batch: pa.RecordBatch, at: int) -> None:
            labels, ids = batch["labels"][at].values, batch["row_ids"][at].values
            rows = np.frombuffer(batch["body"][at].as_py()).reshape(len(labels), -1)
            rank = np.empty(len(labels), np.int64)
            rank[pa.compute.array_sort_indices(ids).to_numpy()] = np.arange(len(labels))
            some = np.flatnonzero(self.visits[:, self.column[batch["block"][at].as_py()]])
            q, r, d = _within(self.x[some], self.most[some], rows, rank, k)
            self.found = [np.concatenate(c) for c in zip(self.found, (some[q], d, np.full(len(q), len(self.rows)), r), strict=True)]
            self.rows.append((ids, labels))
            self.new += len(q)
            if self.new > len(self.qids):
                self.trim()

        def trim(self) -> None:
            """Rows beyond a query's k-th are not among the nearest; rows as far as the k-th all stay."""
            at = np.lexsort((self.found[1], self.found[0]))
            q, d = self.found[0][at], self.found[1][at]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == k - 1
            self.most[q[last]] = np.minimum(self.most[q[last]], d[last])
            self.found = [c[at][d <= self.most[q]] for c in self.found]
            self.new = 0

        def nearest(self) -> Iterable[pa.RecordBatch]:
            self.trim()
            q, d, block, row = self.found
            for number in np.unique(block).tolist():
                some = np.flatnonzero(block == number)
                ids, labels = (c.take(pa.array(row[some])) for c in self.rows[number])
                yield pa.RecordBatch.from_arrays([self.qids.take(pa.array(q[some])), pa.array(d[some]), ids, labels], ["qid", "distance", "row_id", "label"])

    def met(batches: Iterable[pa.RecordBatch]):
        group = None
        for batch in batches:
            for at, starts in enumerate(batch["qids"].is_valid().to_pylist()):
                if not starts:
                    group.visit(batch, at)
                    continue
                if group is not None:
                    yield from group.nearest()
                group = Met(batch, at)
        if group is not None:
            yield from group.nearest()

    return met


def _found(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("qid", T.LongType()), T.StructField("distance", T.DoubleType()), T.StructField("row_id", id_type), T.StructField("label", T.DoubleType())])


def _nearest(found: DataFrame, k: int) -> DataFrame:
    return found.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "row_id", "label"))), 1, k).alias("near"))
