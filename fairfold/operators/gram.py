"""Pairwise correlations of many columns in one scan: sums over all pairs as matrices, added up row by row of the matrix."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = ("n", "x", "y", "xx", "yy", "xy", "bad")
BATCH = 4096  # rows multiplied at once
SHIFT_ROWS = 100  # rows whose means are subtracted; they decide rounding errors only
CONSTANT = 1e-12  # a variance below this share of the squares is rounding

_ROW = "i int, " + ", ".join(f"{s} array<double>" for s in SUMS)


def _sums(shift: np.ndarray):
    """One task's sums: for column i, over the rows where i and j are both known, an entry for every j > i."""

    def sums(batches: Iterable[pa.RecordBatch]):
        c = len(shift)
        total = {s: np.zeros((c, c)) for s in SUMS}
        seen = False
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                batch, seen = whole.slice(lo, BATCH), True
                raw = np.stack([column.to_numpy(zero_copy_only=False).astype(float) for column in batch.columns], axis=1)
                known = np.stack([column.is_valid().to_numpy(zero_copy_only=False) for column in batch.columns], axis=1)
                odd = known & ~np.isfinite(raw)
                x = np.where(known & ~odd, raw - shift, 0.0)
                m, odd = known.astype(float), odd.astype(float)
                one, two = x.T @ m, (x * x).T @ m
                for s, part in (("n", m.T @ m), ("x", one), ("y", one.T), ("xx", two), ("yy", two.T), ("xy", x.T @ x), ("bad", odd.T @ m + m.T @ odd)):
                    total[s] += part
        if seen:
            for i in range(c - 1):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([total[s][i, i + 1 :]]) for s in SUMS)], ["i", *SUMS])

    return sums


def _strong(columns: list[str], limit: float):
    """Rows sorted by i, added up: the pairs with a strong correlation."""

    def pairs(i: int, n, x, y, xx, yy, xy, bad):
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy = xx - x * x / n, yy - y * y / n
            r = (xy - x * y / n) / np.sqrt(vx * vy)
        usable = (bad == 0) & (n > 1) & (vx > CONSTANT * xx) & (vy > CONSTANT * yy)
        at = np.flatnonzero(usable & (np.abs(np.where(usable, r, 0.0)) >= limit))
        out = [pa.array([columns[i]] * len(at), pa.string()), pa.array([columns[i + 1 + j] for j in at], pa.string()), pa.array(np.clip(r[at], -1, 1).round(4))]
        return pa.RecordBatch.from_arrays(out, ["first", "second", "correlation"])

    def strong(batches: Iterable[pa.RecordBatch]):
        at, total = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                i = batch["i"][row].as_py()
                own = [batch[s][row].values.to_numpy() for s in SUMS]
                if i != at:
                    if at is not None:
                        yield pairs(at, *total)
                    at, total = i, [o.copy() for o in own]
                else:
                    for t, o in zip(total, own, strict=True):
                        t += o
        if at is not None:
            yield pairs(at, *total)

    return strong


def strong_correlations(df: DataFrame, columns: list[str], limit: float) -> DataFrame:
    """``first, second, correlation`` of pairs of columns whose Pearson correlation is at least ``limit``, over rows where both are known.

    One scan, whatever the number of columns: a task holds seven numbers a pair and sends them once.  A pair
    with a value that is not finite, with fewer than two rows or with a constant side has no correlation.
    """
    schema = "first string, second string, correlation double"
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], schema)
    cells = df.select(*[F.col(f"`{c.replace('`', '``')}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    finite = [F.avg(F.when(~F.isnan(f"c{i}") & (F.abs(f"c{i}") != float("inf")), F.col(f"c{i}"))) for i in range(len(columns))]
    shift = np.array([float(v or 0) for v in cells.limit(SHIFT_ROWS).agg(*finite).first()])
    sums = cells.mapInArrow(_sums(shift), _ROW)
    return sums.repartition("i").sortWithinPartitions("i").mapInArrow(_strong(list(columns), limit), schema)
