"""Content identity as a tree of SHA-256 digests.

Every row is hashed on its own, rows are combined per run of 65 536 row ids in id order, runs are
combined the same way, and so on: order-sensitive like a serial hash, but every group is bounded.
The algorithm has its own id; it is not the serial column-wise digest.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairfold import fixed
from fairfold.functions.scalars import NON_ASCII, dtype_of, logical_type, moment_micros, nfc, plain_decimal, plain_float
from fairfold.spec import Protocol, RefusedError

ALGORITHM = "row-tree-sha256-v1"


def _foreign_text(df: DataFrame, columns: list[str]) -> set[str]:
    """String columns with any non-ASCII cell; only those need Unicode normalisation."""
    texts = [c for c in columns if logical_type(dtype_of(df, c)) == "string"]
    if not texts:
        return set()
    checks = [F.coalesce(F.max(F.col(f"`{c}`").rlike(NON_ASCII)), F.lit(False)).alias(f"c{i}") for i, c in enumerate(texts)]
    row = df.agg(*checks).first()
    return {c for i, c in enumerate(texts) if row[f"c{i}"]}


def canonical_cell(df: DataFrame, name: str, *, ascii_only: bool = False) -> Column:
    """Text form of a cell that does not depend on the physical width, zero sign or time unit."""
    dtype, c = dtype_of(df, name), F.col(f"`{name}`")
    kind = logical_type(dtype)
    if kind is None:
        raise RefusedError("package_unsupported_dtype", f"{name}: {dtype.simpleString()}")
    if kind == "float":
        return plain_float(c).cast("string")
    if kind == "decimal":
        return plain_decimal(c)
    if kind == "date":
        return F.unix_date(c).cast("string")
    if kind == "datetime":
        return moment_micros(c, dtype).cast("string")
    if kind == "binary":
        return F.hex(c)
    if kind == "string":
        return c if ascii_only else nfc(c)
    return c.cast("string")


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 over length-prefixed cells; a missing cell differs from an empty one."""
    pieces = []
    foreign = _foreign_text(df, columns)
    for name in columns:
        text = canonical_cell(df, name, ascii_only=name not in foreign)
        pieces.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-;")))
    return F.sha2(F.concat(*pieces) if pieces else F.lit(""), 256)


def tree_root(rows: DataFrame, row_id: str, digest: Column, header: str, width: int = fixed.FINGERPRINT_CHUNK) -> DataFrame:
    """One row with the root digest over (row_id, digest)."""
    level = rows.select(F.col(row_id).cast("long").alias("i"), digest.alias("h"))
    # three levels of 65 536 cover 2.8e14 rows; no group is larger than ``width``
    for _ in range(3):
        level = (
            level.groupBy(F.floor(F.col("i") / F.lit(width)).cast("long").alias("i2"))
            .agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("x"))
            .select(
                F.col("i2").alias("i"),
                F.sha2(F.array_join(F.transform("x", lambda s: F.concat(s["i"].cast("string"), F.lit("="), s["h"])), "\n"), 256).alias("h"),
            )
        )
    root = level.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda s: s["h"]), "\n").alias("x"))
    return root.select(
        F.lit(ALGORITHM).alias("algorithm"), F.sha2(F.concat(F.lit(header + "\n"), F.col("x")), 256).alias("fingerprint")
    )


def content_fingerprint(df: DataFrame, row_id: str) -> DataFrame:
    """Identity of a table: column names, logical types, values and row order."""
    columns = [c for c in df.columns if c != row_id]
    header = json.dumps([(c, logical_type(dtype_of(df, c))) for c in columns], ensure_ascii=False)
    return tree_root(df, row_id, row_digest(df, columns), header)


def split_fingerprint(assignments: DataFrame, protocol: Protocol) -> DataFrame:
    """Identity of a split, including which side each chunk trains."""
    header = json.dumps([protocol.splitter, protocol.n_splits, protocol.forward])
    text = F.concat_ws("|", F.col("row_id"), F.col("part"), F.coalesce(F.col("chunk").cast("string"), F.lit("-")))
    return tree_root(assignments, "row_id", F.sha2(text, 256), header)


def condition_fingerprint(runs: DataFrame, conditions: list[str]) -> Column:
    """Identity of an experiment from its conditions, independent of their order; resources excluded."""
    ordered = sorted(conditions)
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in ordered]), {"ignoreNullFields": "false"}), 256)


__all__ = ["ALGORITHM", "canonical_cell", "content_fingerprint", "condition_fingerprint", "row_digest", "split_fingerprint", "tree_root"]
