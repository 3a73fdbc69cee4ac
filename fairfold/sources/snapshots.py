"""Immutable snapshots of tables, stored once per content and listed newest first."""

from __future__ import annotations

import datetime
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairfold import fixed
from fairfold.functions.scalars import logical_type
from fairfold.operators.fingerprint import content_fingerprint
from fairfold.spec import RefusedError

CARD = "dataset_id string, name string, fingerprint string, row_count long, columns array<string>, created_at string"


def check_admissible(df: DataFrame, row_id: str) -> list[str]:
    columns = [c for c in df.columns if c != row_id]
    if len(columns) < 2:
        raise RefusedError("table_too_narrow", str(len(columns)))
    for f in df.schema:
        if logical_type(f.dataType) is None:
            raise RefusedError("package_unsupported_dtype", f.name)
    return columns


def cards(spark: SparkSession, root: str) -> DataFrame:
    """Readable cards, newest first; a corrupted card is skipped, not fatal."""
    try:
        raw = spark.read.schema(CARD + ", _corrupt_record string").option("mode", "PERMISSIVE").json(f"{root}/cards")
    except AnalysisException:
        return spark.createDataFrame([], CARD)
    return raw.filter("_corrupt_record is null and dataset_id is not null").drop("_corrupt_record").orderBy(F.desc("created_at"), "dataset_id")


def store(df: DataFrame, root: str, name: str, *, row_id: str = fixed.RESERVED_ROW_ID) -> dict:
    """Write the table unless one with the same content is there already; returns its card."""
    spark = df.sparkSession
    columns = check_admissible(df, row_id)
    fingerprint = content_fingerprint(df, row_id).first()["fingerprint"]
    known = cards(spark, root).filter(F.col("fingerprint") == fingerprint).limit(1).collect()
    if known:
        return known[0].asDict() | {"stored": False}
    rows = df.count()
    if rows < 2:
        raise RefusedError("table_too_short", str(rows))
    dataset_id = f"ds_{uuid.uuid4().hex[:16]}"
    df.write.option("compression", "zstd").parquet(f"{root}/data/{dataset_id}")
    card = {
        "dataset_id": dataset_id, "name": name, "fingerprint": fingerprint, "row_count": rows, "columns": columns,
        "created_at": datetime.datetime.now(datetime.timezone.utc).isoformat(),
    }
    spark.createDataFrame([tuple(card.values())], CARD).coalesce(1).write.mode("append").json(f"{root}/cards")
    return card | {"stored": True}


def load(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    if not cards(spark, root).filter(F.col("dataset_id") == dataset_id).limit(1).count():
        raise RefusedError("dataset_unknown", dataset_id)
    return spark.read.parquet(f"{root}/data/{dataset_id}")


def new_only(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming cards whose content is not known yet; among equal ones the earliest stays."""
    order = Window.partitionBy("fingerprint").orderBy("created_at", "dataset_id")
    fresh = incoming.join(known.select("fingerprint"), "fingerprint", "left_anti")
    return fresh.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
