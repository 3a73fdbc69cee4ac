"""Row identity: the 0-based storage position, stable under re-execution."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairfold.operators.ranking import bounded_broadcast
from fairfold.session import spread
from fairfold.spec import RefusedError


def _plain(path: str) -> str:
    return re.sub(r"^\w+:/+", "/", path).rstrip("/")


def with_row_id(spark: SparkSession, files: list[str], out: str = "row_id") -> DataFrame:
    """Parquet files in the declared order, numbered by file offset plus position inside the file.

    ``_metadata.row_index`` comes from the reader itself, so a recomputed task numbers its rows the
    same way.  The offsets are counted once, one number per file (a list the driver holds anyway);
    a table of one file needs none.
    """
    df = spark.read.parquet(*files)
    physical = df.inputFiles()
    numbered = df.select("*", F.col("_metadata.row_index").alias(out))
    if len(physical) <= 1:
        return spread(numbered)
    place = F.col("_metadata.file_path").alias("__file")
    counts = {r["__file"]: r["n"] for r in df.select(place).groupBy("__file").agg(F.count(F.lit(1)).alias("n")).collect()}
    declared = [_plain(path) for path in files]

    def position(name: str) -> tuple[int, str]:
        """Index of the declared path (a file or a folder of files) and the name inside it."""
        plain = _plain(unquote(name))
        for i, path in enumerate(declared):
            if plain.endswith(path) or f"{path}/" in plain:
                return i, plain
        raise RefusedError("undeclared_part", name)

    offsets, before = [], 0
    for name in sorted(counts, key=position):
        offsets.append((name, before))
        before += counts[name]
    table = spark.createDataFrame(offsets, "__file string, __offset long")
    data = spread(df.select("*", place, F.col("_metadata.row_index").alias("__pos")))
    joined = data.join(bounded_broadcast(table, len(offsets)), "__file")
    return joined.withColumn(out, F.col("__offset") + F.col("__pos")).drop("__file", "__pos", "__offset")
