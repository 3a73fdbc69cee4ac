"""Words, hashes, stored tables and other helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairfold.session import ensure_checkpoint_dir

SPACE = r"[\x20\x09-\x0D]"
# lower-cases A-Z and turns every other ASCII character except digits and a-z into a space
ALPHANUMERIC = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F else 0x20 for c in range(256)
)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def space_words(text: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space (``[^\\x20\\x09-\\x0D]+``), unchanged."""
    return text.split()


def alphanumeric_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of digits, ASCII letters and non-ASCII characters."""
    return text.translate(ALPHANUMERIC).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit integers over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` words (none when there are fewer)."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(width))
    for j in range(width):
        out = out * _ODD + hashes[j : n + j]
    return mixed(out)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, strings as UTF-8 bytes (NULL stays None)."""
    for batch in batches:
        columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in batch.columns]
        for begin in range(0, batch.num_rows, 256):  # few Python copies of long texts at a time
            yield from zip(*(c.slice(begin, 256).to_pylist() for c in columns), strict=True)


def run_id(number: int, content: bytes) -> int:
    """Positive id of the ``number``-th run that a task packs: equal runs of two tasks differ, a repeated task gives the same ids."""
    return xxhash.xxh64_intdigest(b"%d/%d/" % (TaskContext.get().partitionId(), number) + content) >> 1


def starts_of_runs(values: np.ndarray) -> np.ndarray:
    """True where a sorted array takes a new value."""
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return first


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Cut the lineage with a table below the shared checkpoint folder."""
    return stored_at(df, compression)[0]


def stored_at(df: DataFrame, compression: str | None = None) -> tuple[DataFrame, str]:
    """A stored table and its path, for ``removed`` as soon as nothing reads it any more."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/fairfold-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a job shuffled goes when it ends: a written table stands for it."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored_at`` wrote."""
    if "/fairfold-" not in path:
        raise ValueError(f"not a stored table: {path}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, made longer until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


# rows of a few longs; beyond that the join shuffles both sides
BROADCAST_ROWS = 1_000_000


def matching(df: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a stored table of narrow rows: broadcast up to BROADCAST_ROWS of them, by shuffle beyond."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


def plain_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
