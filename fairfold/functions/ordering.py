"""Reproducible pseudo-random order: the same row gets the same place on any cluster layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int, salt: str, key: Column) -> Column:
    """``md5(seed:salt:key)``; any SQL engine can recompute it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), key.cast("string")))
