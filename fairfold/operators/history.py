"""Finished runs: cards, and what makes two runs comparable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairfold import fixed
from fairfold.spec import RefusedError

CONDITIONS = (
    "dataset_fingerprint", "target_column", "task_type", "feature_columns", "fold_assignment_hash", "seed",
)
STATES = ("SUCCEEDED", "FAILED", "SKIPPED", "CANCELLED")


def describe_runs(runs: DataFrame, run_contenders: DataFrame) -> DataFrame:
    """Newest first: planned and finished contenders and the run's duration in seconds."""
    counts = run_contenders.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("planned"),
        *[F.count_if(F.col("state") == s).alias(s.lower()) for s in STATES],
    )
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = (micros("finished_at") - micros("started_at")) / F.lit(1_000_000.0)
    return (
        runs.join(counts, "run_id", "left")
        .na.fill(0, ["planned", *[s.lower() for s in STATES]])
        .withColumn("runtime_seconds", F.round(seconds, 3))
        .orderBy(F.desc("created_at"), "run_id")
    )


def compare_runs(runs: DataFrame, run_ids: list[str]) -> DataFrame:
    """Conditions in which 2..6 chosen runs differ, with each run's value; no row means comparable."""
    if not fixed.COMPARE_MIN_RUNS <= len(set(run_ids)) <= fixed.COMPARE_MAX_RUNS:
        raise RefusedError("compare_needs_2_to_6_runs", str(len(run_ids)))
    picked = runs.filter(F.col("run_id").isin(*run_ids))
    unknown = set(run_ids) - {r["run_id"] for r in picked.select("run_id").distinct().collect()}
    if unknown:
        raise RefusedError("unknown_run", ",".join(sorted(unknown)))
    text = lambda c: F.to_json(c) if dict(runs.dtypes)[c].startswith("array") else F.col(c).cast("string")
    values = picked.select(
        "run_id", F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), text(c).alias("value")) for c in CONDITIONS])).alias("x")
    )
    # at most six runs per condition
    return (
        values.groupBy("x.condition")
        .agg(
            F.count_distinct(F.struct("x.value")).alias("variants"),
            F.sort_array(F.collect_list(F.struct("run_id", F.col("x.value").alias("value")))).alias("values"),
        )
        .filter("variants > 1")
    )
