"""Everything that can be said about a task before any model is fitted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fairfold.operators import folds, leakage, profile, protocol, readiness, task
from fairfold.session import ensure_checkpoint_dir
from fairfold.spec import Protocol, RefusedError, TaskSpec


@dataclass(frozen=True)
class Analysis:
    spec: TaskSpec
    protocol: Protocol
    assignments: DataFrame
    leakage: DataFrame
    readiness: DataFrame

    def summary(self, spark: SparkSession) -> DataFrame:
        rows = [
            ("task_type", self.spec.task_type), ("splitter", self.protocol.splitter),
            ("n_splits", str(self.protocol.n_splits)),
            ("risk", leakage.risk(self.leakage).first()["risk"]),
            ("status", readiness.status(self.readiness).first()["status"]),
        ]
        return spark.createDataFrame(rows, "item string, value string")


def analyze_task(
    df: DataFrame, target: str, *, row_id: str, group: str | None = None, time: str | None = None,
    positive: str | None = None, n_splits: int = 5, holdout_size: float = 0.2, seed: int = 42,
) -> Analysis:
    """Task proposal, protocol, assigned rows, leakage and readiness; nothing is fitted.

    The assigned table is read by several checks, so it is cut from its lineage once: ``checkpoint``
    writes it to the cluster's shared folder, where it survives a lost executor.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if target not in df.columns:
        raise RefusedError("unknown_column", target)
    # the one pass with distinct counts; everything below reads these numbers
    _, stats, _ = profile.column_stats(df, [c for c in df.columns if c != row_id])
    proposal = task.propose_task(df, target, row_id=row_id, stats=stats)
    spec = TaskSpec(
        target, proposal.task_type, proposal.features, proposal.labels, positive or proposal.positive, group, time, row_id
    )
    # with a partly unknown target the rule needs the numbers of the usable rows instead
    known = None if stats[target].missing else (stats[target].rows, stats)
    chosen = protocol.recommend(
        df, spec, n_splits=n_splits, holdout_size=holdout_size, seed=seed, feature_stats=known
    )
    keep = tuple(dict.fromkeys([*spec.features, target, *(c for c in (group, time) if c)]))
    assigned = folds.assign(df, spec, chosen, keep=keep).checkpoint()
    leaks = leakage.inspect(assigned, spec, chosen).checkpoint()  # a few rows, read by three reports
    ready = readiness.assess(df, spec, chosen, leaks, stats=stats)
    return Analysis(spec, chosen, assigned, leaks, ready)
