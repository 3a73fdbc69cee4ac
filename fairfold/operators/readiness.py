"""Readiness: is an honest comparison possible at all with this table, task and protocol?

Every finding is a rule over a few counts, taken in a fixed number of aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairfold import fixed
from fairfold.operators.leakage import FINDING
from fairfold.operators.profile import ColumnStats, column_stats, duplicate_rows
from fairfold.operators.task import class_summary, effective_dimension, group_candidates, time_candidates
from fairfold.spec import Protocol, TaskSpec

GROUP_AWARE = ("group_k_fold", "stratified_group_k_fold")


def context_values(rows: int, missing_target: int, stats: dict[str, ColumnStats], protocol: Protocol) -> dict:
    usable = rows - missing_target
    held = round(usable * protocol.holdout_size)
    dimension = effective_dimension(stats)
    return {
        "total_rows": rows,
        "usable_rows": usable,
        "feature_count": len(stats),
        "effective_dimension": dimension,
        "rows_per_dimension": round(usable / dimension, 2) if dimension else 0.0,
        "n_splits": protocol.n_splits,
        "holdout_rows": held,
        "validation_rows_per_fold": round((usable - held) / protocol.n_splits) if protocol.n_splits else 0,
    }


def context(df: DataFrame, spec: TaskSpec, protocol: Protocol) -> DataFrame:
    rows, stats, extra = column_stats(df, spec.features, extra={"lost": F.count_if(F.col(spec.target).isNull())})
    values = context_values(rows, extra["lost"], stats, protocol)
    schema = (
        "total_rows long, usable_rows long, feature_count int, effective_dimension int, rows_per_dimension double, "
        "n_splits int, holdout_rows long, validation_rows_per_fold long"
    )
    return df.sparkSession.createDataFrame([tuple(values.values())], schema)


def _row(code, severity, scope, observed, blocking=False, columns=()):
    return (
        "readiness", code, severity, "none", scope, list(columns), {k: str(v) for k, v in observed.items()}, blocking, True,
    )


def _size(c: dict) -> list:
    found = []
    ratio, fold = c["rows_per_dimension"], c["validation_rows_per_fold"]
    if ratio < fixed.ROWS_PER_DIMENSION_COMFORTABLE:
        severity = "high_risk" if ratio < fixed.ROWS_PER_DIMENSION_CRITICAL else "caution"
        found.append(_row("sample_size_vs_dimension", severity, "dataset", {"rows_per_dimension": ratio}))
    if fold < fixed.FOLD_ROWS_CRITICAL:
        found.append(_row("validation_fold_too_small", "high_risk", "protocol", {"rows": fold}))
    elif fold < fixed.FOLD_ROWS_COMFORTABLE:
        found.append(_row("validation_fold_small", "caution", "protocol", {"rows": fold}))
    return found


def _target(df: DataFrame, spec: TaskSpec, protocol: Protocol, c: dict, moments: tuple) -> list:
    found = []
    lost = c["total_rows"] - c["usable_rows"]
    if lost:
        share = lost / c["total_rows"]
        severity = (
            "high_risk" if share >= fixed.TARGET_MISSING_HIGH
            else "caution" if share >= fixed.TARGET_MISSING_CAUTION else "info"
        )
        found.append(_row("target_missing_values", severity, "target", {"share": round(share, 4)}))
    if not spec.is_classification:
        mean, std = moments
        if c["usable_rows"] and not std:
            found.append(_row("regression_target_constant", "high_risk", "target", {"std": 0.0}, True))
        elif c["usable_rows"] and mean and abs(std / mean) < fixed.LOW_VARIANCE:
            found.append(_row("regression_target_low_variance", "caution", "target", {"relative": round(abs(std / mean), 5)}))
        return found
    summary = class_summary(df, spec.target).first()
    if not summary["classes"]:
        return found
    top, rare = summary["majority_rows"] / c["usable_rows"], summary["minority_rows"]
    if top >= fixed.IMBALANCE_HIGH:
        found.append(_row("target_almost_constant", "high_risk", "target", {"share": round(top, 4)}, True))
    elif top >= fixed.IMBALANCE_CAUTION:
        found.append(_row("target_imbalanced", "caution", "target", {"share": round(top, 4)}))
    per_fold = rare / protocol.n_splits if protocol.n_splits else 0
    if per_fold < 1:
        found.append(_row("minority_class_absent_in_folds", "high_risk", "target", {"rows": rare}, True))
    elif per_fold < fixed.MINORITY_PER_FOLD_RISKY:
        found.append(_row("minority_class_thin", "high_risk", "target", {"per_fold": round(per_fold, 2)}))
    elif per_fold < fixed.MINORITY_PER_FOLD_COMFORTABLE:
        found.append(_row("minority_class_small", "caution", "target", {"per_fold": round(per_fold, 2)}))
    return found


def _features(stats: dict[str, ColumnStats], spec: TaskSpec) -> list:
    found = []
    for s in stats.values():
        scope, at = f"column:{s.name}", (s.name,)
        if s.id_reason and s.name != spec.group:
            found.append(_row("identifier_used_as_feature", "high_risk", scope, {"unique_ratio": round(s.unique_ratio, 4)}, columns=at))
        if s.is_constant:
            found.append(_row("constant_feature", "caution", scope, {"unique": s.unique}, columns=at))
        if s.missing_ratio >= fixed.MISSING_HIGH:
            found.append(_row("feature_mostly_missing", "high_risk", scope, {"missing": round(s.missing_ratio, 4)}, columns=at))
        elif s.missing_ratio >= fixed.MISSING_CAUTION:
            found.append(_row("feature_missing_values", "caution", scope, {"missing": round(s.missing_ratio, 4)}, columns=at))
        if not s.id_reason and s.logical == "string" and s.unique > fixed.ONE_HOT_CAP:
            found.append(_row("high_cardinality_feature", "caution", scope, {"unique": s.unique}, columns=at))
    return found


def _protocol(df: DataFrame, spec: TaskSpec, protocol: Protocol, rows: int, stats: dict[str, ColumnStats], c: dict) -> list:
    found = []
    if not protocol.forward and not spec.time:
        names = time_candidates(df, stats)
        if names:
            found.append(_row("time_structure_ignored", "high_risk", "protocol", {"columns": ",".join(names)}, columns=names))
    if protocol.splitter not in GROUP_AWARE and not spec.group:
        names = group_candidates(rows, stats)
        if names:
            found.append(_row("group_structure_ignored", "high_risk", "protocol", {"columns": ",".join(names)}, columns=names))
    if c["holdout_rows"] < fixed.MIN_ROWS_FOR_INTERVALS:
        found.append(_row("holdout_too_small_for_intervals", "caution", "protocol", {"rows": c["holdout_rows"]}))
    if protocol.notes:
        found.append(_row("protocol_adjusted", "info", "protocol", {"n_splits": protocol.n_splits, "notes": "; ".join(protocol.notes)}))
    return found


def assess(
    df: DataFrame, spec: TaskSpec, protocol: Protocol, leakage: DataFrame | None = None, *,
    stats: dict[str, ColumnStats] | None = None,
) -> DataFrame:
    """All readiness findings; leakage signals join in under ``leakage.<code>`` with their severity.

    ``stats`` of the features and the target spare an aggregation when the caller has them already.
    """
    y = F.col(spec.target)
    if stats is None:
        extra = {"lost": F.count_if(y.isNull())}
        if not spec.is_classification:
            extra |= {"ym": F.avg(y.cast("double")), "ys": F.stddev_samp(y.cast("double"))}
        rows, stats, more = column_stats(df, spec.features, extra=extra)
    else:
        goal = stats[spec.target]
        rows, more = goal.rows, {"lost": goal.missing, "ym": goal.mean, "ys": goal.std}
        stats = {c: stats[c] for c in spec.features}
    c = context_values(rows, more["lost"], stats, protocol)
    found = _size(c)
    found += _target(df, spec, protocol, c, (more.get("ym"), more.get("ys")))
    found += _features(stats, spec)
    copies = duplicate_rows(df, [*spec.features, spec.target]).first()["duplicate_rows"]
    if copies:
        severity = "high_risk" if copies / rows >= fixed.DUPLICATE_HIGH else "caution"
        found.append(_row("duplicate_rows", severity, "dataset", {"rows": copies}))
    found += _protocol(df, spec, protocol, rows, stats, c)
    result = df.sparkSession.createDataFrame(found, FINDING)
    if leakage is not None:
        signals = leakage.filter("evaluated").withColumn("code", F.concat(F.lit("leakage."), F.col("code")))
        result = result.unionByName(signals)
    return result


def status(findings: DataFrame) -> DataFrame:
    """BLOCKED | HIGH_RISK | CAUTION | READY and the number of findings behind it."""
    level = (
        F.when(F.col("blocking"), F.struct(F.lit(3).alias("w"), F.lit("BLOCKED").alias("s")))
        .when(F.col("severity") == "high_risk", F.struct(F.lit(2).alias("w"), F.lit("HIGH_RISK").alias("s")))
        .when(F.col("severity") == "caution", F.struct(F.lit(1).alias("w"), F.lit("CAUTION").alias("s")))
    )
    return findings.agg(F.max(level).alias("top"), F.count(F.lit(1)).alias("findings")).select(
        F.coalesce(F.col("top.s"), F.lit("READY")).alias("status"), "findings"
    )
