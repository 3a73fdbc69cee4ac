"""Diagnostics of all contenders at once, from stored predictions and fold metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairfold import fixed
from fairfold.operators.gram import strong_correlations
from fairfold.operators.predictions import labels_literal, of_split
from fairfold.operators.ranking import exact_quantiles
from fairfold.spec import TaskSpec

WHO = ["run_id", "contender_key"]


# --- train against validation --------------------------------------------------------------------------


def fold_gaps(folds: DataFrame, metric: str) -> DataFrame:
    """Per fold the validation and the training score; the gap is oriented so that larger is worse."""
    picked = folds.filter((F.col("metric") == metric) & F.col("split").isin(fixed.SPLIT_CV, fixed.SPLIT_PROBE))
    cv, probe = F.col("split") == fixed.SPLIT_CV, F.col("split") == fixed.SPLIT_PROBE
    paired = picked.groupBy(*WHO, "fold").agg(
        F.max(F.when(cv, F.col("n_rows"))).alias("validation_rows"),
        F.max(F.when(cv, F.col("value"))).alias("validation_score"),
        F.max(F.when(probe, F.col("n_rows"))).alias("probe_rows"),
        F.max(F.when(probe, F.col("value"))).alias("train_score"),
    ).filter("validation_rows is not null")
    sign = 1.0 if fixed.METRIC_DIRECTION[metric] == "higher" else -1.0
    gap = (F.col("train_score") - F.col("validation_score")) * F.lit(sign)
    return paired.withColumn("gap", F.round(gap, 6))


def gap_summary(gaps: DataFrame, metric: str) -> DataFrame:
    """Means over folds with the severity of the gap and of the spread."""
    summary = gaps.groupBy(*WHO).agg(
        F.round(F.avg("validation_score"), 6).alias("mean_validation"),
        F.when(F.count("validation_score") > 1, F.round(F.stddev_pop("validation_score"), 6)).alias("spread"),
        F.round(F.avg("gap"), 6).alias("mean_gap"),
        F.avg("train_score").alias("mean_train"),
        F.count_if(F.col("validation_score").isNull()).alias("unmeasured_folds"),
        F.count(F.lit(1)).alias("folds"),
    )
    gap, mean = F.col("mean_gap"), F.col("mean_validation")
    relative_gap = F.coalesce(F.abs(F.try_divide(gap, F.col("mean_train"))), F.lit(float("inf")))
    bounded = F.lit(metric in fixed.BOUNDED_METRICS)
    gap_severity = (
        F.when(gap.isNull() | (gap <= 0), "info")
        .when((relative_gap >= fixed.RELATIVE_GAP_HIGH) | (bounded & (gap >= fixed.ABSOLUTE_GAP_HIGH)), "high")
        .when((relative_gap >= fixed.RELATIVE_GAP_CAUTION) | (bounded & (gap >= fixed.ABSOLUTE_GAP_CAUTION)), "caution")
        .otherwise("info")
    )
    relative_spread = F.abs(F.try_divide(F.col("spread"), mean))
    spread_severity = (
        F.when(relative_spread >= fixed.FOLD_SPREAD_HIGH, "high")
        .when(relative_spread >= fixed.FOLD_SPREAD_CAUTION, "caution")
        .otherwise("info")
    )
    return summary.withColumn("gap_severity", gap_severity).withColumn("spread_severity", spread_severity)


def gap_findings(summary: DataFrame) -> DataFrame:
    """run_id, contender_key, code, severity, evidence for everything above ``info``."""
    entries = F.array(
        F.when(
            F.col("gap_severity") != "info",
            F.struct(
                F.lit("train_validation_gap").alias("code"), F.col("gap_severity").alias("severity"),
                F.round("mean_gap", 6).alias("evidence"),
            ),
        ),
        F.when(
            F.col("spread_severity") != "info",
            F.struct(
                F.lit("fold_instability").alias("code"), F.col("spread_severity").alias("severity"),
                F.round(F.abs(F.try_divide("spread", "mean_validation")), 6).alias("evidence"),
            ),
        ),
        F.when(
            F.col("unmeasured_folds") > 0,
            F.struct(
                F.lit("metric_not_measurable").alias("code"), F.lit("caution").alias("severity"),
                F.col("unmeasured_folds").cast("double").alias("evidence"),
            ),
        ),
    )
    return summary.select(*WHO, F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select(*WHO, "e.*")


# --- classification --------------------------------------------------------------------------------------


def confusion(predictions: DataFrame, spec: TaskSpec) -> DataFrame:
    """Counts on the full grid of task labels, empty cells included."""
    labels = labels_literal(spec.labels)
    counts = (
        of_split(predictions, fixed.SPLIT_CV)
        .groupBy(*WHO, "y_true", "y_pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # the grid is generated per contender from the label list: labels squared rows each
    grid = (
        counts.select(*WHO).distinct()
        .select(*WHO, F.explode(labels).alias("y_true"))
        .select(*WHO, "y_true", F.explode(labels).alias("y_pred"))
    )
    return grid.join(counts, [*WHO, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def top_confusions(predictions: DataFrame, spec: TaskSpec) -> DataFrame:
    """The ten most frequent mistakes of each contender."""
    mistakes = (
        of_split(predictions, fixed.SPLIT_CV)
        .filter(F.col("y_true") != F.col("y_pred"))
        .filter(F.array_contains(labels_literal(spec.labels), F.col("y_pred")))
        .groupBy(*WHO, "y_true", "y_pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy(*WHO).orderBy(F.desc("n"), "y_true", "y_pred")
    return mistakes.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= fixed.TOP_CONFUSIONS)


def per_class(predictions: DataFrame, spec: TaskSpec) -> DataFrame:
    """Precision, recall, F1 and support of every task label; undefined ratios are 0."""
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.lit(1).alias("support"), F.lit(0).alias("named")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).alias("support"), F.lit(1).alias("named")),
    )
    cells = of_split(predictions, fixed.SPLIT_CV).groupBy(*WHO, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    counted = (
        cells.select(*WHO, "n", (F.col("y_true") == F.col("y_pred")).alias("right"), F.explode(sides).alias("s"))
        .groupBy(*WHO, "s.label")
        .agg(
            F.sum(F.col("n") * F.col("s.support")).alias("support"),
            F.sum(F.col("n") * F.col("s.named")).alias("named"),
            F.sum(F.when(F.col("right"), F.col("n") * F.col("s.support")).otherwise(0)).alias("tp"),
        )
    )
    every = counted.select(*WHO).distinct().select(*WHO, F.explode(labels_literal(spec.labels)).alias("label"))
    full = every.join(counted, [*WHO, "label"], "left").na.fill(0, ["support", "named", "tp"])
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return full.select(
        *WHO, "label",
        ratio(F.col("tp"), F.col("named")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("named")).alias("f1"),
        "support",
    )


def imbalance_findings(classes: DataFrame) -> DataFrame:
    """Classes with too few rows for a stable estimate, and a very rare class, per contender."""
    facts = classes.groupBy(*WHO).agg(
        F.count_if(F.col("support") < fixed.SCARCE_CLASS_ROWS).alias("scarce"),
        F.try_divide(F.min("support"), F.sum("support")).alias("share"),
    )
    entries = F.array(
        F.when(F.col("scarce") > 0, F.struct(
            F.lit("scarce_class").alias("code"), F.lit("caution").alias("severity"), F.col("scarce").cast("double").alias("evidence"))),
        F.when(F.col("share") < fixed.SEVERE_IMBALANCE, F.struct(
            F.lit("severe_imbalance").alias("code"), F.lit("caution").alias("severity"), F.round("share", 6).alias("evidence"))),
    )
    return facts.select(*WHO, F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select(*WHO, "e.*")


def _place(value: Column, inner_edges: list[float]) -> Column:
    """Number of inner edges at or below the value: half-open bins, the last one closed."""
    return sum(((value >= F.lit(e)).cast("int") for e in inner_edges), F.lit(0))


def confidence_bins(predictions: DataFrame) -> DataFrame:
    """Promised confidence against measured accuracy; contenders lacking probabilities have no rows."""
    rows = of_split(predictions, fixed.SPLIT_CV).filter("proba is not null").select(
        *WHO, F.array_max("proba").cast("double").alias("confidence"), (F.col("y_true") == F.col("y_pred")).alias("right"),
    )
    binned = rows.withColumn("bin", _place(F.col("confidence"), list(fixed.CONFIDENCE_EDGES[1:-1]))).groupBy(*WHO, "bin")
    mean, accuracy = F.avg("confidence"), F.avg(F.col("right").cast("double"))
    return binned.agg(
        F.count(F.lit(1)).alias("n"), F.round(mean, 6).alias("mean_confidence"), F.round(accuracy, 6).alias("accuracy")
    ).withColumn("overconfident", F.col("mean_confidence") - F.col("accuracy") > fixed.OVERCONFIDENT_GAP)


# --- regression -------------------------------------------------------------------------------------------


def _contenders(rows: DataFrame) -> list[tuple[str, str]]:
    """(run, contender) pairs; a bounded list of configurations, not data."""
    return [(r["run_id"], r["contender_key"]) for r in rows.select(*WHO).distinct().orderBy(*WHO).collect()]


def _per_contender_quantiles(rows: DataFrame, value: Column, who: list[tuple[str, str]], shares: list[float]) -> dict:
    """Exact linear quantiles of one value for several contenders in the same jobs."""
    wide = rows.select(*[
        F.when((F.col("run_id") == r) & (F.col("contender_key") == c), value).alias(f"v{i}") for i, (r, c) in enumerate(who)
    ])
    found = exact_quantiles(wide, {f"v{i}": shares for i in range(len(who))})
    return {pair: found[f"v{i}"] for i, pair in enumerate(who)}


def residual_summary(predictions: DataFrame) -> DataFrame:
    """Mean, population std, extremes, linear quantiles and the bias flag of the residuals."""
    rows = of_split(predictions, fixed.SPLIT_CV).select(*WHO, (F.col("y_pred") - F.col("y_true")).alias("residual"), "y_true")
    who = _contenders(rows)
    quantiles = _per_contender_quantiles(rows, F.col("residual"), who, list(fixed.RESIDUAL_QUANTILES))
    names = ["q05", "q25", "median", "q75", "q95"]
    table = rows.sparkSession.createDataFrame(
        [(*pair, *[round(q, 6) if q is not None else None for q in quantiles[pair]]) for pair in who],
        "run_id string, contender_key string, " + ", ".join(f"{n} double" for n in names),
    )
    mean, spread = F.avg("residual"), F.stddev_pop("residual")
    biased = F.when(spread > 0, F.abs(mean) > fixed.BIAS_RATIO * spread).otherwise(F.abs(mean) > 0)
    sums = rows.groupBy(*WHO).agg(
        F.count(F.lit(1)).alias("n"), F.round(mean, 6).alias("mean"), F.round(spread, 6).alias("std"),
        F.round(F.min("residual"), 6).alias("min"), F.round(F.max("residual"), 6).alias("max"),
        biased.alias("systematic_bias"),
        F.round(F.min("y_true"), 6).alias("target_min"), F.round(F.max("y_true"), 6).alias("target_max"),
    )
    return sums.join(F.broadcast(table), WHO)


def error_by_target_range(predictions: DataFrame) -> DataFrame:
    """Error inside each fifth of the target; empty fifths have no row, tiny parts none at all."""
    rows = of_split(predictions, fixed.SPLIT_CV).select(*WHO, (F.col("y_pred") - F.col("y_true")).alias("residual"), "y_true")
    who = _contenders(rows)
    shares = [i / fixed.TARGET_BUCKETS for i in range(fixed.TARGET_BUCKETS + 1)]
    edges = _per_contender_quantiles(rows, F.col("y_true"), who, shares)
    table = rows.sparkSession.createDataFrame(
        [(*pair, edges[pair]) for pair in who if edges[pair][0] is not None],
        "run_id string, contender_key string, edges array<double>",
    )
    above = F.filter(F.slice("edges", 2, fixed.TARGET_BUCKETS - 1), lambda e: F.col("y_true") >= e)
    binned = rows.join(F.broadcast(table), WHO).withColumn("bucket", F.size(above))
    return (
        binned.groupBy(*WHO, "bucket", "edges")
        .agg(
            F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs("residual")), 6).alias("mae"),
            F.round(F.sqrt(F.avg(F.col("residual") * F.col("residual"))), 6).alias("rmse"),
            F.round(F.avg("residual"), 6).alias("mean_residual"),
        )
        .withColumn("total", F.sum("n").over(Window.partitionBy(*WHO)))  # over at most five rows
        .filter(F.col("total") >= 2 * fixed.TARGET_BUCKETS)
        .select(
            *WHO, "bucket", F.round(F.get("edges", F.col("bucket")), 6).alias("low"),
            F.round(F.get("edges", F.col("bucket") + 1), 6).alias("high"), "n", "mae", "rmse", "mean_residual",
        )
    )


def largest_errors(predictions: DataFrame, keep: int = fixed.LARGEST_ERRORS) -> DataFrame:
    """The rows with the largest absolute error per contender, with a guarded relative error."""
    rows = of_split(predictions, fixed.SPLIT_CV).withColumn("residual", F.col("y_pred") - F.col("y_true"))
    ranges = rows.groupBy(*WHO).agg((F.max("y_true") - F.min("y_true")).alias("range"))
    order = Window.partitionBy(*WHO).orderBy(F.desc(F.abs("residual")), "row_id")
    top = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
    size = F.abs("y_true")
    meaningful = (size > F.coalesce("range", F.lit(0.0)) * fixed.NEAR_ZERO_SHARE) & (F.col("y_true") != 0)
    return top.join(ranges, WHO).select(
        *WHO, "place", "row_id", "fold", F.round("y_true", 6).alias("y_true"), F.round("y_pred", 6).alias("y_pred"),
        F.round("residual", 6).alias("residual"), F.round(F.abs("residual"), 6).alias("absolute_error"),
        F.when(meaningful, F.round(F.try_divide(F.abs("residual"), size), 6)).alias("relative_error"),
    )


# --- features ----------------------------------------------------------------------------------------------


def correlated_pairs(df: DataFrame, columns: list[str], limit: float = fixed.HIGH_CORRELATION) -> DataFrame:
    """Pairs of numeric columns with a strong Pearson correlation over rows where both are known."""
    return strong_correlations(df, columns, limit)


# --- the whole report ------------------------------------------------------------------------------------


def diagnose(predictions: DataFrame, folds: DataFrame, spec: TaskSpec, metric: str | None = None) -> dict[str, DataFrame]:
    """Every diagnostic table for every contender; ``findings`` is already in report order."""
    chosen = metric if metric in fixed.METRICS_BY_TASK[spec.task_type] else fixed.PRIMARY_METRIC[spec.task_type]
    gaps = fold_gaps(folds, chosen)
    summary = gap_summary(gaps, chosen)
    findings = gap_findings(summary)
    tables = {"folds": gaps, "summary": summary}
    if spec.is_classification:
        classes = per_class(predictions, spec)
        tables |= {
            "confusion": confusion(predictions, spec), "top_confusions": top_confusions(predictions, spec),
            "per_class": classes, "confidence": confidence_bins(predictions),
        }
        findings = findings.unionByName(imbalance_findings(classes))
    else:
        tables |= {
            "residuals": residual_summary(predictions), "by_target_range": error_by_target_range(predictions),
            "largest_errors": largest_errors(predictions),
        }
    place = F.element_at(F.create_map(*[F.lit(x) for x in ("high", 0, "caution", 1, "info", 2)]), F.col("severity"))
    tables["findings"] = findings.orderBy(*WHO, place, "code")
    return tables
