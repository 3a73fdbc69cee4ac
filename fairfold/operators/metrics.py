"""Metrics of every contender, split and fold at once, from the predictions table alone.

A value that cannot be computed is NULL with a reason code in ``note``; it is never zero.
Classification needs two aggregations: confusion cells carrying probability sums (labels squared rows)
and one row per distinct score for the ranking metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairfold import fixed
from fairfold.operators.predictions import PART, labels_literal
from fairfold.spec import TaskSpec

NO_PROBABILITIES = "no_probabilities"
MASS_OFF = "probabilities_do_not_sum_to_one"
ONE_CLASS = "single_class_observed"
CLASSES_UNOBSERVED = "classes_unobserved"
CONSTANT_TARGET = "constant_target"
ZERO_TARGET = "zero_target_rows"
PARTIAL = "partial_folds"
NOWHERE = "no_fold_measured"


def registry(spark) -> DataFrame:
    """Metric keys with task type, direction, display order and the primary flag."""
    rows = [
        (task, key, fixed.METRIC_DIRECTION[key], i, key == fixed.PRIMARY_METRIC[task])
        for task, keys in fixed.METRICS_BY_TASK.items()
        for i, key in enumerate(keys)
    ]
    return spark.createDataFrame(
        rows, "task_type string, metric string, direction string, position int, is_primary boolean"
    )


def fold_metrics(predictions: DataFrame, spec: TaskSpec) -> DataFrame:
    """run_id, contender_key, split, fold, metric, value, note, n_rows."""
    if spec.is_classification:
        return _classification(predictions, spec)
    return _regression(predictions)


def _melt(wide: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per metric from columns ``<key>`` and ``<key>__note``."""
    entries = F.array(
        *[
            F.struct(
                F.lit(k).alias("metric"),
                F.round(F.col(k), 6).alias("value"),
                F.when(F.col(k).isNull(), F.col(f"{k}__note")).otherwise(F.lit("")).alias("note"),
            )
            for k in keys
        ]
    )
    return wide.select(*PART, "n_rows", F.explode(entries).alias("m")).select(
        *PART, "m.metric", "m.value", "m.note", "n_rows"
    )


def _regression(predictions: DataFrame) -> DataFrame:
    truth, error = F.col("y_true"), F.col("y_pred") - F.col("y_true")
    sums = predictions.groupBy(*PART).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(error * error).alias("sse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(truth).alias("variance"),
        F.count_if(truth == 0).alias("zeros"),
        F.avg(F.abs(F.try_divide(error, truth))).alias("ape"),
    )
    n = F.col("n_rows")
    constant = (n < 2) | (F.col("variance") == 0)
    wide = sums.select(
        *PART, "n_rows", "mae",
        F.sqrt(F.col("sse") / n).alias("rmse"),
        F.when(~constant, 1 - F.col("sse") / (n * F.col("variance"))).alias("r2"),
        F.when(F.col("zeros") == 0, F.col("ape")).alias("mape"),
        F.lit(None).cast("string").alias("rmse__note"),
        F.lit(None).cast("string").alias("mae__note"),
        F.lit(CONSTANT_TARGET).alias("r2__note"),
        F.concat(F.lit(ZERO_TARGET + ":"), F.col("zeros").cast("string")).alias("mape__note"),
    )
    return _melt(wide, fixed.METRICS_BY_TASK["regression"])


def probability_mass(proba: Column, classes: int) -> Column:
    """Sum of the class probabilities as a double; short arrays are summed without a loop."""
    if classes > 16:
        return F.aggregate(proba, F.lit(0.0), lambda a, p: a + p.cast("double"))
    return sum((F.get(proba, F.lit(i)).cast("double") for i in range(1, classes)), F.get(proba, F.lit(0)).cast("double"))


def with_mass(predictions: DataFrame, classes: int) -> DataFrame:
    return predictions.withColumn("mass", probability_mass(F.col("proba"), classes))


def share_of(position: Column) -> Column:
    """Probability at a position divided by the mass, as a double."""
    p = F.get("proba", position).cast("double")
    return F.when(F.col("mass") > 0, p / F.col("mass")).otherwise(p)


def _classification(predictions: DataFrame, spec: TaskSpec) -> DataFrame:
    labels = labels_literal(spec.labels)
    k = len(spec.labels)
    positive = spec.metric_positive
    binary = spec.task_type == "binary"
    rows = with_mass(predictions.select(*PART, "y_true", "y_pred", "proba"), k)
    unusable = F.col("proba").isNull() | (F.size("proba") != k)
    p_true = share_of((F.array_position(labels, F.col("y_true")) - 1).cast("int"))
    clipped = F.greatest(
        F.least(p_true, F.lit(1 - fixed.LOG_LOSS_EPSILON)), F.lit(fixed.LOG_LOSS_EPSILON)
    )
    position = spec.labels.index(positive) if positive in spec.labels else 1
    p_positive = share_of(F.lit(position))
    hit = (F.col("y_true") == F.lit(positive)).cast("double")

    cells = rows.groupBy(*PART, "y_true", "y_pred").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(unusable).alias("unusable"),
        F.max(F.abs(F.col("mass") - 1)).alias("deviation"),
        F.sum(-F.log(clipped)).alias("log_sum"),
        F.sum((p_positive - hit) * (p_positive - hit)).alias("square_sum"),
    )
    # each confusion cell contributes to its true class and to its predicted class
    sides = F.array(
        F.struct(
            F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("named"),
            F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0)).alias("tp"),
            F.col("unusable").alias("unusable"), F.col("deviation").alias("deviation"),
            F.col("log_sum").alias("log_sum"), F.col("square_sum").alias("square_sum"),
        ),
        F.struct(
            F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("named"),
            F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("unusable"),
            F.lit(None).cast("double").alias("deviation"), F.lit(None).cast("double").alias("log_sum"),
            F.lit(None).cast("double").alias("square_sum"),
        ),
    )
    classes = (
        cells.select(*PART, F.explode(sides).alias("s"))
        .select(*PART, "s.*")
        .groupBy(*PART, "label")
        .agg(
            *[F.sum(c).alias(c) for c in ("support", "named", "tp", "unusable", "log_sum", "square_sum")],
            F.max("deviation").alias("deviation"),
        )
    )
    recall = F.try_divide(F.col("tp"), F.col("support"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("named")), F.lit(0.0))
    ours = F.col("label") == F.lit(positive)
    listed = F.array_contains(labels, F.col("label"))
    folds = classes.groupBy(*PART).agg(
        F.sum("support").alias("n_rows"),
        F.sum("tp").alias("correct"),
        F.avg(F.when(F.col("support") > 0, recall)).alias("balanced_accuracy"),
        (F.sum(F.when(listed, f1).otherwise(0.0)) / F.lit(float(k))).alias("macro_f1"),
        F.sum(F.when(ours, F.col("tp")).otherwise(0)).alias("tp"),
        F.sum(F.when(ours, F.col("named")).otherwise(0)).alias("named"),
        F.sum(F.when(ours, F.col("support")).otherwise(0)).alias("support"),
        F.count_if(F.col("support") > 0).alias("observed"),
        F.sum("unusable").alias("unusable"),
        F.max("deviation").alias("deviation"),
        F.sum("log_sum").alias("log_sum"),
        F.sum("square_sum").alias("square_sum"),
    )
    gate = (
        F.when(F.col("unusable") > 0, NO_PROBABILITIES)
        .when(F.col("deviation") > fixed.PROBABILITY_SUM_TOLERANCE, MASS_OFF)
    )
    one_class = F.coalesce(gate, F.when(F.col("observed") < 2, ONE_CLASS))
    unobserved = F.coalesce(gate, F.when(F.col("observed") < k, CLASSES_UNOBSERVED))
    n = F.col("n_rows")
    columns = {
        "accuracy": (F.col("correct") / n, None),
        "balanced_accuracy": (F.col("balanced_accuracy"), None),
        "macro_f1": (F.col("macro_f1"), None),
        "precision": (F.coalesce(F.try_divide("tp", "named"), F.lit(0.0)), None),
        "recall": (F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)), None),
        "f1": (
            F.coalesce(F.try_divide(2 * F.col("tp"), F.col("named") + F.col("support")), F.lit(0.0)),
            None,
        ),
        "brier": (F.when(one_class.isNull(), F.col("square_sum") / n), one_class),
        "log_loss": (F.when(unobserved.isNull(), F.col("log_sum") / n), unobserved),
    }
    if binary:
        scores = rows.select(*PART, p_positive.alias("score"), (F.col("y_true") == F.lit(positive)).alias("hit"))
        folds = folds.join(ranking_areas(scores, PART), PART, "left")
        columns["roc_auc"] = (F.when(one_class.isNull(), F.col("roc_area")), one_class)
        columns["pr_auc"] = (F.when(one_class.isNull(), F.col("pr_area")), one_class)
    keys = fixed.METRICS_BY_TASK[spec.task_type]
    wide = folds.select(
        *PART, "n_rows",
        *[columns[key][0].alias(key) for key in keys],
        *[
            (F.lit(None).cast("string") if columns[key][1] is None else columns[key][1]).alias(f"{key}__note")
            for key in keys
        ],
    )
    return _melt(wide, keys)


def score_bucket(score: Column) -> Column:
    """A non-decreasing bucket number with 1024 steps per power of two.

    A float32 probability has at most some ten thousand distinct values inside one step, however
    skewed the scores are, so a bucket is a bounded unit of work; equal scores always share one.
    """
    return F.when(score > 0, F.floor(F.log2(score) * F.lit(1024.0))).otherwise(F.lit(-1_000_000))


def curve_points(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative hits and misses at every distinct score, from (score double, hit boolean).

    Rows are first collapsed to one per distinct score, so ties are exact and a hot score costs one
    row.  Cumulative counts are taken inside score buckets, on top of prefix sums over bucket totals.
    """
    tied = (
        scores.filter(F.col("score").isNotNull())
        .groupBy(*keys, "score")
        .agg(
            F.count_if(F.col("hit")).alias("pos"),
            F.count_if(~F.col("hit")).alias("neg"),
        )
        .withColumn("bucket", score_bucket(F.col("score")))
    )
    totals = tied.groupBy(*keys, "bucket").agg(F.sum("pos").alias("bpos"), F.sum("neg").alias("bneg"))
    above = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = totals.select(
        *keys, "bucket",
        F.coalesce(F.sum("bpos").over(above), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("bneg").over(above), F.lit(0)).alias("neg_above"),
        F.sum("bpos").over(whole).alias("positives"),
        F.sum("bneg").over(whole).alias("negatives"),
    )
    inside = (
        Window.partitionBy(*keys, "bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        tied.withColumn("cpos", F.sum("pos").over(inside))
        .withColumn("cneg", F.sum("neg").over(inside))
        .join(totals, [*keys, "bucket"])
        .withColumn("cpos", F.col("cpos") + F.col("pos_above"))
        .withColumn("cneg", F.col("cneg") + F.col("neg_above"))
        .drop("bucket", "pos_above", "neg_above")
    )


def ranking_areas(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Exact ROC area and average precision per ``keys``."""
    return (
        curve_points(scores, keys)
        .groupBy(*keys)
        .agg(
            F.sum(F.col("neg") * (F.col("cpos") - F.col("pos") / F.lit(2.0))).alias("wins"),
            F.sum(F.col("pos") * (F.col("cpos") / (F.col("cpos") + F.col("cneg")))).alias("precision_sum"),
            F.first("positives").alias("positives"),
            F.first("negatives").alias("negatives"),
        )
        .select(
            *keys,
            F.try_divide("wins", F.col("positives").cast("double") * F.col("negatives")).alias("roc_area"),
            F.try_divide("precision_sum", "positives").alias("pr_area"),
        )
    )


def cross_validated(folds: DataFrame) -> DataFrame:
    """Mean over folds (not rows) and population std; NULL folds are skipped and reported."""
    grouped = (
        folds.filter(F.col("split") == fixed.SPLIT_CV)
        .groupBy("run_id", "contender_key", "metric")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("spread"),
            F.count("value").alias("folds_measured"),
            F.count(F.lit(1)).alias("folds_total"),
            F.min_by("note", F.when(F.col("note") != "", F.col("fold"))).alias("first_note"),
            # at most one entry per fold
            F.sort_array(F.collect_list(F.struct("fold", "value"))).alias("per_fold"),
        )
    )
    measured, total = F.col("folds_measured"), F.col("folds_total")
    note = (
        F.when(measured == 0, F.coalesce("first_note", F.lit(NOWHERE)))
        .when(measured < total, F.concat(F.lit(PARTIAL + ":"), F.coalesce("first_note", F.lit(""))))
        .otherwise(F.lit(""))
    )
    return grouped.select(
        "run_id", "contender_key", "metric",
        F.round("mean", 6).alias("value"),
        F.when(measured > 1, F.round("spread", 6)).alias("std"),
        "folds_measured", "folds_total", note.alias("note"), "per_fold",
    )
