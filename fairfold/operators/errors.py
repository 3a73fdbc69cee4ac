"""Concrete error rows next to the feature values the model saw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairfold import fixed
from fairfold.operators.predictions import labels_literal, of_split
from fairfold.spec import RefusedError, TaskSpec

BROADCAST_ROWS = 10_000  # error rows that are shipped to the tasks; more are joined by shuffle


def matching(
    predictions: DataFrame, spec: TaskSpec, kind: str = "all_mistakes", *, actual: str | None = None, predicted: str | None = None
) -> tuple[DataFrame, list[Column]]:
    """Out-of-fold rows of the wanted kind and the order in which they are shown."""
    rows = of_split(predictions, fixed.SPLIT_CV)
    by_id = [F.col("row_id")]
    if not spec.is_classification:
        rows = rows.withColumn("residual", F.col("y_pred") - F.col("y_true"))
        return rows.withColumn("absolute_error", F.abs("residual")), [F.desc("absolute_error"), *by_id]
    truth, guess, positive = F.col("y_true"), F.col("y_pred"), spec.positive
    if kind == "confident_mistakes":
        # without probabilities there is nothing to order by, so all mistakes are shown
        wrong = rows.filter(truth != guess).withColumn("confidence", F.array_max("proba").cast("double"))
        return wrong, [F.desc_nulls_last("confidence"), *by_id]
    if kind == "false_positive" and positive:
        return rows.filter((guess == positive) & (truth != positive)), by_id
    if kind == "false_negative" and positive:
        return rows.filter((truth == positive) & (guess != positive)), by_id
    if actual is not None and predicted is not None:
        return rows.filter((truth == actual) & (guess == predicted)), by_id
    return rows.filter(truth != guess), by_id


def select_error_rows(
    predictions: DataFrame, snapshot: DataFrame, spec: TaskSpec, kind: str = "all_mistakes", *,
    limit: int = fixed.ERROR_ROWS_DEFAULT, actual: str | None = None, predicted: str | None = None,
) -> DataFrame:
    """The first ``limit`` rows of one contender with features, context and probabilities.

    The limit comes first; only its ids are sent to the snapshot.
    """
    if int(limit) < 1:
        raise RefusedError("bad_limit", str(limit))
    limit = int(limit)
    rows, order = matching(predictions, spec, kind, actual=actual, predicted=predicted)
    top = rows.orderBy(*order).limit(limit)
    small = F.broadcast if limit <= BROADCAST_ROWS else (lambda df: df)
    wanted = small(top.select("row_id"))
    seen = [c for c in spec.features if c in snapshot.columns]
    rest = [c for c in snapshot.columns if c not in seen and c != spec.row_id]
    found = (
        snapshot.withColumnRenamed(spec.row_id, "row_id")
        .join(wanted, "row_id", "left_semi")
        .select("row_id", F.struct(*seen).alias("features"), F.struct(*rest).alias("context"))
    )
    joined = top.join(small(found), "row_id", "left")
    if spec.is_classification:
        rounded = F.transform("proba", lambda p: F.round(p.cast("double"), 6))
        joined = joined.withColumn(
            "probabilities", F.when(F.col("proba").isNotNull(), F.map_from_arrays(labels_literal(spec.labels), rounded))
        ).drop("proba")
    else:
        joined = joined.withColumns({c: F.round(c, 6) for c in ("residual", "absolute_error")})
    return joined


def matching_total(
    predictions: DataFrame, spec: TaskSpec, kind: str = "all_mistakes", *, actual: str | None = None, predicted: str | None = None
) -> DataFrame:
    """How many rows match, per contender."""
    rows, _ = matching(predictions, spec, kind, actual=actual, predicted=predicted)
    return rows.groupBy("run_id", "contender_key").agg(F.count(F.lit(1)).alias("total_matching"))


def holdout_rows(predictions: DataFrame, snapshot: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Snapshot rows of the holdout; refuses when some prediction has no row to stand on."""
    ids = of_split(predictions, fixed.SPLIT_HOLDOUT).select("row_id").distinct()
    rows = snapshot.withColumnRenamed(row_id, "row_id")
    unmatched = ids.join(rows.select("row_id"), "row_id", "left_anti").limit(1).count()
    if unmatched:
        raise RefusedError("holdout_rows_unmatched")
    return rows.join(ids, "row_id", "left_semi")
