"""The predictions table: the fact table every metric, ranking and diagnosis is computed from.

Columns: run_id, contender_key, row_id, split, fold, y_true, y_pred and, for classification,
``proba array<float>`` in the order of the task's labels (NULL when a model gives none).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairfold import fixed
from fairfold.functions.scalars import not_finite
from fairfold.spec import Protocol, RefusedError, TaskSpec

PART = ["run_id", "contender_key", "split", "fold"]
REQUIRED = ("row_id", "split", "fold", "y_true", "y_pred")


def require_columns(df: DataFrame) -> DataFrame:
    missing = sorted(set(REQUIRED) - set(df.columns))
    if missing:
        raise RefusedError("predictions_incomplete", ", ".join(missing))
    return df


def of_split(predictions: DataFrame, split: str) -> DataFrame:
    return predictions.filter(F.col("split") == split)


def labels_literal(labels: tuple[str, ...] | list[str]) -> Column:
    return F.array(*[F.lit(x) for x in labels])


def unite_parts(parts: list[DataFrame], *, classification: bool) -> DataFrame:
    """Union of per-fold parts. One part without probabilities withdraws them for its contender."""
    if not parts:
        raise RefusedError("invalid_predictions", "no parts")
    united = reduce(lambda a, b: a.unionByName(b), parts)
    if not classification:
        return united
    lacking = (
        united.groupBy("run_id", "contender_key")
        .agg(F.max(F.col("proba").isNull()).alias("__lacks"))
    )
    # one row per contender of the runs at hand
    return (
        united.join(F.broadcast(lacking), ["run_id", "contender_key"])
        .withColumn("proba", F.when(~F.col("__lacks"), F.col("proba")))
        .drop("__lacks")
    )


def wide_probabilities(predictions: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """One ``proba__<label>`` column per class, for export."""
    columns = [F.get("proba", F.lit(i)).alias(f"proba__{x}") for i, x in enumerate(labels)]
    return predictions.select(*[c for c in predictions.columns if c != "proba"], *columns)


def align_probabilities(proba: Column, model_classes: list[str], labels: tuple[str, ...]) -> Column:
    """Reorder a model's class probabilities into canonical order; an unseen class gets zero mass."""
    unknown = sorted(set(model_classes) - set(labels))
    if unknown:
        raise RefusedError("invalid_predictions", f"classes outside the task: {unknown}")
    if tuple(model_classes) == tuple(labels):
        return F.transform(proba, lambda p: p.cast("float"))
    by_label = F.map_from_arrays(labels_literal(model_classes), proba)
    return F.transform(
        labels_literal(labels),
        lambda x: F.coalesce(F.try_element_at(by_label, x), F.lit(0.0)).cast("float"),
    )


def unseen_classes(model_classes: list[str], labels: tuple[str, ...]) -> list[str]:
    return [x for x in labels if x not in set(model_classes)]


def violations(predictions: DataFrame, spec: TaskSpec) -> DataFrame:
    """Counts of unusable predictions per (run, contender, split, fold); zero everywhere is valid."""
    if not spec.is_classification:
        return predictions.groupBy(*PART).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(not_finite(F.col("y_pred"))).alias("bad_value"),
        )
    given = F.col("proba").isNotNull()
    return predictions.groupBy(*PART).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(
            ~F.coalesce(F.array_contains(labels_literal(spec.labels), F.col("y_pred")), F.lit(False))
        ).alias("bad_label"),
        F.count_if(given & (F.size("proba") != len(spec.labels))).alias("bad_shape"),
        F.count_if(given & F.exists("proba", not_finite)).alias("bad_value"),
        F.count_if(given & F.exists("proba", lambda p: p < 0)).alias("negative"),
    )


def oof_coverage(predictions: DataFrame, pool: DataFrame, protocol: Protocol) -> DataFrame:
    """Per contender: expected, covered, duplicated, stray rows and the resulting verdict.

    ``pool`` has one row per row_id that takes part in cross-validation.  The predictions are reduced
    to one count per row before anything is compared, and both sides meet in a single aggregation
    keyed by row, so no key can become hot.
    """
    who = ["run_id", "contender_key"]
    seen = (
        of_split(predictions, fixed.SPLIT_CV)
        .groupBy(*who, "row_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = pool.select("row_id", F.lit(1).alias("known"))
    expected = pool.agg(F.count(F.lit(1)).alias("expected_rows")).scalar()
    per = (
        seen.join(known, "row_id", "left")
        .groupBy(*who)
        .agg(
            F.count(F.lit(1)).alias("observed"),
            F.count_if(F.col("known").isNotNull()).alias("covered_rows"),
            F.count_if(F.col("n") > 1).alias("duplicated_rows"),
            F.count_if(F.col("known").isNull()).alias("stray_rows"),
        )
    )
    total = F.col("expected_rows")
    complete = (F.col("covered_rows") == total) & (F.col("stray_rows") == 0)
    verdict = (
        F.when(F.col("duplicated_rows") > 0, "duplicated")
        .when(F.col("stray_rows") > 0, "stray")
        .when(complete, "complete")
        .when(F.lit(protocol.forward), "first_period_only_trains")
        .otherwise("incomplete")
    )
    return per.withColumn("expected_rows", expected).select(
        *who, "expected_rows", "covered_rows", "duplicated_rows", "stray_rows",
        complete.alias("complete"), verdict.alias("verdict"),
    )


def part_coverage(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """Per contender and part (split, fold): expected, covered, duplicated, stray rows and the verdict.

    ``expected`` holds ``split, fold, row_id`` of every row a contender has to predict, holdout and probes
    included.  A part without any prediction is ``incomplete``, a predicted part nobody asked for ``stray``.
    """
    who = ["run_id", "contender_key"]
    # one row per split and fold
    sizes = [(r["split"], r["fold"], r["n"]) for r in expected.groupBy("split", "fold").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not sizes:
        every = predictions.select(*PART, F.lit(0).cast("long").alias("expected_rows")).limit(0)
    else:
        parts = F.array(*[F.struct(F.lit(s).alias("split"), F.lit(f).cast("int").alias("fold"), F.lit(n).cast("long").alias("expected_rows")) for s, f, n in sizes])
        every = predictions.select(*who).distinct().select(*who, F.inline(parts))
    known = expected.select("split", F.col("fold").cast("int").alias("fold"), "row_id", F.lit(1).alias("known"))
    per = (
        predictions.groupBy(*PART, "row_id").agg(F.count(F.lit(1)).alias("n"))
        .join(known, ["split", "fold", "row_id"], "left")
        .groupBy(*PART)
        .agg(
            F.count("known").alias("covered_rows"), F.count_if(F.col("n") > 1).alias("duplicated_rows"),
            F.count_if(F.col("known").isNull()).alias("stray_rows"),
        )
    )
    counts = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("expected_rows", "covered_rows", "duplicated_rows", "stray_rows")}
    verdict = (
        F.when(F.col("duplicated_rows") > 0, "duplicated").when(F.col("stray_rows") > 0, "stray")
        .when(F.col("covered_rows") == F.col("expected_rows"), "complete").otherwise("incomplete")
    )
    return every.join(per, list(PART), "full").select(*PART, *counts.values()).withColumn("verdict", verdict)


def strays(predictions: DataFrame, pool: DataFrame) -> DataFrame:
    """Rows predicted although they are outside the pool."""
    return (
        of_split(predictions, fixed.SPLIT_CV)
        .select("contender_key", "row_id")
        .join(pool.select("row_id"), "row_id", "left_anti")
    )
