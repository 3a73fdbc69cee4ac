"""Reports that need models: learning curve and permutation importance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairfold import fixed
from fairfold.ml.contenders import Contender, fit, free_name, with_target
from fairfold.operators import folds as fd
from fairfold.operators import metrics as mt
from fairfold.operators.predictions import of_split
from fairfold.session import written
from fairfold.spec import Protocol, RefusedError, TaskSpec

POINT = "fraction double, train_rows long, folds_measured long, mean double, spread double"


def curve_cost(n_folds: int, fractions: tuple[float, ...] = fixed.CURVE_FRACTIONS) -> dict:
    fits = n_folds * len(fractions)
    return {"fits": fits, "within_limit": fits <= fixed.CURVE_MAX_FITS, "limit": fixed.CURVE_MAX_FITS}


def learning_curve(
    df: DataFrame, spec: TaskSpec, protocol: Protocol, contender: Contender, *,
    metric: str | None = None, fractions: tuple[float, ...] = fixed.CURVE_FRACTIONS,
) -> tuple[DataFrame, DataFrame]:
    """(points, skipped): mean score over folds for growing, nested training subsets.

    Validation rows stay the same at every point; a point that could not be fitted is named.
    """
    cost = curve_cost(protocol.n_splits, fractions)
    if not cost["within_limit"]:
        raise RefusedError("curve_too_expensive", f"{cost['fits']} fits, limit {cost['limit']}")
    chosen = metric or fixed.PRIMARY_METRIC[spec.task_type]
    keep = tuple(dict.fromkeys([*spec.features, spec.target]))
    # read again for every fit, so written once to the shared checkpoint folder
    assigned = with_target(fd.assign(df, spec, protocol, keep=keep), spec).drop(spec.target)
    order = free_name(assigned.columns, "subset_order")
    assigned = assigned.withColumn(order, fd.subset_hash(protocol)).checkpoint()
    cuts = fd.subset_cuts(assigned, protocol, fractions)
    sizes = {key: n for key, (n, _) in cuts.items()}
    parts, skipped = [], []
    for fraction in fractions:
        for fold in range(protocol.n_splits):
            n = sizes.get((fraction, fold), 0)
            if n < fixed.MIN_SUBSET_ROWS:
                skipped.append((fraction, fold, "too_few_rows"))
                continue
            training = assigned.filter(fd.train_of(fold, protocol) & fd.in_subset(F.col(order), cuts[fraction, fold][1]))
            try:
                fitted = fit(contender, training, spec, protocol.seed)
            except RefusedError as error:
                skipped.append((fraction, fold, error.code))
                continue
            scored = fitted.predict(assigned.filter(fd.validation_of(fold, protocol)))
            out = [F.lit("curve").alias("run_id"), F.lit(str(fraction)).alias("contender_key"), "row_id",
                   F.lit(fixed.SPLIT_CV).alias("split"), F.lit(fold).alias("fold"), F.col("y").alias("y_true"), "y_pred"]
            parts.append(scored.select(*out, *(["proba"] if "proba" in scored.columns else [])))
    spark = df.sparkSession
    left_out = spark.createDataFrame(skipped, "fraction double, fold int, reason string")
    if not parts:
        return spark.createDataFrame([], POINT), left_out
    predictions = written(reduce(lambda a, b: a.unionByName(b), parts))  # metrics read them several times
    rows = spark.createDataFrame([(f, fold, n) for (f, fold), n in sizes.items()], "fraction double, fold int, n long")
    scores = (
        mt.fold_metrics(predictions, spec).filter(F.col("metric") == chosen)
        .select(F.col("contender_key").cast("double").alias("fraction"), "fold", "value")
        .filter("value is not null")
    )
    points = scores.join(F.broadcast(rows), ["fraction", "fold"]).groupBy("fraction").agg(
        F.round(F.avg("n")).cast("long").alias("train_rows"), F.count(F.lit(1)).alias("folds_measured"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.when(F.count(F.lit(1)) > 1, F.round(F.stddev_pop("value"), 6)).alias("spread"),
    )
    return points, left_out


def curve_verdict(points: DataFrame, metric: str) -> DataFrame:
    """insufficient | noisy | growing | plateau, from the last step of the curve only."""
    sign = 1.0 if fixed.METRIC_DIRECTION[metric] == "higher" else -1.0
    # a handful of points: the unpartitioned window is over them, not over rows
    step = (F.col("mean") - F.lag("mean").over(Window.orderBy("fraction"))) * F.lit(sign)
    last = points.withColumn("step", step).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("step", "fraction").alias("gain"),
        F.coalesce(F.avg("spread"), F.lit(0.0)).alias("noise"),
    )
    verdict = (
        F.when(F.col("n") < 2, "insufficient")
        .when((F.col("noise") > 0) & (F.abs("gain") < F.col("noise")), "noisy")
        .when(F.col("gain") >= fixed.PLATEAU_GAIN, "growing")
        .otherwise("plateau")
    )
    return last.select(F.col("n").alias("points"), F.round("gain", 6).alias("last_gain"), F.round("noise", 6).alias("noise"), verdict.alias("verdict"))


def permuted(rows: DataFrame, features: tuple[str, ...], repeats: int, seed: int, n_rows: int) -> DataFrame:
    """Every row once per (feature, repeat) with that one feature taken from its donor row.

    One permutation per repeat serves all features, so a repeat costs one join, and the copies are
    made by an explode rather than by one pass per feature.
    """
    pairs = fd.permutation_pairs(rows, repeats, seed, n_rows=n_rows)
    donors = rows.select(F.col("row_id").alias("donor_id"), F.struct(*features).alias("donor"))
    paired = rows.join(pairs, "row_id").join(donors, "donor_id")
    return (
        paired.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
        .withColumns({f: F.when(F.col("feature") == f, F.col(f"donor.{f}")).otherwise(F.col(f)) for f in features})
        .drop("donor", "donor_id")
    )


def permutation_importance(
    fitted, rows: DataFrame, spec: TaskSpec, *, repeats: int = 5, seed: int = fixed.DEFAULT_SEED, metric: str | None = None
) -> DataFrame:
    """Mean and spread of the metric's drop per feature on holdout rows; the model is never refitted.

    ``rows``: row_id, the features and ``y``.  A metric the model cannot be measured by gives NULL
    drops instead of silently becoming another metric.
    """
    chosen = metric or fixed.PRIMARY_METRIC[spec.task_type]
    n = rows.count()
    if n < fixed.IMPORTANCE_MIN_ROWS:
        raise RefusedError("holdout_too_small", f"{n} rows")
    if repeats < 1:
        raise RefusedError("bad_repeats", str(repeats))
    base = rows.select("row_id", "y", *spec.features)
    every = permuted(base, spec.features, repeats, seed, n).unionByName(
        base.withColumns({"feature": F.lit(""), "repeat": F.lit(-1)})
    )
    scored = fitted.predict(every)
    out = [F.lit("importance").alias("run_id"), F.col("feature").alias("contender_key"), "row_id",
           F.lit(fixed.SPLIT_HOLDOUT).alias("split"), F.col("repeat").alias("fold"), F.col("y").alias("y_true"), "y_pred"]
    predictions = written(scored.select(*out, *(["proba"] if "proba" in scored.columns else [])))
    values = mt.fold_metrics(predictions, spec).filter(F.col("metric") == chosen).select(
        F.col("contender_key").alias("feature"), F.col("fold").alias("repeat"), "value"
    )
    sign = 1.0 if fixed.METRIC_DIRECTION[chosen] == "higher" else -1.0
    # features x repeats values from here on
    intact = F.max(F.when(F.col("feature") == "", F.col("value"))).over(Window.partitionBy(F.lit(1)))
    drops = values.withColumn("drop", (intact - F.col("value")) * F.lit(sign)).filter("feature <> ''")
    mean, std = F.avg("drop"), F.stddev_pop("drop")
    return drops.groupBy("feature").agg(
        F.round(mean, 6).alias("mean_drop"), F.round(std, 6).alias("std_drop"), F.count("drop").alias("repeats"),
        (std > F.abs(mean)).alias("unstable"), (mean < 0).alias("negative"),
    )


def importance_of_run(
    predictions: DataFrame, snapshot: DataFrame, fitted, spec: TaskSpec, **options
) -> DataFrame:
    """Importance on the holdout rows of a stored run, matched back to the snapshot by row id."""
    from fairfold.operators.errors import holdout_rows

    truth = of_split(predictions, fixed.SPLIT_HOLDOUT).select("row_id", F.col("y_true").alias("y"))
    rows = holdout_rows(predictions, snapshot, spec.row_id).join(truth, "row_id")
    return permutation_importance(fitted, rows, spec, **options)
