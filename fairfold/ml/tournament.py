"""All contenders on identical folds; every prediction is kept as a table."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairfold import fixed
from fairfold.ml.contenders import UNAVAILABLE, Contender, fit, with_target
from fairfold.ml.recipe import Once
from fairfold.operators import folds as fd
from fairfold.operators.predictions import PART, oof_coverage, part_coverage, violations
from fairfold.spec import Protocol, RefusedError, TaskSpec

RUN_CONTENDERS = (
    "run_id string, contender_key string, is_baseline boolean, state string, error_code string, message string, "
    "cost double, coverage string"
)


@dataclass
class Outcome:
    contender: Contender
    state: str
    error_code: str | None = None
    message: str = ""
    predictions: DataFrame | None = None
    model: object | None = None
    coverage: str | None = None


def _part(fitted, rows: DataFrame, run_id: str, key: str, split: str, fold: int) -> DataFrame:
    scored = fitted.predict(rows)
    out = [
        F.lit(run_id).alias("run_id"), F.lit(key).alias("contender_key"), "row_id", F.lit(split).alias("split"),
        F.lit(fold).alias("fold"), F.col("y").alias("y_true"), "y_pred",
    ]
    return scored.select(*out, *(["proba"] if "proba" in scored.columns else []))


def compete(
    assigned: DataFrame, probes: DataFrame, spec: TaskSpec, protocol: Protocol, contender: Contender, run_id: str,
    once: dict[int, Once],
) -> tuple[DataFrame, object]:
    """Fit per fold, predict validation and probe rows, then fit on the whole pool for the holdout.

    ``assigned`` carries row_id, part, chunk, the features, ``y`` and ``label``; which rows a fit may
    see is a predicate on ``chunk``.  ``once`` has, by fold, what contenders share of a training side.
    """
    parts = []
    for fold in range(protocol.n_splits):
        training = assigned.filter(fd.train_of(fold, protocol))
        fitted = fit(contender, training, spec, protocol.seed, once[fold])
        parts.append(_part(fitted, assigned.filter(fd.validation_of(fold, protocol)), run_id, contender.key, fixed.SPLIT_CV, fold))
        # at most 2 000 ids
        ids = F.broadcast(probes.filter(F.col("fold") == fold).select("row_id"))
        parts.append(_part(fitted, training.join(ids, "row_id", "left_semi"), run_id, contender.key, fixed.SPLIT_PROBE, fold))
    final = fit(contender, assigned.filter("part = 'pool'"), spec, protocol.seed, once[fixed.HOLDOUT_FOLD])
    parts.append(_part(final, assigned.filter("part = 'holdout'"), run_id, contender.key, fixed.SPLIT_HOLDOUT, fixed.HOLDOUT_FOLD))
    return reduce(lambda a, b: a.unionByName(b), parts), final


def run(
    df: DataFrame, spec: TaskSpec, protocol: Protocol, contenders: list[Contender | str], *,
    run_id: str, path: str, parallel: int = 2, rows_per_bucket: int | None = None,
) -> tuple[DataFrame, DataFrame, dict[str, object]]:
    """(predictions, run_contenders, models). A failed contender is a row with a code; others go on.

    The prepared rows are written once below ``path`` and every fit reads them from there; each
    contender's predictions are written to their own partition, and everything afterwards is a query.
    """
    spark = df.sparkSession
    options = {"rows_per_bucket": rows_per_bucket} if rows_per_bucket else {}
    keep = tuple(dict.fromkeys([*spec.features, spec.target]))
    # partitioned by chunk, so the predicate of a training or validation side prunes whole folders
    fd.assign(df, spec, protocol, keep=keep, **options).write.mode("overwrite").partitionBy("part", "chunk").parquet(
        f"{path}/rows/run_id={run_id}"
    )
    assigned = with_target(spark.read.parquet(f"{path}/rows/run_id={run_id}"), spec)
    if spec.target not in spec.features:
        assigned = assigned.drop(spec.target)
    fd.train_probe(assigned, protocol).write.mode("overwrite").parquet(f"{path}/probes/run_id={run_id}")
    probes = spark.read.parquet(f"{path}/probes/run_id={run_id}")
    pool = assigned.filter("part = 'pool'").select("row_id")
    spec_in = replace(spec, row_id="row_id")
    # what has to be predicted besides the pool
    held = assigned.filter("part = 'holdout'").select(F.lit(fixed.SPLIT_HOLDOUT).alias("split"), F.lit(fixed.HOLDOUT_FOLD).alias("fold"), "row_id")
    asked = held.unionByName(probes.select(F.lit(fixed.SPLIT_PROBE).alias("split"), "fold", "row_id"))

    once = {fold: Once() for fold in (*range(protocol.n_splits), fixed.HOLDOUT_FOLD)}

    def one(entry: Contender | str) -> Outcome:
        if isinstance(entry, str):
            code = "unavailable" if entry in UNAVAILABLE else "unknown_contender"
            stub = Contender(entry, "none", "passthrough_dummy", ())
            return Outcome(stub, "SKIPPED", code, "no estimator for it is installed")
        try:
            predictions, model = compete(assigned, probes, spec_in, protocol, entry, run_id, once)
            target = f"{path}/predictions/run_id={run_id}/contender_key={entry.key}"
            predictions.drop("run_id", "contender_key").write.mode("overwrite").option("compression", "zstd").parquet(target)
            written = spark.read.parquet(target).withColumns({"run_id": F.lit(run_id), "contender_key": F.lit(entry.key)})
            bad = violations(written, spec_in)
            counted = [c for c in bad.columns if c not in (*PART, "n_rows")]
            wrong = bad.agg(*[F.sum(c).alias(c) for c in counted]).first().asDict()
            if any(wrong.values()):
                return Outcome(entry, "FAILED", "invalid_predictions", json.dumps(wrong))
            verdict = oof_coverage(written, pool, protocol).first()["verdict"]
            if verdict not in ("complete", "first_period_only_trains"):
                return Outcome(entry, "FAILED", "invalid_predictions", verdict)
            other = part_coverage(written.filter(F.col("split") != fixed.SPLIT_CV), asked).filter("verdict <> 'complete'").orderBy("split", "fold").first()
            if other:
                return Outcome(entry, "FAILED", "invalid_predictions", f"{other['split']} {other['fold']}: {other['verdict']}")
            return Outcome(entry, "SUCCEEDED", predictions=written, model=model, coverage=verdict)
        except RefusedError as error:
            state = "SKIPPED" if error.code in ("not_applicable", "task_not_supported", "vocabulary_too_large") else "FAILED"
            return Outcome(entry, state, error.code, str(error))
        except Exception as error:  # noqa: BLE001 - one contender must not end the run
            return Outcome(entry, "FAILED", "fit_failed", f"{type(error).__name__}: {str(error)[:300]}")

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as workers:
        outcomes = list(workers.map(inheritable_thread_target(spark)(one), contenders))
    facts = spark.createDataFrame(
        [
            (run_id, o.contender.key, o.contender.is_baseline, o.state, o.error_code, o.message, float(o.contender.cost), o.coverage)
            for o in outcomes
        ],
        RUN_CONTENDERS,
    )
    done = [o.predictions for o in outcomes if o.predictions is not None]
    if not done:
        raise RefusedError("no_contender_succeeded", "; ".join(f"{o.contender.key}: {o.message}" for o in outcomes))
    predictions = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), done)
    return predictions, facts, {o.contender.key: o.model for o in outcomes if o.model is not None}
