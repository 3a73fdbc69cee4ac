"""Saved models: a Spark ``PipelineModel``, a manifest next to it, and a checksum over its files."""

from __future__ import annotations

import json

import pyspark
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairfold.functions.scalars import feature_kinds
from fairfold.ml.contenders import Contender, Fitted, KnnFitted, finish
from fairfold.ml.neighbours import Neighbours
from fairfold.operators.predictions import wide_probabilities
from fairfold.spec import RefusedError, TaskSpec

FORMAT = "fairfold-model"
VERSION = 1


def folder_checksum(spark: SparkSession, folder: str) -> str:
    """SHA-256 over the sorted (relative path, content digest) pairs of the model folder."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .filter(~F.col("path").rlike(r"/[._][^/]*$"))
        .select(F.regexp_extract("path", r"/model/(.*)$", 1).alias("p"), F.sha2("content", 256).alias("h"))
    )
    # a model has a handful of files; only their digests are gathered
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: F.concat(x["p"], F.lit("="), x["h"])), "\n")
    return files.agg(F.sha2(joined, 256).alias("h")).first()["h"]


def save(
    fitted: Fitted | KnnFitted, folder: str, *, run_id: str, dataset: str, protocol: dict, training_rows: int, sample: DataFrame
) -> dict:
    """Write model and manifest; ``sample`` supplies the feature types."""
    spec, spark = fitted.spec, sample.sparkSession
    fitted.model.write().overwrite().save(f"{folder}/model")
    if isinstance(fitted, KnnFitted):
        fitted.index.save(f"{folder}/model/index")  # the training rows are the model
    kinds = feature_kinds(sample, spec.features)
    manifest = {
        "format": FORMAT, "format_version": VERSION, "run_id": run_id, "contender_key": fitted.contender.key,
        "adapter": fitted.contender.adapter, "proba": fitted.contender.proba, "params": fitted.contender.params,
        "profile": fitted.contender.profile, "classes": fitted.classes, "dataset": dataset, "protocol": protocol,
        "training_rows": training_rows,
        "task": {
            "target": spec.target, "task_type": spec.task_type, "labels": list(spec.labels), "positive": spec.positive,
        },
        "features": {
            "columns": list(spec.features), "numeric": list(kinds.numeric), "datetime": list(kinds.datetime),
            "categorical": list(kinds.categorical),
        },
        "environment": {"pyspark": pyspark.__version__},
        "checksum": folder_checksum(spark, f"{folder}/model"),
    }
    text = spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False, sort_keys=True),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest


def load(spark: SparkSession, folder: str) -> tuple[Fitted | KnnFitted, dict]:
    """Verify the checksum before anything of the model is loaded."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
    if manifest.get("format") != FORMAT or manifest.get("format_version") != VERSION:
        raise RefusedError("artifact_format_unsupported", str(manifest.get("format")))
    if folder_checksum(spark, f"{folder}/model") != manifest["checksum"]:
        raise RefusedError("artifact_checksum_mismatch", folder)
    task = manifest["task"]
    spec = TaskSpec(
        task["target"], task["task_type"], tuple(manifest["features"]["columns"]), tuple(task["labels"]), task["positive"]
    )
    contender = Contender(
        manifest["contender_key"], manifest["adapter"], manifest["profile"], (task["task_type"],), manifest["proba"],
        params=manifest["params"],
    )
    model = PipelineModel.load(f"{folder}/model")
    if contender.adapter == "knn":
        return KnnFitted(contender, spec, model, Neighbours.load(spark, f"{folder}/model/index")), manifest
    return Fitted(contender, spec, model, manifest["classes"]), manifest


def check_columns(columns: list[str], spec: TaskSpec) -> tuple[list[str], list[str]]:
    """(missing, unexpected): a missing column is a refusal, an unexpected one is dropped with a note."""
    return [c for c in spec.features if c not in columns], [c for c in columns if c not in spec.features]


def score(fitted: Fitted | KnnFitted, rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Batch scoring: no ``fit`` on this path, columns in the order the model was trained with."""
    missing, _ = check_columns(rows.columns, fitted.spec)
    if missing:
        raise RefusedError("schema_mismatch", ", ".join(missing))
    ordered = rows.select(*keep, *[c for c in fitted.spec.features if c not in keep])
    if isinstance(fitted, KnnFitted):
        scored = fitted.predict(ordered)
        scored = scored.select(*keep, *[c for c in ("y_pred", "proba") if c in scored.columns])
    else:
        scored = finish(fitted.model.transform(ordered), list(keep), fitted.spec, fitted.contender, fitted.classes)
    return scored.withColumnRenamed("y_pred", "prediction")


def export_csv(scored: DataFrame, labels: tuple[str, ...], path: str) -> None:
    """Predictions with one probability column per class, as CSV."""
    wide = wide_probabilities(scored, labels) if "proba" in scored.columns else scored
    wide.write.mode("overwrite").option("header", "true").csv(path)
