"""The models that can compete, as recipes around Spark ML estimators.

A fitted contender is a ``PipelineModel`` that adds ``guess`` (label text or number) and, where the
model gives probabilities, ``proba`` in canonical label order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairfold import fixed
from fairfold.functions.scalars import dtype_of, label_text
from fairfold.ml.neighbours import Neighbours
from fairfold.ml.recipe import Once, fit_recipe, sql_number, sql_text
from fairfold.operators.predictions import align_probabilities, labels_literal
from fairfold.operators.ranking import exact_quantiles
from fairfold.spec import RefusedError, TaskSpec


@dataclass(frozen=True)
class Contender:
    key: str
    adapter: str
    profile: str
    tasks: tuple[str, ...]
    proba: bool = True
    is_baseline: bool = False
    params: dict[str, Any] = field(default_factory=dict)
    cost: float = 1.0

    def supports(self, spec: TaskSpec) -> bool:
        return spec.task_type in self.tasks


CLASSES = ("binary", "multiclass")
BOTH = (*CLASSES, "regression")

# fixed values: default parameters and the order in which contenders enter
REGISTRY = {
    c.key: c
    for c in (
        Contender("baseline_majority", "majority", "passthrough_dummy", CLASSES, is_baseline=True, cost=0.0),
        Contender("baseline_median", "median", "passthrough_dummy", ("regression",), False, True, cost=0.0),
        Contender("logistic_regression", "logistic", "scaled_onehot", CLASSES, params={"max_iter": 100, "c": 1.0}),
        Contender("ridge", "ridge", "scaled_onehot", ("regression",), False, params={"alpha": 1.0}),
        Contender(
            "random_forest", "forest", "tree_ordinal", BOTH,
            params={"n_estimators": 200, "max_depth": 14, "min_samples_leaf": 2}, cost=10.0,
        ),
        Contender("hist_gradient_boosting", "boosting", "native_missing", BOTH, params={"max_iter": 200, "learning_rate": 0.1}, cost=5.0),
        Contender("svm_linear", "svm", "scaled_onehot", CLASSES, False, params={"max_iter": 100}),
        Contender("knn", "knn", "scaled_onehot", BOTH, params={"n_neighbors": fixed.KNN_NEIGHBOURS}, cost=20.0),
    )
}
# known elsewhere but without a Spark estimator here: reported, never silently dropped
UNAVAILABLE = ("xgboost", "lightgbm", "catboost", "svm_rbf", "extra_trees")


def variant(key: str, name: str | None = None, **params: Any) -> Contender:
    """A registered contender with other parameters, under its own name."""
    base = REGISTRY[key]
    return Contender(
        name or key, base.adapter, base.profile, base.tasks, base.proba, base.is_baseline, {**base.params, **params}, base.cost
    )


def with_target(df: DataFrame, spec: TaskSpec) -> DataFrame:
    """Adds ``y`` (what is compared) and ``label`` (what is fitted, with its classes as metadata)."""
    if not spec.is_classification:
        y = F.col(spec.target).cast("double")
        return df.withColumn("y", y).withColumn("label", y)
    text = label_text(spec.target, dtype_of(df, spec.target))
    meta = {"ml_attr": {"type": "nominal", "name": "label", "vals": list(spec.labels)}}
    index = (F.array_position(labels_literal(spec.labels), F.col("y")) - 1).cast("double")
    return df.withColumn("y", text).withColumn("label", index.alias("label", metadata=meta))


class Fitted:
    """A fitted contender that predicts lazily and can be saved."""

    def __init__(self, contender: Contender, spec: TaskSpec, model: PipelineModel, classes: list[str]) -> None:
        self.contender, self.spec, self.model, self.classes = contender, spec, model, classes

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` plus y_pred and, for classification, proba."""
        return finish(self.model.transform(rows), rows.columns, self.spec, self.contender, self.classes)


def finish(scored: DataFrame, keep: list[str], spec: TaskSpec, contender: Contender, classes: list[str]) -> DataFrame:
    columns = [F.col(c) for c in keep]
    if not spec.is_classification:
        return scored.select(*columns, F.col("prediction").cast("double").alias("y_pred"))
    if "prediction" not in scored.columns:
        scored = _combine(scored, spec)
    known = labels_literal(spec.labels)
    guess = F.get(known, F.col("prediction").cast("int"))
    proba = F.lit(None).cast("array<float>")
    if contender.proba:
        vector = F.col("probability")
        given = vector if dict(scored.dtypes)["probability"].startswith("array") else vector_to_array(vector)
        proba = align_probabilities(given, classes, spec.labels)
    return scored.select(*columns, guess.alias("y_pred"), proba.alias("proba"))


def _majority(train: DataFrame, spec: TaskSpec) -> PipelineModel:
    """The most frequent class, smallest label on ties, with all probability mass on it."""
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    winner = counts.agg(F.min_by("label", F.struct(-F.col("n"), F.col("label")))).first()[0]
    if winner is None:
        raise RefusedError("fit_failed", "no training rows")
    mass = ", ".join("1D" if i == int(winner) else "0D" for i in range(len(spec.labels)))
    sql = f"SELECT *, {sql_number(winner)} AS prediction, array({mass}) AS probability FROM __THIS__"
    return PipelineModel([SQLTransformer(statement=sql)])


def _median(train: DataFrame, spec: TaskSpec) -> PipelineModel:
    middle = exact_quantiles(train.select("label"), {"label": [0.5]})["label"][0]
    if middle is None:
        raise RefusedError("fit_failed", "no training rows")
    return PipelineModel([SQLTransformer(statement=f"SELECT *, {sql_number(middle)} AS prediction FROM __THIS__")])


def _estimator(contender: Contender, spec: TaskSpec, train: DataFrame, seed: int):
    p = contender.params
    names = {"featuresCol": "features", "labelCol": "label"}
    if contender.adapter == "logistic":
        # an unscaled L2 penalty of strength 1/c per total loss is 1/(c n) per mean loss
        return LogisticRegression(maxIter=p["max_iter"], regParam=1.0 / (p["c"] * max(1, train.count())), standardization=False, **names)
    if contender.adapter == "ridge":
        # the solver penalises in units of the label's deviation
        row = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
        strength = p["alpha"] * (row["s"] or 0.0) / max(1, row["n"])
        return LinearRegression(elasticNetParam=0.0, standardization=False, solver="normal", regParam=strength, **names)
    if contender.adapter == "forest":
        build = RandomForestClassifier if spec.is_classification else RandomForestRegressor
        return build(
            numTrees=p["n_estimators"], maxDepth=p["max_depth"], minInstancesPerNode=p["min_samples_leaf"], seed=seed,
            cacheNodeIds=False, **names,
        )
    if contender.adapter == "boosting":
        common = {"maxIter": p["max_iter"], "stepSize": p["learning_rate"], "maxDepth": p.get("max_depth", 5), "seed": seed}
        if not spec.is_classification:
            return GBTRegressor(**common, **names)
        return GBTClassifier(**common, **names)
    if contender.adapter == "svm":
        return LinearSVC(maxIter=p["max_iter"], regParam=1e-3, **names)
    raise RefusedError("unknown_adapter", contender.adapter)


def fit(contender: Contender, train: DataFrame, spec: TaskSpec, seed: int, once: Once | None = None) -> Fitted | KnnFitted:
    """Fit on training rows (with ``y`` and ``label``); nothing else is ever looked at.

    ``once`` is shared by contenders that are fitted on the same rows.
    """
    if not contender.supports(spec):
        raise RefusedError("task_not_supported", f"{contender.key} for {spec.task_type}")
    if contender.adapter == "majority":
        return Fitted(contender, spec, _majority(train, spec), list(spec.labels))
    if contender.adapter == "median":
        return Fitted(contender, spec, _median(train, spec), [])
    recipe = fit_recipe(train, spec.features, contender.profile, once=once)
    prepared = train
    for stage in recipe.stages:
        prepared = stage.transform(prepared)
    prepared = prepared.select("row_id", "label", "features")
    if contender.adapter == "knn":
        points = prepared.select("row_id", "label", vector_to_array("features").alias("x"))
        return KnnFitted(contender, spec, PipelineModel(recipe.stages), Neighbours.build(points, contender.params["n_neighbors"]))
    if spec.is_classification and train.select("label").distinct().limit(2).count() < 2:
        raise RefusedError("fit_failed", "one class in the training rows")
    # the fit makes several passes over the assembled vectors; spilling to disk is fine
    prepared = prepared.persist()
    try:
        estimator = _estimator(contender, spec, prepared, seed)
        if spec.task_type == "multiclass" and contender.adapter in ("boosting", "svm"):
            models = _one_against_rest(estimator, prepared, spec)
        else:
            models = [estimator.fit(prepared)]
    finally:
        prepared.unpersist()
    return Fitted(contender, spec, PipelineModel([*recipe.stages, *models]), list(spec.labels))


def _one_against_rest(estimator, prepared: DataFrame, spec: TaskSpec) -> list:
    """A binary model per class seen in training, each with output columns of its own."""
    seen = {int(r["label"]) for r in prepared.select("label").distinct().collect()}  # at most the classes
    models = []
    for i in sorted(seen):
        names = {"labelCol": "one", "rawPredictionCol": f"raw_{i}", "predictionCol": f"prediction_{i}"}
        if estimator.hasParam("probabilityCol"):
            names["probabilityCol"] = f"probability_{i}"
        one = estimator.copy({estimator.getParam(k): v for k, v in names.items()})
        models.append(one.fit(prepared.withColumn("one", (F.col("label") == i).cast("double"))))
    return models


def _combine(scored: DataFrame, spec: TaskSpec) -> DataFrame:
    """One-against-rest scores as a prediction and, where there are any, normalised probabilities.

    A class without training rows has no model and gets no mass.
    """
    given = any(c.startswith("probability_") for c in scored.columns)
    prefix = "probability" if given else "raw"
    absent = F.lit(0.0 if given else float("-inf"))
    every = F.array(*[
        F.get(vector_to_array(f"{prefix}_{i}"), F.lit(1)) if f"{prefix}_{i}" in scored.columns else absent
        for i in range(len(spec.labels))
    ])
    scored = scored.withColumn("__every", every)
    best = (F.array_position("__every", F.array_max("__every")) - 1).cast("double")
    scored = scored.withColumn("prediction", best)
    if not given:
        return scored
    total = F.aggregate("__every", F.lit(0.0), lambda a, b: a + b)
    return scored.withColumn("probability", F.transform("__every", lambda s: s / total))


class KnnFitted:
    """Exact nearest neighbours over an index of all training rows (see ``neighbours``).

    Equal distances are ordered by row id.  Votes count alike; of classes with equal votes the first wins.
    Searching runs jobs of its own, so ``predict`` is not lazy.
    """

    def __init__(self, contender: Contender, spec: TaskSpec, recipe: PipelineModel, index: Neighbours) -> None:
        self.contender, self.spec, self.model, self.index = contender, spec, recipe, index
        self.classes = list(spec.labels)

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` plus y_pred and, for classification, proba."""
        spec, keep = self.spec, rows.columns
        query, near = free_name(keep, "query"), free_name(keep, "near")
        # numbered once and kept: the search reads them several times
        wide = self.model.transform(rows).select(*keep, vector_to_array("features").alias(near), F.monotonically_increasing_id().alias(query)).checkpoint()
        found = self.index.search(wide.select(F.col(query).alias("qid"), F.col(near).alias("x"))).select(F.col("qid").alias(query), F.col("near").alias(near))
        scored = wide.drop(near).join(found, query)
        label = F.transform(near, lambda n: n["label"])
        if not spec.is_classification:
            total = F.aggregate(label, F.lit(0.0), lambda a, b: a + b)
            return finish(scored.withColumn("prediction", total / F.size(label)), keep, spec, self.contender, self.classes)
        share = F.transform(F.sequence(F.lit(0), F.lit(len(spec.labels) - 1)), lambda c: F.size(F.filter(label, lambda x: x == c)) / F.size(label))
        scored = scored.withColumn("probability", share)
        best = F.array_position("probability", F.array_max("probability")) - 1
        return finish(scored.withColumn("prediction", best.cast("double")), keep, spec, self.contender, self.classes)


def free_name(taken: list[str], name: str) -> str:
    while name in taken:
        name += "_"
    return name
