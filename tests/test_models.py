import numpy as np
import pytest
from pyspark.sql import functions as F

from fairfold.ml import artifact as ar
from fairfold.ml import contenders as ct
from fairfold.ml import neighbours as nb
from fairfold.ml import recipe as rc
from fairfold.ml import reports as rp
from fairfold.ml import tournament as tm
from fairfold.operators import diagnostics as dg
from fairfold.operators import errors as er
from fairfold.operators import metrics as mt
from fairfold.plans import compete
from fairfold.spec import Protocol, RefusedError, TaskSpec
from tests.tables import accuracy_folds, numbered, pick

i = F.col("row_id")
BINARY = TaskSpec("y", "binary", ("x",), ("no", "yes"), "yes")
CHURN = TaskSpec("churned", "binary", ("amount", "tenure", "plan"), ("False", "True"), "True")


def churn_rows(spark, n=300):
    amount = (i * 41) % 233
    return numbered(spark, n).select(
        "row_id", (amount * 1.0).alias("amount"), ((i % 37) * 1.0).alias("tenure"), pick(["basic", "pro", "max"]).alias("plan"), (amount > 120).alias("churned")
    )


def test_preprocessing_is_fitted_on_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, "b"), (3.0, "b"), (None, "a"), (100.0, None)], "x double, c string")
    later = spark.createDataFrame([(None, "z"), (1e6, None)], "x double, c string")
    ordinal = rc.fit_recipe(train, ("x", "c"), "tree_ordinal").prepare(later).collect()
    assert [r["num__x"] for r in ordinal] == [3.0, 1e6] and [r["ord__c"] for r in ordinal] == [-1.0, 1.0]
    scaled = rc.fit_recipe(train, ("x", "c"), "scaled_onehot")
    values = np.array([1.0, 3.0, 3.0, 100.0])
    got = [r["num__x"] for r in scaled.prepare(train).collect()]
    assert got == pytest.approx(list((values - values.mean()) / values.std()))
    # b (with the imputed cell) occurs three times, a once: a and unknown values share the last column
    assert scaled.inputs == ["num__x", "cat__c__0", "cat__c__rest"]
    assert [(r["cat__c__0"], r["cat__c__rest"]) for r in scaled.prepare(later).collect()] == [(0.0, 1.0), (1.0, 0.0)]


def test_text_with_quotes_survives(spark):
    df = spark.createDataFrame([("it's",), ("it's",), ("a\\b",), ("a\\b",)], "c string")
    fitted = rc.fit_recipe(df, ("c",), "scaled_onehot")
    assert {(r["c"], r["cat__c__0"], r["cat__c__1"]) for r in fitted.prepare(df).collect()} == {("a\\b", 1.0, 0.0), ("it's", 0.0, 1.0)}


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    y = x @ [2.0, -1.0] + rng.normal(size=80)
    df = spark.createDataFrame([(k, float(a), float(b), float(t)) for k, ((a, b), t) in enumerate(zip(x, y, strict=True))], "row_id long, a double, b double, y double")
    spec = TaskSpec("y", "regression", ("a", "b"))
    rows = ct.with_target(df, spec)
    got = [r["y_pred"] for r in ct.fit(ct.REGISTRY["ridge"], rows, spec, 1).predict(rows).orderBy("row_id").collect()]
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert got == pytest.approx(list(y.mean() + z @ w), abs=1e-6)


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    label = np.where(x[:, 0] > 0, "yes", "no")
    df = spark.createDataFrame([(k, *map(float, v), t) for k, (v, t) in enumerate(zip(x, label, strict=True))], "row_id long, a double, b double, c double, y string")
    spec = TaskSpec("y", "binary", ("a", "b", "c"), ("no", "yes"), "yes")
    rows = ct.with_target(df, spec)
    fitted = ct.fit(ct.REGISTRY["knn"], rows.filter("row_id < 90"), spec, 1)
    got = {r["row_id"]: r["proba"][1] for r in fitted.predict(rows.filter("row_id >= 90")).collect()}
    mean, std = x[:90].mean(0), x[:90].std(0)
    z = (x - mean) / std
    for k in range(90, 120):
        near = np.argsort(((z[:90] - z[k]) ** 2).sum(1))[:15]
        assert got[k] == pytest.approx((label[near] == "yes").mean(), abs=1e-6)


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("run"))
    entries = [
        ct.REGISTRY["baseline_majority"], ct.variant("random_forest", n_estimators=10, max_depth=4), ct.variant("svm_linear", max_iter=10),
        ct.REGISTRY["ridge"], "xgboost",
    ]
    return tm.run(churn_rows(spark), CHURN, Protocol("stratified_k_fold", 2, "stratified", seed=7), entries, run_id="r", path=path, parallel=2)


def test_tournament_states_and_folds(finished):
    predictions, facts, models = finished
    states = {r["contender_key"]: (r["state"], r["error_code"]) for r in facts.collect()}
    assert states["baseline_majority"][0] == states["random_forest"][0] == states["svm_linear"][0] == "SUCCEEDED"
    assert states["ridge"] == ("SKIPPED", "task_not_supported") and states["xgboost"] == ("SKIPPED", "unavailable")
    assert set(models) == {"baseline_majority", "random_forest", "svm_linear"}
    same = predictions.filter("split <> 'train_probe'").groupBy("row_id").agg(F.count_distinct(F.struct("split", "fold")).alias("n"))
    assert same.filter("n <> 1").count() == 0 and same.count() == 300


def test_signal_is_found_and_missing_probabilities_are_named(finished):
    folds = mt.fold_metrics(finished[0], CHURN)
    cv = {(r["contender_key"], r["metric"]): r for r in mt.cross_validated(folds).collect()}
    assert cv[("random_forest", "roc_auc")]["value"] > 0.95 and cv[("baseline_majority", "roc_auc")]["value"] == 0.5
    assert cv[("svm_linear", "roc_auc")]["value"] is None and cv[("svm_linear", "roc_auc")]["note"] == mt.NO_PROBABILITIES


def test_saved_model_scores_without_refit(spark, finished, tmp_path):
    fitted, rows = finished[2]["random_forest"], churn_rows(spark)
    manifest = ar.save(fitted, str(tmp_path), run_id="r", dataset="d", protocol={}, training_rows=240, sample=rows)
    loaded, again = ar.load(spark, str(tmp_path))
    assert again["checksum"] == manifest["checksum"] and loaded.spec.labels == ("False", "True")
    a = fitted.predict(ct.with_target(rows, CHURN)).select("row_id", F.col("proba").alias("p"))
    shuffled = rows.select("plan", "row_id", "tenure", F.lit(1).alias("surplus"), "amount")
    b = ar.score(loaded, shuffled, keep=("row_id",)).select("row_id", F.col("proba").alias("q"))
    assert a.join(b, "row_id").filter("p = q").count() == 300
    with pytest.raises(RefusedError) as error:
        ar.score(loaded, rows.drop("plan"))
    assert error.value.code == "schema_mismatch"


def test_tampered_model_is_not_loaded(spark, finished, tmp_path):
    ar.save(finished[2]["baseline_majority"], str(tmp_path), run_id="r", dataset="d", protocol={}, training_rows=1, sample=churn_rows(spark))
    (tmp_path / "model" / "extra").write_text("x")
    with pytest.raises(RefusedError) as error:
        ar.load(spark, str(tmp_path))
    assert error.value.code == "artifact_checksum_mismatch"


def test_importance_finds_the_column_that_matters(spark, finished):
    got = {r["feature"]: r for r in rp.importance_of_run(
        finished[0].filter("contender_key = 'random_forest'"), churn_rows(spark), finished[2]["random_forest"], CHURN, repeats=3).collect()}
    assert got["amount"]["mean_drop"] > 0.3 and abs(got["plan"]["mean_drop"]) < 0.1
    again = rp.importance_of_run(finished[0].filter("contender_key = 'random_forest'"), churn_rows(spark), finished[2]["random_forest"], CHURN, repeats=3)
    assert {r["feature"]: r["mean_drop"] for r in again.collect()} == {k: v["mean_drop"] for k, v in got.items()}


def test_learning_curve(spark):
    points, skipped = rp.learning_curve(churn_rows(spark), CHURN, Protocol("stratified_k_fold", 2, "stratified"), ct.REGISTRY["baseline_majority"], fractions=(0.05, 0.5, 1.0))
    got = {r["fraction"]: r for r in points.collect()}
    assert [got[f]["train_rows"] for f in (0.05, 0.5, 1.0)] == [20, 60, 120] and got[1.0]["mean"] == 0.5 and skipped.count() == 0
    assert rp.curve_verdict(points, "roc_auc").first()["verdict"] == "plateau"
    with pytest.raises(RefusedError):
        rp.learning_curve(churn_rows(spark), CHURN, Protocol("stratified_k_fold", 11), ct.REGISTRY["baseline_majority"])


@pytest.mark.parametrize("means,spreads,verdict", [
    ([0.5], [0.0], "insufficient"), ([0.5, 0.6], [0.2, 0.2], "noisy"), ([0.5, 0.6], [0.01, 0.01], "growing"), ([0.5, 0.505], [0.001, 0.001], "plateau"),
])
def test_curve_verdicts(spark, means, spreads, verdict):
    rows = [(float(k), 10, 2, m, s) for k, (m, s) in enumerate(zip(means, spreads, strict=True))]
    assert rp.curve_verdict(spark.createDataFrame(rows, rp.POINT), "roc_auc").first()["verdict"] == verdict


# --- diagnostics -----------------------------------------------------------------------------------------------


def test_gap_and_spread(spark):
    p = accuracy_folds(spark, "m", [0.5, 0.9]).unionByName(accuracy_folds(spark, "m", [1.0, 1.0], split="train_probe"))
    summary = dg.gap_summary(dg.fold_gaps(mt.fold_metrics(p, BINARY), "accuracy"), "accuracy")
    got = {r["code"]: (r["severity"], r["evidence"]) for r in dg.gap_findings(summary).collect()}
    assert got["train_validation_gap"] == ("high", 0.3) and got["fold_instability"][0] == "high"
    calm = accuracy_folds(spark, "m", [0.9, 0.9]).unionByName(accuracy_folds(spark, "m", [0.9, 0.9], split="train_probe"))
    assert dg.gap_findings(dg.gap_summary(dg.fold_gaps(mt.fold_metrics(calm, BINARY), "accuracy"), "accuracy")).count() == 0


def test_residual_bias(spark):
    rng = np.random.default_rng(5)
    truth = rng.normal(100, 20, 120)
    rows = [("run", "m", k, "cv", 0, float(t), float(t + e)) for k, (t, e) in enumerate(zip(truth, rng.normal(5, 3, 120), strict=True))]
    p = spark.createDataFrame(rows, "run_id string, contender_key string, row_id long, split string, fold int, y_true double, y_pred double")
    s = dg.residual_summary(p).first()
    errors = np.array([r[6] - r[5] for r in rows])
    assert s["systematic_bias"] and s["q95"] == pytest.approx(np.quantile(errors, 0.95), abs=1e-6)
    by = dg.error_by_target_range(p).collect()
    assert len(by) == 5 and sum(r["n"] for r in by) == 120
    assert dg.error_by_target_range(p.limit(9)).count() == 0


def test_confidence_edge(spark):
    p = accuracy_folds(spark, "m", [1.0]).withColumn("proba", F.array(F.lit(0.4).cast("float"), F.lit(0.6).cast("float")))
    assert dg.confidence_bins(p).first()["bin"] == 3


def test_scarce_and_rare_classes(spark):
    p = accuracy_folds(spark, "m", [1.0], rows=400).filter("y_true = 'no' or row_id < 20")
    got = {r["code"] for r in dg.imbalance_findings(dg.per_class(p, BINARY)).collect()}
    assert got == {"scarce_class", "severe_imbalance"}


def test_error_rows_keep_the_target_out_of_the_features(spark):
    snapshot = numbered(spark, 80).select("row_id", (i * 2).alias("x"), F.lit("t").alias("y"), F.lit("c").alias("other"))
    p = accuracy_folds(spark, "m", [0.5, 0.5])
    rows = er.select_error_rows(p, snapshot, BINARY, "false_positive", limit=5).collect()
    assert len(rows) == 5 and all(r["features"].asDict() == {"x": r["row_id"] * 2} for r in rows)
    assert set(rows[0]["context"].asDict()) == {"y", "other"} and rows[0]["probabilities"]["yes"] == pytest.approx(0.9)
    with pytest.raises(RefusedError):
        er.holdout_rows(p.withColumn("split", F.lit("holdout")), snapshot.filter("row_id > 3"))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_neighbour_index_against_all_pairs(spark, monkeypatch, tmp_path, kind):
    """Clusters, many copies and ties on a grid; small blocks, and blocks sent to several tasks."""
    rng = np.random.default_rng(1)
    clusters = rng.normal(size=(600, 3)) + rng.integers(0, 6, size=(600, 1)) * 5
    x = np.concatenate([clusters, np.zeros((400, 3)), rng.integers(0, 3, size=(200, 3))])
    queries = np.concatenate([x[::17], rng.normal(size=(20, 3)) * 5])
    monkeypatch.setattr(nb, "BLOCK_BYTES", 24 * 32)
    monkeypatch.setattr(nb, "QUERIES_A_TASK", 10)

    def frame(rows):
        return spark.createDataFrame([(k, float(k % 3), [float(v) for v in r]) for k, r in enumerate(rows)], "row_id long, label double, x array<double>")

    index = nb.Neighbours.build(frame(x).withColumn("row_id", F.lpad(F.col("row_id").cast("string"), 6, "0").cast(kind)), 7)
    assert index.rows < 1000 and index.listed["n"].max() <= 32  # of 400 copies each task keeps seven
    index.save(str(tmp_path))
    asked = frame(queries).withColumnRenamed("row_id", "qid")
    for one in (index, nb.Neighbours.load(spark, str(tmp_path))):
        got = {r["qid"]: [(n["distance"], int(n["row_id"]), n["label"]) for n in r["near"]] for r in one.search(asked).collect()}
        distance = ((queries[:, None] - x[None]) ** 2).sum(2)
        order = [np.lexsort((np.arange(len(x)), d))[:7] for d in distance]
        assert got == {q: [(distance[q][j], j, float(j % 3)) for j in near] for q, near in enumerate(order)}


def test_neighbours_prune_blocks(spark, monkeypatch):
    """Far clusters are not visited, and fewer rows than neighbours are all found."""
    monkeypatch.setattr(nb, "BLOCK_BYTES", 16 * 20)
    rows = spark.range(1000).selectExpr("id as row_id", "0D as label", "array((id % 10) * 1000D, (id div 10) * 0.01D) as x")
    index = nb.Neighbours.build(rows, 5)
    asked = rows.where("row_id < 50").selectExpr("row_id as qid", "x")
    first = asked.mapInArrow(index._asked(False), "qid long, block long").groupBy("qid").count()
    assert len(index.listed["n"]) >= 50 and first.agg(F.max("count")).first()[0] <= 3  # some blocks have fewer than five rows
    found = index.search(asked)
    assert found.where("exists(near, n -> n.distance > 0.01)").count() == 0
    rest = asked.withColumn("most", F.lit(0.01)).mapInArrow(index._asked(True), "qid long, block long, most double").groupBy("qid").count()
    assert rest.agg(F.max("count")).first()[0] <= len(index.listed["n"]) / 8
    few = nb.Neighbours.build(rows.where("row_id < 3"), 5).search(asked)
    assert {r["s"] for r in few.selectExpr("size(near) as s").collect()} == {3}
    assert index.search(asked.limit(0)).count() == 0


def test_neighbours_are_saved(spark, tmp_path):
    rows = churn_rows(spark)
    spec = TaskSpec("amount", "regression", ("tenure", "plan"))
    fitted = ct.fit(ct.REGISTRY["knn"], ct.with_target(rows, spec), spec, 1)
    ar.save(fitted, str(tmp_path), run_id="r", dataset="d", protocol={}, training_rows=300, sample=rows)
    loaded, _ = ar.load(spark, str(tmp_path))
    a = ar.score(fitted, rows, keep=("row_id",)).collect()
    assert sorted(a) == sorted(ar.score(loaded, rows, keep=("row_id",)).collect()) and len(a) == 300


def test_queries_meet_bundles_of_blocks(spark, monkeypatch):
    """Visits of the second round send groups and bundles, not a vector a visit; results are those of all pairs."""
    monkeypatch.setattr(nb, "BLOCK_BYTES", 64 * 20)
    monkeypatch.setattr(nb, "GROUP_BYTES", 64 * 60)
    rng = np.random.default_rng(4)
    x, queries = rng.normal(size=(900, 8)).round(1), rng.normal(size=(150, 8)).round(1)

    def frame(rows):
        return spark.createDataFrame([(k, float(k % 3), v.tolist()) for k, v in enumerate(rows)], "row_id long, label double, x array<double>")

    index = nb.Neighbours.build(frame(x), 5)
    asked = frame(queries).selectExpr("row_id as qid", "x")
    most = asked.withColumn("most", F.lit(30.0))
    visits = most.mapInArrow(index._asked(True), "qid long, block long, most double").count()
    sent = []
    deal = type(most).repartition
    monkeypatch.setattr(type(most), "repartition", lambda df, *a: sent.append(df.count()) or deal(df, *a))
    index._visit_together(most).count()
    assert visits > 2000 and sum(sent) < visits / 5
    distance = ((queries[:, None] - x[None]) ** 2).sum(2)
    for q, near in ((r["qid"], r["near"]) for r in index.search(asked).collect()):
        want = np.lexsort((np.arange(900), distance[q]))[:5]
        assert [(n["distance"], n["row_id"]) for n in near] == [(distance[q][j], j) for j in want]


def test_rows_of_a_fit_are_ranked_once(spark, sf):
    a = compete._folded(spark, sf, compete.BINARY, compete.THREE)
    assert "Window" not in a._jdf.queryExecution().toString()
    once = rc.Once()
    made = [rc.fit_recipe(a, ("signal", "o_orderstatus"), p, once=once) for p in ("scaled_onehot", "tree_ordinal")]
    alone = [rc.fit_recipe(a, ("signal", "o_orderstatus"), p) for p in ("scaled_onehot", "tree_ordinal")]
    assert [[s.getStatement() for s in r.stages if hasattr(s, "getStatement")] for r in made] == [[s.getStatement() for s in r.stages if hasattr(s, "getStatement")] for r in alone]
    calls = []
    assert [once("x", lambda: calls.append(1) or 7) for _ in range(3)] == [7, 7, 7] and calls == [1]
