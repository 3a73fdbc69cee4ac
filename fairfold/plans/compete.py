"""Queries that fit models: preprocessing, contenders, tournament, curve, importance, scoring."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from fairfold.ml import artifact as ar
from fairfold.ml import contenders as ct
from fairfold.ml import recipe as rc
from fairfold.ml import reports as rp
from fairfold.ml import tournament as tm
from fairfold.operators import folds as fd
from fairfold.operators import leaderboard as lb
from fairfold.operators import metrics as mt
from fairfold.operators import predictions as pr
from fairfold.plans import derived as d
from fairfold.plans.registry import query, table
from fairfold.plans.setup import K5, KFOLD_SQL
from fairfold.session import balanced, ensure_checkpoint_dir
from fairfold.spec import Objective, Protocol, TaskSpec

BINARY = TaskSpec(
    "urgent", "binary", ("signal", "o_totalprice", "o_orderstatus", "o_orderdate", "sparse_price"), ("no", "yes"), "yes"
)
NUMBER = TaskSpec("o_totalprice", "regression", ("signal", "near_price", "o_orderstatus", "o_orderdate"))
STATUS = TaskSpec("o_orderstatus", "multiclass", ("signal", "status_hint", "o_orderpriority"), ("F", "O", "P"))
THREE = Protocol("stratified_k_fold", 3, "stratified")


def planted(spark, sf):
    """orders with one column that carries part of each target."""
    o = d.orders_task(spark, sf)
    noise = (F.col("row_id") * 7919 % 1000) / 1000.0
    status = F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1.0).otherwise(2.0)
    return o.withColumns({
        "signal": F.when(F.col("urgent") == "yes", 1.0).otherwise(0.0) + noise * 2,
        "near_price": F.col("o_totalprice") * (noise * 0.4 + 0.8),
        "status_hint": status + noise * 1.5,
    })


def scratch(spark) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/fairfold-{uuid.uuid4().hex}"


# --- preprocessing ------------------------------------------------------------------------------------


@query("prepare_median_impute", "WITH " + d.ORDERS_TASK_SQL + """
SELECT row_id, round(coalesce(sparse_price, (SELECT median(sparse_price) FROM orders_task)), 2) AS value FROM orders_task""")
def prepare_median_impute(spark, sf):
    o = d.orders_task(spark, sf)
    fitted = rc.fit_recipe(o, ("sparse_price",), "tree_ordinal")
    return fitted.prepare(o).select("row_id", F.round("num__sparse_price", 2).alias("value"))


@query("prepare_standardise", "WITH " + d.ORDERS_TASK_SQL + """,
f AS (SELECT row_id, coalesce(sparse_price, (SELECT median(sparse_price) FROM orders_task)) AS v, o_custkey * 1e0 AS c FROM orders_task)
SELECT row_id, round((v - (SELECT avg(v) FROM f)) / (SELECT stddev_pop(v) FROM f), 5) AS sparse_price,
       round((c - (SELECT avg(c) FROM f)) / (SELECT stddev_pop(c) FROM f), 5) AS o_custkey, 0e0 AS flat FROM f""")
def prepare_standardise(spark, sf):
    o = d.orders_task(spark, sf).withColumn("flat", F.lit(5.0))
    fitted = rc.fit_recipe(o, ("sparse_price", "o_custkey", "flat"), "scaled_onehot")
    return fitted.prepare(o).select("row_id", *[F.round(f"num__{c}", 5).alias(c) for c in ("sparse_price", "o_custkey", "flat")])


@query("prepare_datetime_parts", """WITH e AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE ts END AS ts FROM events),
p AS (SELECT event_id, day(ts) * 1e0 AS day, (isodow(ts) - 1) * 1e0 AS dow, epoch_us(ts) / 864e8 AS epoch FROM e)
SELECT event_id, coalesce(day, (SELECT median(day) FROM p)) AS day, coalesce(dow, (SELECT median(dow) FROM p)) AS dow,
       round(coalesce(epoch, (SELECT median(epoch) FROM p)), 5) AS epoch FROM p""")
def prepare_datetime_parts(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 6 != 0, F.col("ts")).alias("ts"))
    fitted = rc.fit_recipe(e, ("ts",), "tree_ordinal")
    return fitted.prepare(e).select(
        "event_id", F.col("num__ts__day").alias("day"), F.col("num__ts__dayofweek").alias("dow"), F.round("num__ts__epoch_days", 5).alias("epoch")
    )


@query("prepare_mode_impute", """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer)
SELECT c_custkey, coalesce(seg, (SELECT seg FROM c WHERE seg IS NOT NULL GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1)) AS seg FROM c""")
def prepare_mode_impute(spark, sf):
    c = table(spark, sf, "customer").withColumn("seg", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")))
    fitted = rc.fit_recipe(c, ("seg",), "tree_ordinal")
    return fitted.prepare(c).select("c_custkey", F.col("text__seg").alias("seg"))


# user ids are more than 50 categories: 49 keep a column, the others share one
@query("prepare_one_hot", """WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS u FROM events),
n AS (SELECT u, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, u DESC) AS place FROM e GROUP BY u),
kept AS (SELECT u FROM n WHERE n >= 2 AND place <= CASE WHEN (SELECT count(*) FROM n WHERE n >= 2) + 1 > 50 THEN 49 ELSE 50 END)
SELECT event_id, CASE WHEN kept.u IS NULL THEN 'rest' ELSE kept.u END AS category FROM e LEFT JOIN kept USING (u)""")
def prepare_one_hot(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("u"))
    fitted = rc.fit_recipe(e, ("u",), "scaled_onehot")
    words = rc.fit_categories(e, ("u",), ordinal=False)["u"].frequent
    hot = F.coalesce(*[F.when(F.col(f"cat__u__{i}") == 1, F.lit(w)) for i, w in enumerate(words)], F.when(F.col("cat__u__rest") == 1, F.lit("rest")))
    return fitted.prepare(e).select("event_id", hot.alias("category"))


# fitted without one segment: that one is unknown later
@query("prepare_ordinal", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN -1e0 ELSE
  (SELECT count(DISTINCT x.c_mktsegment) FROM customer x WHERE x.c_mktsegment <> 'BUILDING' AND x.c_mktsegment < customer.c_mktsegment) * 1e0 END AS code FROM customer""")
def prepare_ordinal(spark, sf):
    c = table(spark, sf, "customer")
    fitted = rc.fit_recipe(c.filter("c_mktsegment <> 'BUILDING'"), ("c_mktsegment",), "tree_ordinal")
    return fitted.prepare(c).select("c_custkey", F.col("ord__c_mktsegment").alias("code"))


@query("prepare_native_missing", "WITH " + d.ORDERS_TASK_SQL + " SELECT row_id, round(coalesce(sparse_price, -999999), 2) AS value, CASE WHEN sparse_price IS NULL THEN 1e0 ELSE 0e0 END AS gap FROM orders_task")
def prepare_native_missing(spark, sf):
    o = d.orders_task(spark, sf)
    fitted = rc.fit_recipe(o, ("sparse_price",), "native_missing")
    return fitted.prepare(o).select("row_id", F.round("num__sparse_price", 2).alias("value"), F.col("gap__sparse_price").alias("gap"))


# --- single contenders -------------------------------------------------------------------------------------


def _folded(spark, sf, spec, protocol):
    keep = tuple(dict.fromkeys([*spec.features, spec.target]))
    # every pass of a fit reads these rows: ranked once and kept
    ensure_checkpoint_dir(spark)
    return ct.with_target(fd.assign(planted(spark, sf), spec, protocol, keep=keep), spec).drop(spec.target).checkpoint()


@query("model_baseline_majority", "WITH " + KFOLD_SQL + """,
t AS (SELECT f, urgent, count(*) AS n FROM assigned JOIN orders_task USING (row_id), range(5) r(f) WHERE part = 'pool' AND chunk <> f GROUP BY ALL),
w AS (SELECT f, first(urgent ORDER BY n DESC, urgent) AS guess FROM t GROUP BY f)
SELECT CAST(f AS INTEGER) AS fold, row_id, guess AS y_pred, CASE WHEN guess = 'yes' THEN 1e0 ELSE 0e0 END AS p_yes FROM assigned JOIN w ON chunk = f WHERE part = 'pool'""")
def model_baseline_majority(spark, sf):
    spec = TaskSpec("urgent", "binary", ("signal",), ("no", "yes"), "yes")
    a = _folded(spark, sf, spec, K5)
    parts = []
    for fold in range(5):
        fitted = ct.fit(ct.REGISTRY["baseline_majority"], a.filter(fd.train_of(fold, K5)), spec, 42)
        parts.append(fitted.predict(a.filter(fd.validation_of(fold, K5))).select(
            F.lit(fold).alias("fold"), "row_id", "y_pred", F.get("proba", F.lit(1)).cast("double").alias("p_yes")))
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p)
    return united


@query("model_baseline_median", "WITH " + KFOLD_SQL + """,
m AS (SELECT f, median(o_totalprice) AS guess FROM assigned JOIN orders_task USING (row_id), range(5) r(f) WHERE part = 'pool' AND chunk <> f GROUP BY f)
SELECT CAST(f AS INTEGER) AS fold, round(guess, 3) AS guess, count(*) AS n FROM assigned JOIN m ON chunk = f WHERE part = 'pool' GROUP BY ALL""")
def model_baseline_median(spark, sf):
    spec = TaskSpec("o_totalprice", "regression", ("signal",))
    a = _folded(spark, sf, spec, K5)
    parts = []
    for fold in range(5):
        fitted = ct.fit(ct.REGISTRY["baseline_median"], a.filter(fd.train_of(fold, K5)), spec, 42)
        parts.append(fitted.predict(a.filter(fd.validation_of(fold, K5))).select(F.lit(fold).alias("fold"), "y_pred"))
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p)
    return united.groupBy("fold", F.round("y_pred", 3).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


# ridge on one standardised feature has a closed form
@query("model_ridge", "WITH " + d.ORDERS_TASK_SQL + """,
x AS (SELECT row_id, o_custkey * 1e0 AS x, o_totalprice AS y FROM orders_task),
s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n FROM x),
b AS (SELECT sum((x - mx) / sx * (y - my)) / (max(n) + 1e0) AS b FROM x, s)
SELECT row_id, round(my + b * (x - mx) / sx, 3) AS y_pred FROM x, s, b""")
def model_ridge(spark, sf):
    spec = TaskSpec("o_totalprice", "regression", ("o_custkey",))
    rows = ct.with_target(d.orders_task(spark, sf).select("row_id", "o_custkey", "o_totalprice"), spec)
    fitted = ct.fit(ct.REGISTRY["ridge"], rows, spec, 42)
    return fitted.predict(rows).select("row_id", F.round("y_pred", 3).alias("y_pred"))


def _one_fold(spark, sf, contender, spec):
    protocol = Protocol("stratified_k_fold" if spec.is_classification else "k_fold", 3, "stratified" if spec.is_classification else "random")
    a = _folded(spark, sf, spec, protocol)
    fitted = ct.fit(contender, a.filter(fd.train_of(0, protocol)), spec, 42)
    scored = fitted.predict(a.filter(fd.validation_of(0, protocol)))
    out = [F.lit("r").alias("run_id"), F.lit(contender.key).alias("contender_key"), "row_id", F.lit("cv").alias("split"),
           F.lit(0).alias("fold"), F.col("y").alias("y_true"), "y_pred"]
    return mt.fold_metrics(scored.select(*out, *(["proba"] if "proba" in scored.columns else [])), spec).select("contender_key", "metric", "value", "note", "n_rows")


@query("model_logistic")
def model_logistic(spark, sf):
    return _one_fold(spark, sf, ct.REGISTRY["logistic_regression"], BINARY)


@query("model_logistic_multiclass")
def model_logistic_multiclass(spark, sf):
    return _one_fold(spark, sf, ct.REGISTRY["logistic_regression"], STATUS)


@query("model_random_forest")
def model_random_forest(spark, sf):
    return _one_fold(spark, sf, ct.variant("random_forest", n_estimators=10, max_depth=6), BINARY)


@query("model_boosting")
def model_boosting(spark, sf):
    return _one_fold(spark, sf, ct.variant("hist_gradient_boosting", max_iter=5, max_depth=3), BINARY)


@query("model_boosting_multiclass")
def model_boosting_multiclass(spark, sf):
    return _one_fold(spark, sf, ct.variant("hist_gradient_boosting", max_iter=3, max_depth=3), STATUS)


@query("model_svm_linear")
def model_svm_linear(spark, sf):
    return _one_fold(spark, sf, ct.variant("svm_linear", max_iter=20), BINARY)


# brute force over all pairs in SQL; standardised by the training side, 15 neighbours
@query("model_nearest_neighbours", """
WITH h AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY 1 ORDER BY md5('42:order:' || vec_id), vec_id) AS r, count(*) OVER () AS n FROM embeddings),
pool AS (SELECT *, ntile(5) OVER (ORDER BY r) - 1 AS chunk FROM h WHERE r > ceil(2e-1 * n)),
cells AS (SELECT vec_id, label, chunk, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM pool),
scale AS (SELECT d, avg(x) AS m, stddev_pop(x) AS s FROM cells WHERE chunk <> 0 GROUP BY d),
z AS (SELECT vec_id, label, chunk, d, (x - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS z FROM cells JOIN scale USING (d)),
pairs AS (SELECT q.vec_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY sum(power(q.z - t.z, 2))) AS place
          FROM z q JOIN z t ON q.d = t.d AND q.chunk = 0 AND t.chunk <> 0 GROUP BY q.vec_id, t.vec_id, t.label),
votes AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, count(*) / 15e0 AS share FROM pairs WHERE place <= 15 GROUP BY 1, 2),
best AS (SELECT vec_id, first(label ORDER BY share DESC, label) AS y_pred, max(share) AS share FROM votes GROUP BY vec_id)
SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS y, y_pred, round(CAST(CAST(share AS FLOAT) AS DOUBLE), 6) AS share FROM best JOIN embeddings USING (vec_id)""")
def model_nearest_neighbours(spark, sf):
    """Label of an embedding from its nearest embeddings."""
    return _neighbours(spark, sf, (0,))


def _neighbours(spark, sf, folds):
    e = table(spark, sf, "embeddings")
    size = len(e.select("embedding").first()["embedding"])
    wide = e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("kind"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(size)])
    labels = tuple(r["kind"] for r in wide.select("kind").distinct().orderBy("kind").collect())
    spec = TaskSpec("kind", "multiclass", tuple(f"e{i}" for i in range(size)), labels)
    assigned = fd.assign(wide, spec, K5, keep=(*spec.features, "kind"))
    ensure_checkpoint_dir(spark)
    rows = ct.with_target(assigned, spec).drop("kind").checkpoint()  # every pass of every fold reads them
    parts = []
    for fold in folds:
        fitted = ct.fit(ct.REGISTRY["knn"], rows.filter(fd.train_of(fold, K5)), spec, 42)
        if fold:  # the index is the model: it scores from its saved files
            folder = scratch(spark)
            ar.save(fitted, folder, run_id="run-1", dataset="embeddings", protocol={}, training_rows=fitted.index.rows, sample=assigned)
            fitted, _ = ar.load(spark, folder)
        parts.append(fitted.predict(rows.filter(fd.validation_of(fold, K5))).select("row_id", "y", "y_pred", F.round(F.array_max("proba").cast("double"), 6).alias("share")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("model_nearest_neighbours_folds", """
WITH h AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY 1 ORDER BY md5('42:order:' || vec_id), vec_id) AS r, count(*) OVER () AS n FROM embeddings),
pool AS (SELECT *, ntile(5) OVER (ORDER BY r) - 1 AS chunk FROM h WHERE r > ceil(2e-1 * n)),
cells AS (SELECT vec_id, label, chunk, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM pool),
scale AS (SELECT f.chunk AS fold, d, avg(x) AS m, stddev_pop(x) AS s FROM cells JOIN (SELECT DISTINCT chunk FROM pool) f ON cells.chunk <> f.chunk GROUP BY ALL),
z AS (SELECT fold, vec_id, label, chunk, list((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END ORDER BY d) AS z FROM cells JOIN scale USING (d) GROUP BY ALL),
pairs AS (SELECT q.vec_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.z, t.z), t.vec_id) AS place
          FROM z q JOIN z t ON q.fold = t.fold AND q.chunk = q.fold AND t.chunk <> t.fold),
votes AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, count(*) / 15e0 AS share FROM pairs WHERE place <= 15 GROUP BY 1, 2),
best AS (SELECT vec_id, first(label ORDER BY share DESC, label) AS y_pred, max(share) AS share FROM votes GROUP BY vec_id)
SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS y, y_pred, round(CAST(CAST(share AS FLOAT) AS DOUBLE), 6) AS share FROM best JOIN embeddings USING (vec_id)""")
def model_nearest_neighbours_folds(spark, sf):
    """The same for all five folds; from the second on the saved model answers."""
    return _neighbours(spark, sf, range(K5.n_splits))


@query("model_regression_contenders")
def model_regression_contenders(spark, sf):
    a = _one_fold(spark, sf, ct.variant("random_forest", n_estimators=5, max_depth=5), NUMBER)
    b = _one_fold(spark, sf, ct.variant("hist_gradient_boosting", max_iter=3, max_depth=3), NUMBER)
    return a.unionByName(b)


# --- whole runs --------------------------------------------------------------------------------------------


def _run(spark, sf, spec=BINARY, contenders=None, protocol=THREE):
    entries = contenders or [
        ct.REGISTRY["baseline_majority"], ct.variant("logistic_regression", max_iter=20),
        ct.variant("random_forest", n_estimators=5, max_depth=5), "xgboost",
    ]
    return tm.run(planted(spark, sf), spec, protocol, entries, run_id="run-1", path=scratch(spark), parallel=3)


@query("tournament_states", """SELECT 'baseline_majority' AS contender_key, 'SUCCEEDED' AS state, CAST(NULL AS VARCHAR) AS error_code, 'complete' AS coverage UNION ALL
SELECT 'logistic_regression', 'SUCCEEDED', NULL, 'complete' UNION ALL SELECT 'random_forest', 'SUCCEEDED', NULL, 'complete' UNION ALL
SELECT 'xgboost', 'SKIPPED', 'unavailable', NULL""")
def tournament_states(spark, sf):
    return _run(spark, sf)[1].select("contender_key", "state", "error_code", "coverage")


@query("tournament_row_counts", """WITH n AS (SELECT count(*) AS n, CAST(ceil(2e-1 * count(*)) AS BIGINT) AS held FROM orders)
SELECT contender_key, 'cv' AS split, n - held AS n_rows FROM n, (VALUES ('baseline_majority'), ('logistic_regression')) c(contender_key)
UNION ALL SELECT contender_key, 'holdout', held FROM n, (VALUES ('baseline_majority'), ('logistic_regression')) c(contender_key)
UNION ALL SELECT contender_key, 'train_probe', CAST(3 * least(2000, floor((n - held) * 2 / 3e0)) AS BIGINT) FROM n, (VALUES ('baseline_majority'), ('logistic_regression')) c(contender_key)""")
def tournament_row_counts(spark, sf):
    p, _, _ = _run(spark, sf, contenders=[ct.REGISTRY["baseline_majority"], ct.variant("logistic_regression", max_iter=5)])
    return p.groupBy("contender_key", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@query("tournament_leaderboard")
def tournament_leaderboard(spark, sf):
    p, facts, _ = _run(spark, sf)
    folds = mt.fold_metrics(p, BINARY)
    return lb.leaderboard(folds, facts.select("run_id", "contender_key", "is_baseline", "state", "cost"), Objective.default("binary")).select(
        "contender_key", "rank", "score", "eligible", "reason", "baseline_mean_difference", "baseline_stable"
    )


@query("tournament_forward_chaining", """SELECT 'baseline_median' AS contender_key, 'SUCCEEDED' AS state, 'first_period_only_trains' AS coverage UNION ALL SELECT 'ridge', 'SUCCEEDED', 'first_period_only_trains'""")
def tournament_forward_chaining(spark, sf):
    spec = TaskSpec("o_totalprice", "regression", ("signal", "near_price"), time="o_orderdate")
    _, facts, _ = _run(spark, sf, spec, [ct.REGISTRY["baseline_median"], ct.REGISTRY["ridge"]], Protocol("forward_chaining", 3, "temporal"))
    return facts.select("contender_key", "state", "coverage")


@query("report_learning_curve")
def report_learning_curve(spark, sf):
    ensure_checkpoint_dir(spark)
    points, _ = rp.learning_curve(planted(spark, sf), BINARY, Protocol("stratified_k_fold", 2, "stratified"), ct.variant("logistic_regression", max_iter=10))
    return points


@query("report_learning_curve_verdict")
def report_learning_curve_verdict(spark, sf):
    ensure_checkpoint_dir(spark)
    points, _ = rp.learning_curve(
        planted(spark, sf), BINARY, Protocol("stratified_k_fold", 2, "stratified"), ct.variant("logistic_regression", max_iter=10), fractions=(0.5, 1.0)
    )
    return rp.curve_verdict(points, "roc_auc")


@query("report_permutation_importance")
def report_permutation_importance(spark, sf):
    a = _folded(spark, sf, BINARY, THREE)
    fitted = ct.fit(ct.variant("logistic_regression", max_iter=20), a.filter("part = 'pool'"), BINARY, 42)
    return rp.permutation_importance(fitted, a.filter("part = 'holdout'"), BINARY, repeats=3)


@query("score_saved_model", """SELECT o_orderkey AS row_id FROM orders""")
def score_saved_model(spark, sf):
    rows, folder = planted(spark, sf), scratch(spark)
    train = ct.with_target(rows, BINARY)
    fitted = ct.fit(ct.variant("logistic_regression", max_iter=10), train, BINARY, 42)
    ar.save(fitted, folder, run_id="run-1", dataset="orders", protocol={}, training_rows=0, sample=rows)
    loaded, _ = ar.load(spark, folder)
    before = fitted.predict(train).select("row_id", F.col("y_pred").alias("a"))
    after = ar.score(loaded, rows, keep=("row_id",)).select("row_id", F.col("prediction").alias("b"))
    return before.join(after, "row_id").filter("a = b").select("row_id")


@query("score_export_csv", """SELECT count(*) AS n, count(*) AS with_probabilities FROM orders""")
def score_export_csv(spark, sf):
    rows, folder = planted(spark, sf), scratch(spark)
    train = ct.with_target(rows, BINARY)
    fitted = ct.fit(ct.REGISTRY["baseline_majority"], train, BINARY, 42)
    ar.export_csv(ar.score(fitted, rows, keep=("row_id",)), BINARY.labels, f"{folder}/scored")
    back = spark.read.option("header", "true").option("inferSchema", "true").csv(f"{folder}/scored")
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("proba__no") + F.col("proba__yes") - 1) < 1e-3).alias("with_probabilities"))


@query("predictions_sink", "WITH " + d.BINARY_SQL + " SELECT contender_key, split, count(*) AS n FROM bin GROUP BY ALL")
def predictions_sink(spark, sf):
    path = f"{scratch(spark)}/predictions"
    # each task sorts its rows by folder: dealt first, a task's rows do not grow with the table
    balanced(d.binary_predictions(spark, sf), "row_id").write.partitionBy("run_id", "contender_key").option("compression", "zstd").parquet(path)
    back = pr.require_columns(spark.read.parquet(path))
    return back.groupBy("contender_key", "split").agg(F.count(F.lit(1)).alias("n"))


@query("assignments_sink", "WITH " + KFOLD_SQL + " SELECT part, chunk, count(*) AS n FROM assigned GROUP BY ALL")
def assignments_sink(spark, sf):
    path = f"{scratch(spark)}/assignments"
    fd.assign(d.orders_task(spark, sf), BINARY, K5).write.parquet(path)
    return spark.read.parquet(path).groupBy("part", "chunk").agg(F.count(F.lit(1)).alias("n"))


