"""Queries for diagnostics, error rows and prediction checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairfold import fixed
from fairfold.operators import diagnostics as dg
from fairfold.operators import errors as er
from fairfold.operators import folds as fd
from fairfold.operators import metrics as mt
from fairfold.operators import predictions as pr
from fairfold.plans import derived as d
from fairfold.plans.measure import BIN_FOLDS_SQL
from fairfold.plans.registry import query, table
from fairfold.plans.setup import K5
from fairfold.spec import TaskSpec

# the same metrics with the training probes included
ALL_FOLDS_SQL = BIN_FOLDS_SQL.replace("AS score FROM bin)", "AS score FROM bin_every)")


def _probed_folds(spark, sf):
    return mt.fold_metrics(d.binary_predictions(spark, sf, probes=True), d.BINARY)


GAPS_SQL = ALL_FOLDS_SQL + """,
gaps AS (
  SELECT v.contender_key, v.fold, v.value AS validation_score, t.value AS train_score, round(t.value - v.value, 6) AS gap
  FROM folds v LEFT JOIN folds t ON t.metric = v.metric AND t.split = 'train_probe' AND t.contender_key = v.contender_key AND t.fold = v.fold
  WHERE v.split = 'cv' AND v.metric = 'roc_auc')"""


@query("diagnostics_fold_gaps", "WITH " + GAPS_SQL + " SELECT * FROM gaps")
def diagnostics_fold_gaps(spark, sf):
    return dg.fold_gaps(_probed_folds(spark, sf), "roc_auc").select("contender_key", "fold", "validation_score", "train_score", "gap")


@query("diagnostics_gap_summary", "WITH " + GAPS_SQL + """,
s AS (SELECT contender_key, round(avg(validation_score), 6) AS mean_validation, round(stddev_pop(validation_score), 6) AS spread,
             round(avg(gap), 6) AS mean_gap, avg(train_score) AS mean_train FROM gaps GROUP BY 1)
SELECT contender_key, mean_validation, spread, mean_gap,
  CASE WHEN mean_gap IS NULL OR mean_gap <= 0 THEN 'info' WHEN abs(mean_gap / mean_train) >= 25e-2 OR mean_gap >= 15e-2 THEN 'high'
       WHEN abs(mean_gap / mean_train) >= 1e-1 OR mean_gap >= 5e-2 THEN 'caution' ELSE 'info' END AS gap_severity,
  CASE WHEN abs(spread / mean_validation) >= 25e-2 THEN 'high' WHEN abs(spread / mean_validation) >= 1e-1 THEN 'caution' ELSE 'info' END AS spread_severity
FROM s""")
def diagnostics_gap_summary(spark, sf):
    summary = dg.gap_summary(dg.fold_gaps(_probed_folds(spark, sf), "roc_auc"), "roc_auc")
    return summary.select("contender_key", "mean_validation", "spread", "mean_gap", "gap_severity", "spread_severity")


@query("diagnostics_gap_findings", "WITH " + GAPS_SQL + """,
s AS (SELECT contender_key, round(avg(gap), 6) AS g, avg(train_score) AS t, sum(CASE WHEN validation_score IS NULL THEN 1e0 ELSE 0e0 END) AS u FROM gaps GROUP BY 1)
SELECT contender_key, 'train_validation_gap' AS code, CASE WHEN g / t >= 25e-2 OR g >= 15e-2 THEN 'high' ELSE 'caution' END AS severity, g AS evidence FROM s WHERE g > 0 AND (g / t >= 1e-1 OR g >= 5e-2)
UNION ALL SELECT contender_key, 'metric_not_measurable', 'caution', u FROM s WHERE u > 0""")
def diagnostics_gap_findings(spark, sf):
    summary = dg.gap_summary(dg.fold_gaps(_probed_folds(spark, sf), "roc_auc"), "roc_auc")
    return dg.gap_findings(summary).select("contender_key", "code", "severity", "evidence")


@query("diagnostics_confusion", "WITH " + d.MULTI_SQL + """
SELECT c.contender_key, a.l AS y_true, b.l AS y_pred, (SELECT count(*) FROM multi m WHERE m.split = 'cv' AND m.contender_key = c.contender_key AND m.y_true = a.l AND m.y_pred = b.l) AS n
FROM (SELECT DISTINCT contender_key FROM multi) c, (VALUES ('F'), ('O'), ('P')) a(l), (VALUES ('F'), ('O'), ('P')) b(l)""")
def diagnostics_confusion(spark, sf):
    return dg.confusion(d.multiclass_predictions(spark, sf), d.MULTI).drop("run_id")


@query("diagnostics_top_confusions", "WITH " + d.MULTI_SQL + """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY contender_key ORDER BY n DESC, y_true, y_pred) AS INTEGER) AS place
FROM (SELECT contender_key, y_true, y_pred, count(*) AS n FROM multi WHERE split = 'cv' AND y_true <> y_pred GROUP BY 1, 2, 3)) WHERE place <= 10""")
def diagnostics_top_confusions(spark, sf):
    return dg.top_confusions(d.multiclass_predictions(spark, sf), d.MULTI).drop("run_id")


CLASSES_SQL = d.MULTI_SQL + """,
c AS (SELECT contender_key, label, sum(CASE WHEN y_true = label THEN 1e0 ELSE 0e0 END) AS support, sum(CASE WHEN y_pred = label THEN 1e0 ELSE 0e0 END) AS named,
             sum(CASE WHEN y_true = label AND y_pred = label THEN 1e0 ELSE 0e0 END) AS tp
      FROM multi, (VALUES ('F'), ('O'), ('P')) l(label) WHERE split = 'cv' GROUP BY ALL)"""


@query("diagnostics_per_class", "WITH " + CLASSES_SQL + """
SELECT contender_key, label, round(coalesce(tp / nullif(named, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(named + support, 0), 0), 6) AS f1, CAST(support AS BIGINT) AS support FROM c""")
def diagnostics_per_class(spark, sf):
    return dg.per_class(d.multiclass_predictions(spark, sf), d.MULTI).drop("run_id")


@query("diagnostics_imbalance", """WITH p AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), s AS (SELECT sum(CASE WHEN n < 20 THEN 1e0 ELSE 0e0 END) AS scarce, min(n) * 1e0 / sum(n) AS share FROM p)
SELECT 'scarce_class' AS code, 'caution' AS severity, scarce AS evidence FROM s WHERE scarce > 0 UNION ALL SELECT 'severe_imbalance', 'caution', round(share, 6) FROM s WHERE share < 5e-2""")
def diagnostics_imbalance(spark, sf):
    docs = table(spark, sf, "documents")
    labels = tuple(r["lang"] for r in docs.select("lang").distinct().orderBy("lang").collect())
    p = docs.select(F.lit("r").alias("run_id"), F.lit("c").alias("contender_key"), F.lit("cv").alias("split"), F.col("lang").alias("y_true"), F.col("lang").alias("y_pred"))
    return dg.imbalance_findings(dg.per_class(p, TaskSpec("lang", "multiclass", (), labels))).select("code", "severity", "evidence")


@query("diagnostics_confidence_bins", "WITH " + d.BINARY_SQL + """,
e AS (SELECT contender_key, greatest(p_no, p_yes) AS p, y_true = y_pred AS hit FROM bin WHERE split = 'cv' AND p_yes IS NOT NULL),
b AS (SELECT *, CASE WHEN p < 2e-1 THEN 0 WHEN p < 4e-1 THEN 1 WHEN p < 6000000000000001e-16 THEN 2 WHEN p < 8e-1 THEN 3 ELSE 4 END AS bin FROM e)
SELECT contender_key, bin, count(*) AS n, round(avg(p), 6) AS mean_confidence, round(avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END), 6) AS accuracy,
       round(avg(p), 6) - round(avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END), 6) > 1e-1 AS overconfident FROM b GROUP BY ALL""")
def diagnostics_confidence_bins(spark, sf):
    return dg.confidence_bins(d.binary_predictions(spark, sf)).drop("run_id")


@query("diagnostics_residuals", "WITH " + d.REGRESSION_SQL + """,
r AS (SELECT contender_key, y_pred - y_true AS e, y_true FROM reg WHERE split = 'cv')
SELECT contender_key, count(*) AS n, round(avg(e), 2) AS mean, round(stddev_pop(e), 2) AS std, round(min(e), 4) AS "min", round(max(e), 4) AS "max",
       abs(avg(e)) > 1e-1 * stddev_pop(e) AS systematic_bias, round(min(y_true), 4) AS target_min, round(max(y_true), 4) AS target_max,
       round(quantile_cont(e, 5e-2), 4) AS q05, round(quantile_cont(e, 25e-2), 4) AS q25, round(quantile_cont(e, 5e-1), 4) AS median,
       round(quantile_cont(e, 75e-2), 4) AS q75, round(quantile_cont(e, 95e-2), 4) AS q95 FROM r GROUP BY contender_key""")
def diagnostics_residuals(spark, sf):
    s = dg.residual_summary(d.regression_predictions(spark, sf)).drop("run_id")
    digits = {"mean": 2, "std": 2}
    return s.select(*[F.round(c, digits.get(c, 4)).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query("diagnostics_error_by_target_range", "WITH " + d.REGRESSION_SQL + """,
r AS (SELECT contender_key, y_pred - y_true AS e, y_true FROM reg WHERE split = 'cv'),
q AS (SELECT contender_key, quantile_cont(y_true, 0e0) AS q0, quantile_cont(y_true, 2e-1) AS q1, quantile_cont(y_true, 4e-1) AS q2, quantile_cont(y_true, 6e-1) AS q3, quantile_cont(y_true, 8e-1) AS q4, quantile_cont(y_true, 1e0) AS q5 FROM r GROUP BY 1),
b AS (SELECT contender_key, e, q0, q1, q2, q3, q4, q5, CASE WHEN y_true < q1 THEN 0 WHEN y_true < q2 THEN 1 WHEN y_true < q3 THEN 2 WHEN y_true < q4 THEN 3 ELSE 4 END AS bucket FROM r JOIN q USING (contender_key))
SELECT contender_key, bucket, round(any_value([q0, q1, q2, q3, q4][bucket + 1]), 3) AS low, round(any_value([q1, q2, q3, q4, q5][bucket + 1]), 3) AS high, count(*) AS n,
       round(avg(abs(e)), 3) AS mae, round(sqrt(avg(e * e)), 3) AS rmse, round(avg(e), 3) AS mean_residual FROM b GROUP BY ALL""")
def diagnostics_error_by_target_range(spark, sf):
    s = dg.error_by_target_range(d.regression_predictions(spark, sf)).drop("run_id")
    return s.select(*[F.round(c, 3).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query("diagnostics_largest_errors", "WITH " + d.REGRESSION_SQL + """,
r AS (SELECT *, y_pred - y_true AS e, max(y_true) OVER (PARTITION BY contender_key) - min(y_true) OVER (PARTITION BY contender_key) AS width FROM reg WHERE split = 'cv')
SELECT contender_key, CAST(row_number() OVER (PARTITION BY contender_key ORDER BY abs(e) DESC, row_id) AS INTEGER) AS place, row_id, fold, round(e, 3) AS residual,
       CASE WHEN abs(y_true) > 1e-2 * width AND y_true <> 0 THEN round(abs(e) / abs(y_true), 6) END AS relative_error FROM r QUALIFY place <= 20""")
def diagnostics_largest_errors(spark, sf):
    return dg.largest_errors(d.regression_predictions(spark, sf)).select(
        "contender_key", "place", "row_id", "fold", F.round("residual", 3).alias("residual"), "relative_error"
    )


@query("diagnostics_correlated_pairs", "WITH " + d.ORDERS_TASK_SQL + " ".join([""]) + " UNION ALL ".join(
    f"SELECT '{a}' AS \"first\", '{b}' AS \"second\", round(corr({a}, {b}), 4) AS correlation FROM orders_task HAVING abs(corr({a}, {b})) >= 8e-1"
    for a, b in (("o_totalprice", "sparse_price"), ("o_totalprice", "doubled_price"), ("o_totalprice", "o_custkey"),
                 ("sparse_price", "doubled_price"), ("sparse_price", "o_custkey"), ("doubled_price", "o_custkey"))))
def diagnostics_correlated_pairs(spark, sf):
    return dg.correlated_pairs(d.orders_task(spark, sf), ["o_totalprice", "sparse_price", "doubled_price", "o_custkey"])


@query("diagnostics_report", "WITH " + GAPS_SQL + """,
s AS (SELECT contender_key, round(avg(gap), 6) AS g, avg(train_score) AS t, sum(CASE WHEN validation_score IS NULL THEN 1 ELSE 0 END) AS u FROM gaps GROUP BY 1)
SELECT contender_key, 'train_validation_gap' AS code, CASE WHEN g / t >= 25e-2 OR g >= 15e-2 THEN 'high' ELSE 'caution' END AS severity FROM s WHERE g > 0 AND (g / t >= 1e-1 OR g >= 5e-2)
UNION ALL SELECT contender_key, 'metric_not_measurable', 'caution' FROM s WHERE u > 0""")
def diagnostics_report(spark, sf):
    p = d.binary_predictions(spark, sf, probes=True)
    return dg.diagnose(p, mt.fold_metrics(p, d.BINARY), d.BINARY)["findings"].select("contender_key", "code", "severity")


# --- error rows -------------------------------------------------------------------------------------


def _of(predictions, key):
    return predictions.filter(F.col("contender_key") == key)


@query("error_rows_largest", "WITH " + d.REGRESSION_SQL + """,
t AS (SELECT *, abs(y_pred - y_true) AS e FROM reg WHERE split = 'cv' AND contender_key = 'close' ORDER BY e DESC, row_id LIMIT 50)
SELECT row_id, fold, round(e, 3) AS absolute_error, o.o_custkey AS custkey, o.o_orderstatus AS status FROM t JOIN orders o ON o.o_orderkey = row_id""")
def error_rows_largest(spark, sf):
    p = _of(d.regression_predictions(spark, sf), "close")
    rows = er.select_error_rows(p, d.orders_task(spark, sf), d.REGRESSION)
    return rows.select(
        "row_id", "fold", F.round("absolute_error", 3).alias("absolute_error"), F.col("features.o_custkey").alias("custkey"),
        F.col("context.o_orderstatus").alias("status"),
    )


@query("error_rows_confident", "WITH " + d.BINARY_SQL + """,
t AS (SELECT row_id, fold, y_true, y_pred, p_yes, greatest(p_no, p_yes) AS confidence FROM bin WHERE split = 'cv' AND contender_key = 'good' AND y_true <> y_pred ORDER BY confidence DESC, row_id LIMIT 50)
SELECT row_id, fold, y_true, y_pred, round(p_yes, 6) AS p_yes, o_orderstatus AS status FROM t JOIN orders ON o_orderkey = row_id""")
def error_rows_confident(spark, sf):
    p = _of(d.binary_predictions(spark, sf), "good")
    rows = er.select_error_rows(p, d.orders_task(spark, sf), d.BINARY, "confident_mistakes")
    return rows.select("row_id", "fold", "y_true", "y_pred", F.col("probabilities")["yes"].alias("p_yes"), F.col("features.o_orderstatus").alias("status"))


@query("error_rows_false_positive", "WITH " + d.BINARY_SQL + " SELECT row_id, fold FROM bin WHERE split = 'cv' AND contender_key = 'fair' AND y_pred = 'yes' AND y_true = 'no' ORDER BY row_id LIMIT 10000")
def error_rows_false_positive(spark, sf):
    p = _of(d.binary_predictions(spark, sf), "fair")
    return er.select_error_rows(p, d.orders_task(spark, sf), d.BINARY, "false_positive", limit=10_000).select("row_id", "fold")


@query("error_rows_cell", "WITH " + d.MULTI_SQL + " SELECT row_id, fold FROM multi WHERE split = 'cv' AND contender_key = 'weak' AND y_true = 'F' AND y_pred = 'P' ORDER BY row_id LIMIT 50")
def error_rows_cell(spark, sf):
    p = _of(d.multiclass_predictions(spark, sf), "weak")
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "row_id")
    return er.select_error_rows(p, orders, d.MULTI, "cell", actual="F", predicted="P").select("row_id", "fold")


@query("error_totals", "WITH " + d.BINARY_SQL + " ".join([""]) + " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, contender_key, count(*) AS total_matching FROM bin WHERE split = 'cv' AND {where} GROUP BY contender_key"
    for kind, where in (("all_mistakes", "y_true <> y_pred"), ("false_positive", "y_pred = 'yes' AND y_true = 'no'"), ("false_negative", "y_pred = 'no' AND y_true = 'yes'"))))
def error_totals(spark, sf):
    p = d.binary_predictions(spark, sf)
    parts = [er.matching_total(p, d.BINARY, k).select(F.lit(k).alias("kind"), "contender_key", "total_matching") for k in ("all_mistakes", "false_positive", "false_negative")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("error_holdout_rows", "WITH " + d.BINARY_SQL + " SELECT count(*) AS n, sum(row_id)::BIGINT AS id_sum FROM orders_task WHERE row_id IN (SELECT row_id FROM bin WHERE split = 'holdout')")
def error_holdout_rows(spark, sf):
    rows = er.holdout_rows(d.binary_predictions(spark, sf), d.orders_task(spark, sf))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("id_sum"))


# --- checks on predictions ------------------------------------------------------------------------------


@query("predictions_violations", "WITH " + d.BINARY_SQL + """
SELECT contender_key, split, fold, count(*) AS n_rows, sum(CASE WHEN row_id % 97 = 0 THEN 1 ELSE 0 END)::BIGINT AS bad_label, CAST(0 AS BIGINT) AS bad_shape,
       sum(CASE WHEN p_yes IS NOT NULL AND row_id % 89 = 0 THEN 1 ELSE 0 END)::BIGINT AS bad_value,
       sum(CASE WHEN p_yes IS NOT NULL AND row_id % 83 = 0 AND row_id % 89 <> 0 THEN 1 ELSE 0 END)::BIGINT AS negative
FROM bin GROUP BY ALL""")
def predictions_violations(spark, sf):
    p = d.binary_predictions(spark, sf)
    bad = F.array(F.lit(float("nan")).cast("float"), F.lit(0.5).cast("float"))
    negative = F.array(F.lit(-0.5).cast("float"), F.lit(0.5).cast("float"))
    given, i = F.col("proba").isNotNull(), F.col("row_id")
    p = p.withColumn("y_pred", F.when(i % 97 == 0, "maybe").otherwise(F.col("y_pred"))).withColumn(
        "proba", F.when(given & (i % 89 == 0), bad).when(given & (i % 83 == 0), negative).otherwise(F.col("proba"))
    )
    return pr.violations(p, d.BINARY).drop("run_id")


@query("predictions_violations_regression", "WITH " + d.REGRESSION_SQL + " SELECT contender_key, split, fold, count(*) AS n_rows, sum(CASE WHEN row_id % 101 = 0 THEN 1 ELSE 0 END)::BIGINT AS bad_value FROM reg GROUP BY ALL")
def predictions_violations_regression(spark, sf):
    p = d.regression_predictions(spark, sf).withColumn("y_pred", F.when(F.col("row_id") % 101 == 0, float("inf")).otherwise(F.col("y_pred")))
    return pr.violations(p, d.REGRESSION).drop("run_id")


def _cv_pool(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id")).filter((F.col("row_id") * 31) % 6 < 5)


@query("predictions_oof_coverage", "WITH " + d.BINARY_SQL + """,
pool AS (SELECT o_orderkey AS row_id FROM orders WHERE (o_orderkey * 31) % 6 < 5),
p AS (SELECT contender_key, row_id FROM bin WHERE split = 'cv' AND NOT (contender_key = 'fair' AND row_id % 11 = 0)
      UNION ALL SELECT contender_key, row_id FROM bin WHERE split = 'cv' AND contender_key = 'good' AND row_id % 13 = 0),
s AS (SELECT contender_key, row_id, count(*) AS n FROM p GROUP BY ALL)
SELECT contender_key, (SELECT count(*) FROM pool) AS expected_rows, count(*) AS covered_rows, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS duplicated_rows, CAST(0 AS BIGINT) AS stray_rows,
       count(*) = (SELECT count(*) FROM pool) AS complete,
       CASE WHEN sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) > 0 THEN 'duplicated' WHEN count(*) = (SELECT count(*) FROM pool) THEN 'complete' ELSE 'incomplete' END AS verdict
FROM s GROUP BY contender_key""")
def predictions_oof_coverage(spark, sf):
    p = pr.of_split(d.binary_predictions(spark, sf), fixed.SPLIT_CV)
    key, i = F.col("contender_key"), F.col("row_id")
    p = p.filter(~((key == "fair") & (i % 11 == 0))).unionByName(p.filter((key == "good") & (i % 13 == 0)))
    return pr.oof_coverage(p, _cv_pool(spark, sf), K5).drop("run_id")


@query("predictions_part_coverage", "WITH " + d.BINARY_SQL + """,
e AS (SELECT split, fold, row_id FROM bin_every WHERE contender_key = 'baseline'),
k AS (SELECT contender_key, split, fold, row_id FROM bin_every WHERE NOT (contender_key = 'fair' AND split = 'holdout' AND row_id % 11 = 0) AND NOT (contender_key = 'noproba' AND split = 'train_probe' AND fold = 3)
      UNION ALL SELECT contender_key, split, fold, row_id FROM bin_every WHERE contender_key = 'good' AND split = 'holdout' AND row_id % 13 = 0),
s AS (SELECT contender_key, split, fold, row_id, count(*) AS n FROM k GROUP BY ALL),
w AS (SELECT DISTINCT contender_key FROM bin_every),
p AS (SELECT split, fold, count(*) AS expected_rows FROM e GROUP BY ALL),
c AS (SELECT contender_key, split, fold, count(*) AS covered_rows, count(*) FILTER (n > 1) AS duplicated_rows FROM s GROUP BY ALL)
SELECT contender_key, split, fold, expected_rows, coalesce(covered_rows, 0) AS covered_rows, coalesce(duplicated_rows, 0) AS duplicated_rows, CAST(0 AS BIGINT) AS stray_rows,
       CASE WHEN duplicated_rows > 0 THEN 'duplicated' WHEN covered_rows = expected_rows THEN 'complete' ELSE 'incomplete' END AS verdict
FROM w CROSS JOIN p LEFT JOIN c USING (contender_key, split, fold)""")
def predictions_part_coverage(spark, sf):
    """A part of one contender's holdout missing, a whole probe of another, rows of a third twice."""
    p = d.binary_predictions(spark, sf, probes=True)
    key, split, i = F.col("contender_key"), F.col("split"), F.col("row_id")
    expected = p.filter(key == "baseline").select("split", "fold", "row_id")
    kept = p.filter(~((key == "fair") & (split == "holdout") & (i % 11 == 0)) & ~((key == "noproba") & (split == "train_probe") & (F.col("fold") == 3)))
    kept = kept.unionByName(p.filter((key == "good") & (split == "holdout") & (i % 13 == 0)))
    return pr.part_coverage(kept, expected).drop("run_id")


@query("predictions_strays", "WITH " + d.BINARY_SQL + " SELECT contender_key, row_id FROM bin WHERE split = 'cv' AND row_id % 17 = 0")
def predictions_strays(spark, sf):
    return pr.strays(d.binary_predictions(spark, sf), _cv_pool(spark, sf).filter("row_id % 17 <> 0"))


@query("predictions_entity_intersection", "SELECT DISTINCT a.o_custkey FROM orders a WHERE a.o_orderkey % 2 = 0 AND a.o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)")
def predictions_entity_intersection(spark, sf):
    o = table(spark, sf, "orders")
    return o.filter("o_orderkey % 2 = 0").select("o_custkey").intersect(o.filter("o_orderkey % 2 = 1").select("o_custkey"))


@query("predictions_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
def predictions_distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_discount").distinct()


@query("predictions_unite_parts", "WITH " + d.BINARY_SQL + """
SELECT contender_key, split, count(*) AS n, CAST(CASE WHEN contender_key = 'good' THEN 0 ELSE count(p_yes) END AS BIGINT) AS with_probabilities FROM bin GROUP BY contender_key, split""")
def predictions_unite_parts(spark, sf):
    p = d.binary_predictions(spark, sf)
    parts = [p.filter(F.col("fold") == f) for f in range(-1, 5)]
    # one part of one contender arrives without probabilities
    parts[2] = parts[2].withColumn("proba", F.when(F.col("contender_key") != "good", F.col("proba")))
    united = pr.unite_parts(parts, classification=True)
    return united.groupBy("contender_key", "split").agg(F.count(F.lit(1)).alias("n"), F.count("proba").alias("with_probabilities"))


@query("predictions_align_probabilities", "WITH " + d.MULTI_SQL + """
SELECT contender_key, row_id, round(p_f, 6) AS p_f, 0e0 AS p_o, round(p_p, 6) AS p_p FROM multi""")
def predictions_align_probabilities(spark, sf):
    p = d.multiclass_predictions(spark, sf)
    # a model that saw only P and F, in that order
    partial = F.array(F.get("proba", F.lit(2)), F.get("proba", F.lit(0)))
    aligned = pr.align_probabilities(F.transform(partial, lambda x: x.cast("double")), ["P", "F"], d.MULTI.labels)
    wide = pr.wide_probabilities(p.withColumn("proba", aligned), d.MULTI.labels)
    return wide.select(
        "contender_key", "row_id",
        *[F.round(F.col(f"proba__{x}").cast("double"), 6).alias(f"p_{x.lower()}") for x in d.MULTI.labels],
    )


@query("predictions_probability_map", "WITH " + d.BINARY_SQL + " SELECT contender_key, row_id, round(p_yes, 6) AS p_yes, round(p_no, 6) AS p_no FROM bin WHERE split = 'holdout' AND p_yes IS NOT NULL")
def predictions_probability_map(spark, sf):
    p = pr.of_split(d.binary_predictions(spark, sf), fixed.SPLIT_HOLDOUT).filter("proba is not null")
    m = F.map_from_arrays(pr.labels_literal(d.BINARY.labels), F.transform("proba", lambda x: F.round(x.cast("double"), 6)))
    return p.select("contender_key", "row_id", m["yes"].alias("p_yes"), m["no"].alias("p_no"))


@query("folds_membership_counts", """SELECT (SELECT count(*) FROM orders) - CAST(ceil(2e-1 * (SELECT count(*) FROM orders)) AS BIGINT) AS pool_rows, CAST(4 * ((SELECT count(*) FROM orders) - CAST(ceil(2e-1 * (SELECT count(*) FROM orders)) AS BIGINT)) AS BIGINT) AS training_memberships""")
def folds_membership_counts(spark, sf):
    a = fd.assign(d.orders_task(spark, sf), TaskSpec("urgent", "binary", ()), K5).filter("part = 'pool'")
    return a.agg(F.count(F.lit(1)).alias("pool_rows"), F.sum(F.size(fd.training_folds(K5)).cast("long")).alias("training_memberships"))
