"""Queries for leakage evidence and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairfold.operators import folds as fd
from fairfold.operators import leakage as lk
from fairfold.operators import readiness as rd
from fairfold.plans import derived as d
from fairfold.plans.registry import query, table
from fairfold.plans.setup import FORWARD, FORWARD_SQL, GROUPED, K5, KFOLD_SQL, STRATIFIED_SQL, lineitem_rows
from fairfold.spec import Protocol, TaskSpec

# few columns with few values, so that copies of rows do cross the folds
COARSE = TaskSpec(
    "urgent", "binary", ("o_orderstatus", "price_step"), ("no", "yes"), "yes", group="o_custkey", time="o_orderdate"
)


def coarse_orders(spark, sf):
    return d.orders_task(spark, sf).withColumn("price_step", F.floor(F.col("o_totalprice") / 50.0))


def _crossing_sql(assigned: str, train: str, validation: str) -> str:
    return assigned + f""",
keyed AS (SELECT a.row_id, a.part, a.chunk, t.o_orderstatus || '/' || CAST(floor(t.o_totalprice / 5e1) AS BIGINT) || '/' || t.urgent AS k
          FROM assigned a JOIN orders_task t USING (row_id)),
f AS (SELECT fold FROM range(5) t(fold)),
crossing AS (
  SELECT f.fold, count(*) AS n FROM f JOIN keyed v ON v.part = 'pool' AND v.chunk = {validation}
  WHERE EXISTS (SELECT 1 FROM keyed t WHERE t.k = v.k AND t.part = 'pool' AND t.chunk {train}) GROUP BY f.fold),
valid AS (SELECT count(*) AS n FROM f JOIN keyed v ON v.part = 'pool' AND v.chunk = {validation})
SELECT coalesce((SELECT sum(n) FROM crossing), 0)::BIGINT AS crossing_validation_rows,
       (SELECT count(*) FROM keyed h WHERE part = 'holdout' AND k IN (SELECT k FROM keyed WHERE part = 'pool')) AS crossing_holdout_rows,
       (SELECT n FROM valid) AS validation_rows,
       (SELECT count(*) FROM crossing WHERE n > 0)::INTEGER AS affected_folds,
       round(coalesce((SELECT sum(n) FROM crossing), 0) * 1e0 / (SELECT n FROM valid), 6) AS share"""


def _crossing(spark, sf, protocol):
    a = fd.assign(coarse_orders(spark, sf), COARSE, protocol, keep=("o_orderstatus", "price_step", "urgent"))
    return lk.duplicate_crossing(a, COARSE, protocol).select(
        "crossing_validation_rows", "crossing_holdout_rows", "validation_rows",
        F.size("affected_folds").alias("affected_folds"), F.round("share", 6).alias("share"),
    )


@query("leakage_duplicate_crossing", "WITH " + _crossing_sql(KFOLD_SQL, "<> f.fold", "f.fold"))
def leakage_duplicate_crossing(spark, sf):
    return _crossing(spark, sf, K5)


@query("leakage_duplicate_crossing_forward", "WITH " + _crossing_sql(FORWARD_SQL, "<= f.fold", "f.fold + 1"))
def leakage_duplicate_crossing_forward(spark, sf):
    return _crossing(spark, sf, FORWARD)


LINEITEM_CROSSING_SQL = """
l AS (SELECT row_number() OVER () - 1 AS row_id, l_quantity || '/' || l_discount || '/' || l_tax || '/' || l_returnflag AS k, l_returnflag AS c FROM lineitem),
sizes AS (SELECT c, count(*) AS m FROM l GROUP BY 1),
quota AS (SELECT c, m, floor(2e-1 * m) + CASE WHEN row_number() OVER (ORDER BY 2e-1 * m - floor(2e-1 * m) DESC, c)
  <= ceil(2e-1 * sum(m) OVER ()) - sum(floor(2e-1 * m)) OVER () THEN 1 ELSE 0 END AS q FROM sizes),
starts AS (SELECT *, coalesce(sum(m - q) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM quota),
a AS (SELECT k, r > q AS pooled, CASE WHEN r > q THEN (r - q - 1 + s) % 5 END AS chunk
      FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY md5('42:order:' || row_id), row_id) AS r FROM l) JOIN starts USING (c)),
spread AS (SELECT k, count(DISTINCT chunk) AS chunks, sum(CASE WHEN pooled THEN 1 ELSE 0 END) AS pool, sum(CASE WHEN pooled THEN 0 ELSE 1 END) AS held FROM a GROUP BY k)
SELECT sum(CASE WHEN chunks > 1 THEN pool ELSE 0 END)::BIGINT AS crossing_validation_rows, sum(CASE WHEN pool > 0 THEN held ELSE 0 END)::BIGINT AS crossing_holdout_rows,
       sum(pool)::BIGINT AS validation_rows, (SELECT count(DISTINCT chunk) FROM a JOIN spread USING (k) WHERE chunks > 1 AND pooled)::INTEGER AS affected_folds,
       round(sum(CASE WHEN chunks > 1 THEN pool ELSE 0 END) * 1e0 / sum(pool), 6) AS share FROM spread"""


@query("leakage_duplicate_crossing_lineitem", "WITH " + LINEITEM_CROSSING_SQL)
def leakage_duplicate_crossing_lineitem(spark, sf):
    spec = TaskSpec("l_returnflag", "multiclass", ("l_quantity", "l_discount", "l_tax"), ("A", "N", "R"))
    protocol = Protocol("stratified_k_fold", holdout="stratified")
    a = fd.assign(lineitem_rows(spark, sf), spec, protocol, keep=(*spec.features, spec.target))
    return lk.duplicate_crossing(a, spec, protocol).withColumns({"affected_folds": F.size("affected_folds"), "share": F.round("share", 6)})


@query("leakage_group_crossing", "WITH " + KFOLD_SQL + """
SELECT count(*) AS groups, sum(CASE WHEN c > 1 THEN 1 ELSE 0 END)::BIGINT AS crossing_groups
FROM (SELECT o_custkey, count(DISTINCT chunk) AS c FROM assigned JOIN orders_task USING (row_id) WHERE part = 'pool' GROUP BY 1)""")
def leakage_group_crossing(spark, sf):
    return lk.group_crossing(fd.assign(d.orders_task(spark, sf), COARSE, K5, keep=("o_custkey",)), COARSE)


@query("leakage_group_isolated", """SELECT CAST(0 AS BIGINT) AS crossing_groups FROM orders LIMIT 1""")
def leakage_group_isolated(spark, sf):
    a = fd.assign(d.orders_task(spark, sf), COARSE, GROUPED, keep=("o_custkey",))
    return lk.group_crossing(a, COARSE).select("crossing_groups")


@query("leakage_time_order", "WITH " + KFOLD_SQL + """,
t AS (SELECT chunk, epoch_us(o_orderdate) AS us FROM assigned JOIN orders_task USING (row_id) WHERE part = 'pool')
SELECT CAST(f AS INTEGER) AS fold, max(CASE WHEN chunk <> f THEN us END) AS latest_train, min(CASE WHEN chunk = f THEN us END) AS earliest_validation,
       max(CASE WHEN chunk <> f THEN us END) > min(CASE WHEN chunk = f THEN us END) AS violation FROM t, range(5) r(f) GROUP BY f""")
def leakage_time_order(spark, sf):
    return lk.time_order(fd.assign(d.orders_task(spark, sf), COARSE, K5, keep=("o_orderdate",)), COARSE, K5)


@query("leakage_time_order_forward", "WITH " + FORWARD_SQL + """,
t AS (SELECT chunk, epoch_us(o_orderdate) AS us FROM assigned WHERE part = 'pool')
SELECT CAST(f AS INTEGER) AS fold, max(CASE WHEN chunk <= f THEN us END) > min(CASE WHEN chunk = f + 1 THEN us END) AS violation FROM t, range(5) r(f) GROUP BY f""")
def leakage_time_order_forward(spark, sf):
    a = fd.assign(d.orders_task(spark, sf), COARSE, FORWARD, keep=("o_orderdate",))
    return lk.time_order(a, COARSE, FORWARD).select("fold", "violation")


# --- column-wise evidence --------------------------------------------------------------------------

CLASS_SPEC = TaskSpec(
    "urgent", "binary", ("o_totalprice", "o_orderstatus", "o_orderpriority", "closing_reason", "copied"), ("no", "yes"), "yes"
)
NUMBER_SPEC = TaskSpec("o_totalprice", "regression", ("o_custkey", "doubled_price", "sparse_price", "close_price", "flat"))


def _class_rows(spark, sf):
    o = d.orders_task(spark, sf).withColumn("copied", F.col("urgent"))
    return fd.assign(o, CLASS_SPEC, K5, keep=(*CLASS_SPEC.features, "urgent"))


def _number_rows(spark, sf, protocol=K5):
    o = d.orders_task(spark, sf).withColumns({
        "close_price": F.col("o_totalprice") + (F.col("row_id") % 3) * 0.001, "flat": F.lit(3.0),
    })
    spec = TaskSpec(NUMBER_SPEC.target, "regression", NUMBER_SPEC.features, time="o_orderdate")
    return fd.assign(o, spec, protocol, keep=(*NUMBER_SPEC.features, "o_totalprice"))


@query("leakage_exact_copies", "WITH " + d.ORDERS_TASK_SQL + """
SELECT 'copied' AS feature FROM orders_task HAVING bool_and(urgent = urgent)
UNION ALL SELECT 'o_orderpriority' FROM orders_task HAVING bool_and(o_orderpriority = urgent)
UNION ALL SELECT 'closing_reason' FROM orders_task HAVING bool_and(closing_reason IS NOT DISTINCT FROM urgent)""")
def leakage_exact_copies(spark, sf):
    return lk.exact_copies(lk.feature_evidence(_class_rows(spark, sf), CLASS_SPEC))


@query("leakage_missingness", "WITH " + d.ORDERS_TASK_SQL + " ".join([""]) + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*) - count({c}) AS missing_rows, count({c}) AS present_rows,
    round(avg(CASE WHEN {c} IS NULL THEN CASE WHEN urgent = 'yes' THEN 1e0 ELSE 0e0 END END), 4) AS rate_when_missing,
    round(avg(CASE WHEN {c} IS NOT NULL THEN CASE WHEN urgent = 'yes' THEN 1e0 ELSE 0e0 END END), 4) AS rate_when_present,
    coalesce(count(*) - count({c}) >= 30 AND count({c}) >= 30
      AND abs(avg(CASE WHEN {c} IS NULL THEN CASE WHEN urgent = 'yes' THEN 1e0 ELSE 0e0 END END)
            - avg(CASE WHEN {c} IS NOT NULL THEN CASE WHEN urgent = 'yes' THEN 1e0 ELSE 0e0 END END)) >= 5e-1, false) AS suspicious
    FROM (SELECT *, urgent AS copied FROM orders_task)""" for c in CLASS_SPEC.features))
def leakage_missingness(spark, sf):
    return lk.missingness(lk.feature_evidence(_class_rows(spark, sf), CLASS_SPEC))


@query("leakage_affine_target", "WITH " + d.ORDERS_TASK_SQL + """
SELECT 'doubled_price' AS feature, round(regr_slope(o_totalprice, doubled_price), 6) AS slope, true AS exact FROM orders_task""")
def leakage_affine_target(spark, sf):
    rows = _number_rows(spark, sf)
    found = lk.affine_reconstruction(rows, lk.feature_evidence(rows, NUMBER_SPEC), NUMBER_SPEC)
    return found.select("feature", F.round("slope", 6).alias("slope"), (F.col("residual") < 1e-9).alias("exact"))


def _linear_sql(assigned: str, train: str, validation: str) -> str:
    return assigned + f""",
x AS (SELECT a.chunk, t.o_totalprice AS y, v.feature,
             CASE v.feature WHEN 'o_custkey' THEN t.o_custkey * 1e0 WHEN 'doubled_price' THEN t.doubled_price
                            ELSE t.o_totalprice + (t.row_id % 3) * 1e-3 END AS x
      FROM assigned a JOIN orders_task t USING (row_id), (VALUES ('o_custkey'), ('doubled_price'), ('close_price')) v(feature) WHERE a.part = 'pool'),
line AS (SELECT feature, fold, regr_slope(y, x) AS a, avg(x) AS mx, avg(y) AS my FROM x, range(5) r(fold) WHERE chunk {train} GROUP BY ALL),
scored AS (SELECT feature, fold, 1 - sum(power(y - my - a * (x - mx), 2)) / (count(*) * var_pop(y)) AS r2
           FROM x JOIN line USING (feature) WHERE chunk = {validation} GROUP BY ALL)
SELECT feature, round(avg(r2), 6) AS score, count(*) AS folds FROM scored GROUP BY feature"""


@query("leakage_linear_reconstruction", "WITH " + _linear_sql(KFOLD_SQL, "<> fold", "fold"))
def leakage_linear_reconstruction(spark, sf):
    found = lk.linear_reconstruction(lk.feature_evidence(_number_rows(spark, sf), NUMBER_SPEC), K5)
    return found.withColumn("score", F.round("score", 6))


@query("leakage_linear_reconstruction_forward", "WITH " + _linear_sql(FORWARD_SQL, "<= fold", "fold + 1"))
def leakage_linear_reconstruction_forward(spark, sf):
    found = lk.linear_reconstruction(lk.feature_evidence(_number_rows(spark, sf, FORWARD), NUMBER_SPEC), FORWARD)
    return found.withColumn("score", F.round("score", 6))


@query("leakage_finite_guard", "WITH " + d.ORDERS_TASK_SQL + """
SELECT 'o_custkey' AS feature UNION ALL SELECT 'doubled_price' UNION ALL SELECT 'close_price' UNION ALL
SELECT 'sparse_price' FROM orders_task HAVING bool_and(sparse_price IS NOT NULL) UNION ALL
SELECT 'flat' FROM (SELECT 3e0 AS flat FROM orders_task) HAVING var_pop(flat) > 0""")
def leakage_finite_guard(spark, sf):
    evidence = lk.feature_evidence(_number_rows(spark, sf), NUMBER_SPEC)
    return lk._centred(evidence, pool_only=False).select("feature").distinct()


@query("leakage_single_feature_probe")
def leakage_single_feature_probe(spark, sf):
    rows = _class_rows(spark, sf)
    return lk.probe_scores(lk.probe_histograms(rows, CLASS_SPEC), CLASS_SPEC, K5)


@query("leakage_single_feature_probe_regression")
def leakage_single_feature_probe_regression(spark, sf):
    rows = _number_rows(spark, sf)
    return lk.probe_scores(lk.probe_histograms(rows, NUMBER_SPEC), NUMBER_SPEC, K5)


def _any_crossing(assigned: str, key: str) -> str:
    """CTE ``crossed(share, hit)``: K-fold validation rows repeated in training, and any holdout repeat."""
    return assigned + f""",
keyed AS (SELECT a.part, a.chunk, {key} AS k FROM assigned a JOIN orders_task t USING (row_id)),
spread AS (SELECT k, count(DISTINCT chunk) AS chunks, sum(CASE WHEN part = 'pool' THEN 1 ELSE 0 END) AS pooled,
                  sum(CASE WHEN part = 'holdout' THEN 1 ELSE 0 END) AS held FROM keyed GROUP BY k),
crossed AS (SELECT sum(CASE WHEN chunks > 1 THEN pooled ELSE 0 END) * 1e0 / sum(pooled) AS share,
                   bool_or(chunks > 1 OR (pooled > 0 AND held > 0)) AS hit FROM spread)"""


REPORT_KEY = "t.o_totalprice || '/' || t.o_orderstatus || '/' || t.o_orderpriority || '/' || coalesce(t.closing_reason, '-')"


@query("leakage_report", "WITH " + _any_crossing(KFOLD_SQL, REPORT_KEY) + """
SELECT 'target_copy_among_features' AS code, true AS blocking, true AS evaluated, 'copied' AS columns UNION ALL
SELECT 'duplicate_rows_cross_folds', share >= 5e-2, true, '' FROM crossed WHERE hit UNION ALL
SELECT 'single_feature_reconstructs_target', false, true, 'closing_reason,copied,o_orderpriority' UNION ALL
SELECT 'missingness_encodes_target', false, true, 'closing_reason' UNION ALL
SELECT 'post_outcome_naming', false, true, 'closing_reason'""")
def leakage_report(spark, sf):
    found = lk.inspect(_class_rows(spark, sf), CLASS_SPEC, K5)
    return found.select("code", "blocking", "evaluated", F.array_join("columns", ",").alias("columns"))


@query("leakage_report_regression", """
SELECT 'target_derived_feature' AS code, true AS blocking, true AS evaluated, 'doubled_price' AS columns UNION ALL
SELECT 'single_feature_reconstructs_target', false, true, 'close_price,doubled_price' UNION ALL
SELECT 'missingness_encodes_target', false, false, ''""")
def leakage_report_regression(spark, sf):
    found = lk.inspect(_number_rows(spark, sf), NUMBER_SPEC, K5)
    keep = F.col("code").isin("target_derived_feature", "missingness_encodes_target") | F.col("observed").getItem("linear_r2").isNotNull()
    return found.filter(keep).select("code", "blocking", "evaluated", F.array_join("columns", ",").alias("columns"))


@query("leakage_risk", "WITH " + _any_crossing(KFOLD_SQL, REPORT_KEY) + """
SELECT 'confirmed' AS risk, CAST(4 + CASE WHEN hit THEN 1 ELSE 0 END AS BIGINT) AS signals, CAST(0 AS BIGINT) AS not_evaluated FROM crossed""")
def leakage_risk(spark, sf):
    return lk.risk(lk.inspect(_class_rows(spark, sf), CLASS_SPEC, K5))


# --- readiness -------------------------------------------------------------------------------------

READY_SPEC = TaskSpec("urgent", "binary", ("o_totalprice", "o_orderstatus"), ("no", "yes"), "yes", row_id="row_id")


@query("readiness_context", "WITH " + d.ORDERS_TASK_SQL + """
SELECT n AS total_rows, n AS usable_rows, 4 AS feature_count, dim AS effective_dimension, round(n * 1e0 / dim, 2) AS rows_per_dimension, 5 AS n_splits,
       CAST(round_even(n * 2e-1, 0) AS BIGINT) AS holdout_rows, CAST(round_even((n - round_even(n * 2e-1, 0)) / 5e0, 0) AS BIGINT) AS validation_rows_per_fold
FROM (SELECT count(*) AS n, CAST(6 + 1 + least(count(DISTINCT o_orderstatus), 50) + least(count(DISTINCT closing_reason) + 1, 50) AS INTEGER) AS dim FROM orders_task)""")
def readiness_context(spark, sf):
    spec = TaskSpec("urgent", "binary", ("o_orderdate", "o_totalprice", "o_orderstatus", "closing_reason"), ("no", "yes"), "yes")
    return rd.context(d.orders_task(spark, sf), spec, K5)


def _codes(findings):
    return findings.select("code", "severity", "scope", "blocking")


@query("readiness_target_imbalance", """
SELECT CASE WHEN top >= 99e-2 THEN 'target_almost_constant' ELSE 'target_imbalanced' END AS code,
       CASE WHEN top >= 99e-2 THEN 'high_risk' ELSE 'caution' END AS severity, 'target' AS scope, top >= 99e-2 AS blocking
FROM (SELECT greatest(avg(CASE WHEN quality = 1 THEN 1e0 ELSE 0e0 END), avg(CASE WHEN quality = 0 THEN 1e0 ELSE 0e0 END)) AS top FROM labels) WHERE top >= 8e-1""")
def readiness_target_imbalance(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").withColumn("quality", F.col("quality").cast("string"))
    spec = TaskSpec("quality", "binary", ("lang", "source", "n_chars"), ("0", "1"), "0", row_id="doc_id")
    return _codes(rd.assess(rows, spec, K5)).filter("scope = 'target'")


@query("readiness_target_missing", """
SELECT 'target_missing_values' AS code, CASE WHEN s >= 5e-1 THEN 'high_risk' WHEN s >= 2e-1 THEN 'caution' ELSE 'info' END AS severity, round(s, 4) AS share
FROM (SELECT avg(CASE WHEN o_orderkey % 7 = 0 THEN 1e0 ELSE 0e0 END) AS s FROM orders)""")
def readiness_target_missing(spark, sf):
    spec = TaskSpec("sparse_price", "regression", ("o_orderstatus",))
    found = rd.assess(d.orders_task(spark, sf), spec, K5).filter("code = 'target_missing_values'")
    return found.select("code", "severity", F.col("observed").getItem("share").cast("double").alias("share"))


@query("readiness_features", "WITH " + d.ORDERS_TASK_SQL + """
SELECT 'identifier_used_as_feature' AS code, 'high_risk' AS severity, 'column:row_copy' AS scope FROM orders_task HAVING count(DISTINCT row_id) * 1e0 / count(*) >= 98e-2
UNION ALL SELECT 'constant_feature', 'caution', 'column:flat'
UNION ALL SELECT CASE WHEN s >= 9e-1 THEN 'feature_mostly_missing' ELSE 'feature_missing_values' END, CASE WHEN s >= 9e-1 THEN 'high_risk' ELSE 'caution' END, 'column:rare'
FROM (SELECT avg(CASE WHEN row_id % 20 = 0 THEN 0e0 ELSE 1e0 END) AS s FROM orders_task) WHERE s >= 5e-1
UNION ALL SELECT 'high_cardinality_feature', 'caution', 'column:name' FROM orders_task HAVING count(DISTINCT o_custkey) > 50 AND count(DISTINCT o_custkey) * 1e0 / count(*) < 98e-2""")
def readiness_features(spark, sf):
    o = d.orders_task(spark, sf).withColumns({
        "row_copy": F.col("row_id"), "flat": F.lit("same"), "rare": F.when(F.col("row_id") % 20 == 0, F.col("o_totalprice")),
        "name": F.concat(F.lit("Customer "), "o_custkey"),
    })
    spec = TaskSpec("urgent", "binary", ("row_copy", "flat", "rare", "name"), ("no", "yes"), "yes")
    return rd.assess(o, spec, K5).filter("scope like 'column:%'").select("code", "severity", "scope")


@query("readiness_duplicates", """SELECT 'duplicate_rows' AS code, CASE WHEN dup * 1e0 / n >= 5e-2 THEN 'high_risk' ELSE 'caution' END AS severity, CAST(dup AS VARCHAR) AS rows
FROM (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem)) AS dup FROM lineitem) WHERE dup > 0""")
def readiness_duplicates(spark, sf):
    spec = TaskSpec("l_returnflag", "multiclass", ("l_quantity", "l_discount", "l_tax"), ("A", "N", "R"))
    found = rd.assess(lineitem_rows(spark, sf), spec, K5).filter("code = 'duplicate_rows'")
    return found.select("code", "severity", F.col("observed").getItem("rows").alias("rows"))


@query("readiness_protocol_fit", """
SELECT 'time_structure_ignored' AS code, 'high_risk' AS severity, 'o_orderdate' AS columns UNION ALL
SELECT 'group_structure_ignored', 'high_risk', 'o_custkey' FROM orders HAVING count(DISTINCT o_custkey) * 1e0 / count(*) BETWEEN 2e-2 AND 6e-1""")
def readiness_protocol_fit(spark, sf):
    spec = TaskSpec("urgent", "binary", ("o_totalprice", "o_orderdate", "o_custkey"), ("no", "yes"), "yes")
    found = rd.assess(d.orders_task(spark, sf), spec, K5).filter("scope = 'protocol'")
    return found.select("code", "severity", F.array_join("columns", ",").alias("columns"))


@query("readiness_status", "SELECT 'BLOCKED' AS status FROM orders LIMIT 1")
def readiness_status(spark, sf):
    o = d.orders_task(spark, sf).withColumn("copied", F.col("urgent"))
    leaks = lk.inspect(_class_rows(spark, sf), CLASS_SPEC, K5)
    return rd.status(rd.assess(o, CLASS_SPEC, K5, leaks)).select("status")


@query("readiness_finding_order", "WITH " + _any_crossing(KFOLD_SQL, REPORT_KEY) + """
SELECT 'target_copy_among_features' AS code, 'high_risk' AS severity, 'structural' AS evidence_level, true AS blocking UNION ALL
SELECT 'duplicate_rows_cross_folds', 'high_risk', 'structural', share >= 5e-2 FROM crossed WHERE hit UNION ALL
SELECT 'single_feature_reconstructs_target', 'high_risk', 'evidence', false UNION ALL
SELECT 'missingness_encodes_target', 'high_risk', 'evidence', false UNION ALL
SELECT 'post_outcome_naming', 'info', 'heuristic', false""")
def readiness_finding_order(spark, sf):
    return lk.ordered(lk.inspect(_class_rows(spark, sf), CLASS_SPEC, K5)).select("code", "severity", "evidence_level", "blocking")


@query("task_analysis", "WITH " + _any_crossing(STRATIFIED_SQL, "t.o_totalprice || '/' || t.o_orderstatus || '/' || t.urgent") + """
SELECT 'task_type' AS item, 'binary' AS value UNION ALL SELECT 'splitter', 'stratified_k_fold' UNION ALL
SELECT 'risk', CASE WHEN share >= 5e-2 THEN 'confirmed' WHEN hit THEN 'high' ELSE 'none' END FROM crossed UNION ALL
SELECT 'status', CASE WHEN share >= 5e-2 THEN 'BLOCKED' WHEN hit THEN 'HIGH_RISK' ELSE 'READY' END FROM crossed""")
def task_analysis(spark, sf):
    from fairfold.plans.analyze import analyze_task

    # nothing names, times or groups these rows; only repeated (price, status, target) can cross
    o = d.orders_task(spark, sf).select("row_id", "urgent", "o_orderstatus", "o_totalprice")
    return analyze_task(o, "urgent", row_id="row_id").summary(spark).filter(
        F.col("item").isin("task_type", "splitter", "risk", "status")
    )
