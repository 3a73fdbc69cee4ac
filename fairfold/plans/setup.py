"""Queries over prepared tables: profile, task setup, protocol, folds."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from fairfold import fixed
from fairfold.functions.scalars import calendar_parts, dtype_of, moment
from fairfold.operators import folds as fd
from fairfold.operators import profile as pf
from fairfold.operators import protocol as pc
from fairfold.operators import task as tk
from fairfold.operators.fingerprint import content_fingerprint, split_fingerprint
from fairfold.plans import derived as d
from fairfold.plans.registry import query, table
from fairfold.spec import Protocol, TaskSpec

# --- profile ------------------------------------------------------------------------------------


@query(
    "profile_table",
    "WITH " + d.ORDERS_TASK_SQL + """
SELECT count(*) AS row_count, 10 AS column_count,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_task)) AS duplicate_row_count,
       sum(CASE WHEN sparse_price IS NULL THEN 1 ELSE 0 END + CASE WHEN closing_reason IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing_cell_count,
       round(sum(CASE WHEN sparse_price IS NULL THEN 1 ELSE 0 END + CASE WHEN closing_reason IS NULL THEN 1 ELSE 0 END) / (count(*) * 10e0), 6) AS missing_cell_ratio
FROM orders_task""",
)
def profile_table(spark, sf):
    return pf.profile_table(d.orders_task(spark, sf))


def _columns_sql(source: str, columns: list[str], ctes: str = "") -> str:
    one = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
            round((count(*) - count({c})) * 1e0 / count(*), 6) AS missing_ratio,
            count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END AS unique_count,
            round((count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END) * 1e0 / count(*), 6) AS unique_ratio,
            count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END <= 1 AS is_constant
            FROM {source}"""
        for c in columns
    )
    return (f"WITH {ctes} " if ctes else "") + one


ORDERS_COLUMNS = [
    "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "urgent", "sparse_price",
    "doubled_price", "closing_reason",
]


@query("profile_columns_counts", _columns_sql("orders_task", ORDERS_COLUMNS, d.ORDERS_TASK_SQL))
def profile_columns_counts(spark, sf):
    p = pf.profile_columns(d.orders_task(spark, sf), row_id="row_id")
    return p.select("column", "missing_count", "missing_ratio", "unique_count", "unique_ratio", "is_constant")


@query("profile_lineitem_counts", _columns_sql("lineitem", [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate"]))
def profile_lineitem_counts(spark, sf):
    p = pf.profile_columns(table(spark, sf, "lineitem"))
    return p.select("column", "missing_count", "missing_ratio", "unique_count", "unique_ratio", "is_constant")


@query(
    "profile_duplicate_rows",
    """SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem)) AS distinct_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem)) AS duplicate_rows
FROM lineitem""",
)
def profile_duplicate_rows(spark, sf):
    return pf.duplicate_rows(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_returnflag"])


def _near_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", coalesce(max(n) * 1e0 / sum(n) >= 99e-2, false) AS is_near_constant
        FROM (SELECT {c}, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c})"""
        for c in columns
    )


@query("profile_near_constant", "WITH l AS (SELECT doc_id, quality, toxic, 1 AS one, CASE WHEN doc_id % 500 = 0 THEN 'rare' ELSE 'usual' END AS almost FROM labels) "
       + _near_sql("l", ["doc_id", "quality", "toxic", "one", "almost"]))
def profile_near_constant(spark, sf):
    l = table(spark, sf, "labels").withColumn("one", F.lit(1)).withColumn(
        "almost", F.when(F.col("doc_id") % 500 == 0, "rare").otherwise("usual")
    )
    return pf.profile_columns(l).select("column", "is_near_constant")


@query(
    "profile_probable_id",
    """SELECT 'customer.c_custkey' AS "column", true AS is_probable_id,
              CASE WHEN max(c_custkey) - min(c_custkey) + 1 = count(DISTINCT c_custkey) THEN 'gap_free_counter' ELSE 'almost_unique' END AS id_reason FROM customer
       UNION ALL SELECT 'customer.c_name', count(DISTINCT c_name) * 1e0 / count(*) >= 98e-2, CASE WHEN count(DISTINCT c_name) * 1e0 / count(*) >= 98e-2 THEN 'almost_unique' END FROM customer
       UNION ALL SELECT 'customer.c_acctbal', false, NULL
       UNION ALL SELECT 'customer.c_nationkey', false, NULL
       UNION ALL SELECT 'customer.c_mktsegment', false, NULL""",
)
def profile_probable_id(spark, sf):
    p = pf.profile_columns(table(spark, sf, "customer"))
    return p.select(F.concat(F.lit("customer."), "column").alias("column"), "is_probable_id", "id_reason")


def _stats_sql(source: str, columns: list[str], ctes: str = "") -> str:
    return (f"WITH {ctes} " if ctes else "") + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(min({c}), 2) * 1e0 AS "min", round(max({c}), 2) * 1e0 AS "max", round(avg({c}), 2) AS mean,
        round(median({c}), 2) * 1e0 AS median, round(stddev_samp({c}), 2) AS std,
        (SELECT round(x, 2) * 1e0 FROM (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) - 1 AS r, (SELECT count({c}) FROM {source}) AS n FROM {source} WHERE {c} IS NOT NULL)
          WHERE r = floor((n - 1) * 25e-2 + 5e-1)) AS q1,
        (SELECT round(x, 2) * 1e0 FROM (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) - 1 AS r, (SELECT count({c}) FROM {source}) AS n FROM {source} WHERE {c} IS NOT NULL)
          WHERE r = floor((n - 1) * 75e-2 + 5e-1)) AS q3 FROM {source}"""
        for c in columns
    )


@query("profile_numeric_stats", _stats_sql("orders_task", ["o_custkey", "o_totalprice", "sparse_price", "doubled_price"], d.ORDERS_TASK_SQL))
def profile_numeric_stats(spark, sf):
    p = pf.profile_columns(d.orders_task(spark, sf), row_id="row_id").filter("stats is not null")
    return p.select("column", *[F.round(f"stats.{c}", 2).alias(c) for c in ("min", "max", "mean", "median", "std", "q1", "q3")])


def _top_sql(columns: list[str]) -> str:
    return "WITH " + d.ORDERS_TASK_SQL + " ".join([""]) + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(place AS INTEGER) AS place, value, n AS "count", round(n * 1e0 / total, 6) AS ratio FROM (
        SELECT {c} AS value, count(*) AS n, sum(count(*)) OVER () AS total, row_number() OVER (ORDER BY count(*) DESC, {c}) AS place
        FROM orders_task WHERE {c} IS NOT NULL GROUP BY {c}) WHERE place <= 5"""
        for c in columns
    )


@query("profile_top_values", _top_sql(["o_orderstatus", "o_orderpriority", "urgent", "closing_reason"]))
def profile_top_values(spark, sf):
    p = pf.profile_columns(d.orders_task(spark, sf), row_id="row_id").filter("top_values is not null")
    return p.select("column", F.explode("top_values").alias("t")).select(
        "column", "t.place", "t.value", "t.count", "t.ratio"
    )


@query(
    "profile_examples",
    "WITH " + d.ORDERS_TASK_SQL + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", string_agg(v, '|' ORDER BY row_id) AS examples FROM (
        SELECT row_id, CAST({c} AS VARCHAR) AS v FROM orders_task WHERE {c} IS NOT NULL ORDER BY row_id LIMIT 5)"""
        for c in ("o_custkey", "o_orderstatus", "o_orderpriority", "urgent", "closing_reason")
    ),
)
def profile_examples(spark, sf):
    p = pf.profile_columns(d.orders_task(spark, sf), row_id="row_id")
    return p.filter(F.col("column").isin("o_custkey", "o_orderstatus", "o_orderpriority", "urgent", "closing_reason")).select(
        "column", F.array_join("examples", "|").alias("examples")
    )


@query(
    "profile_outliers",
    """WITH q AS (SELECT quantile_cont(value, 25e-2) AS a, quantile_cont(value, 75e-2) AS b FROM events)
SELECT event_id, value FROM events, q WHERE value < a - 15e-1 * (b - a) OR value > b + 15e-1 * (b - a)""",
)
def profile_outliers(spark, sf):
    return pf.outliers(table(spark, sf, "events"), "value", "event_id")


@query("profile_skewness", "SELECT round((avg(power(value - m, 3)) / power(avg(power(value - m, 2)), 15e-1)), 6) AS skewness FROM events, (SELECT avg(value) AS m FROM events)")
def profile_skewness(spark, sf):
    return table(spark, sf, "events").agg(F.round(F.skewness("value"), 6).alias("skewness"))


@query(
    "counter_gaps",
    """SELECT count(*) - count(DISTINCT o_orderkey) AS repeats,
       max(o_orderkey) - min(o_orderkey) + 1 - count(DISTINCT o_orderkey) AS holes,
       bool_and(step IS NULL OR step = 1) AS gap_free
FROM (SELECT o_orderkey, o_orderkey - lag(o_orderkey) OVER (ORDER BY o_orderkey) AS step FROM orders)""",
)
def counter_gaps(spark, sf):
    return pf.counter_gaps(table(spark, sf, "orders"), "o_orderkey")


@query("value_counts_head", "SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, user_id::VARCHAR) AS INTEGER) AS place, user_id::VARCHAR AS text, count(*) AS n FROM events GROUP BY user_id QUALIFY place <= 20")
def value_counts_head(spark, sf):
    return pf.value_counts(table(spark, sf, "events"), ["user_id"], 20).select("place", "text", "n")


# --- task setup ---------------------------------------------------------------------------------

TYPES = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(
    "task_type_inference",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS known_rows, count(DISTINCT {c}) AS distinct_values,
        CASE WHEN {text} OR count(DISTINCT {c}) <= greatest(20, least(50, round_even(count({c}) * 5e-2, 0))) THEN
          CASE WHEN count(DISTINCT {c}) > 1000 OR count(DISTINCT {c}) < 2 THEN NULL WHEN count(DISTINCT {c}) = 2 THEN 'binary' ELSE 'multiclass' END
          ELSE 'regression' END AS task_type,
        CASE WHEN count(DISTINCT {c}) < 2 THEN 'target_constant'
             WHEN ({text} OR count(DISTINCT {c}) <= greatest(20, least(50, round_even(count({c}) * 5e-2, 0)))) AND count(DISTINCT {c}) > 1000 THEN 'too_many_classes' END AS refusal
        FROM customer"""
        for c, text in zip(TYPES, ["false", "true", "false", "false", "true"], strict=True)
    ),
)
def task_type_inference(spark, sf):
    return tk.task_types(table(spark, sf, "customer"), TYPES)


@query("task_class_summary", """WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT count(*) AS classes, sum(n)::BIGINT AS usable_rows, (SELECT label FROM c ORDER BY n, label LIMIT 1) AS minority_label, min(n) AS minority_rows,
       (SELECT label FROM c ORDER BY n DESC, label LIMIT 1) AS majority_label, max(n) AS majority_rows FROM c""")
def task_class_summary(spark, sf):
    return tk.class_summary(table(spark, sf, "orders"), "o_orderpriority")


@query("task_class_counts", """SELECT CASE WHEN b THEN 'True' ELSE 'False' END AS label, count(*) AS n FROM (SELECT quality = 1 AS b FROM labels) GROUP BY 1""")
def task_class_counts(spark, sf):
    return tk.class_counts(table(spark, sf, "labels").select((F.col("quality") == 1).alias("b")), "b")


@query("task_labels", "SELECT DISTINCT o_orderpriority AS label FROM orders")
def task_labels(spark, sf):
    o = table(spark, sf, "orders")
    known = tk.bounded_labels(o, "o_orderpriority")
    return o.select(F.col("o_orderpriority").alias("label")).filter(F.col("label").isin(known)).distinct()


@query("task_usable_rows", "WITH " + d.ORDERS_TASK_SQL + " SELECT row_id, round(sparse_price, 2) AS sparse_price FROM orders_task WHERE sparse_price IS NOT NULL")
def task_usable_rows(spark, sf):
    rows = tk.usable(d.orders_task(spark, sf), "sparse_price")
    return tk.project_features(rows, ("sparse_price",), "row_id").withColumn("sparse_price", F.round("sparse_price", 2))


@query("task_time_candidates", "SELECT 'moment' AS name UNION ALL SELECT 'written' WHERE (SELECT count(DISTINCT ts) FROM events) >= 10")
def task_time_candidates(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), F.col("ts").alias("moment"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("written"),
        "event_type", "props", "value",
    )
    _, stats, _ = pf.column_stats(e, [c for c in e.columns if c != "row_id"])
    names = tk.time_candidates(e, stats)
    return spark.createDataFrame([(n,) for n in names], "name string")


@query("task_group_candidates", " UNION ALL ".join(
    f"""SELECT '{c}' AS name FROM orders HAVING count(DISTINCT {c}) >= 5 AND count(DISTINCT {c}) < count(*)
        AND count(DISTINCT {c}) * 1e0 / count(*) BETWEEN 2e-2 AND 6e-1""" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))
def task_group_candidates(spark, sf):
    o = table(spark, sf, "orders")
    rows, stats, _ = pf.column_stats(o, o.columns)
    return spark.createDataFrame([(n,) for n in tk.group_candidates(rows, stats)], "name string")


@query("task_effective_dimension", """SELECT (6 + 1 + 1 + least(count(DISTINCT o_orderstatus), 50) + least(count(DISTINCT o_orderpriority), 50))::BIGINT AS effective_dimension FROM orders""")
def task_effective_dimension(spark, sf):
    o = table(spark, sf, "orders")
    _, stats, _ = pf.column_stats(o, ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    return spark.createDataFrame([(tk.effective_dimension(stats),)], "effective_dimension long")


@query("task_model_context", "WITH " + d.ORDERS_TASK_SQL + """
SELECT 'binary' AS task_type, count(*) AS n_rows, 1000 AS n_train_rows, 4 AS n_features,
       (6 + 1 + least(count(DISTINCT o_orderstatus), 50) + least(count(DISTINCT closing_reason) + 1, 50)) AS effective_dimension,
       1 AS n_numeric, 2 AS n_categorical, 1 AS n_datetime,
       greatest(count(DISTINCT o_orderstatus), count(DISTINCT closing_reason) + 1, count(DISTINCT o_orderdate)) AS max_cardinality,
       round((count(*) - count(closing_reason) + count(*) - count(sparse_price)) / (4e0 * count(*)), 6) AS missing_ratio, true AS has_missing,
       2 AS n_classes, least(sum(CASE WHEN urgent = 'yes' THEN 1 ELSE 0 END), sum(CASE WHEN urgent = 'no' THEN 1 ELSE 0 END)) AS min_class_count,
       8000 * (6 + 1 + least(count(DISTINCT o_orderstatus), 50) + least(count(DISTINCT closing_reason) + 1, 50)) AS matrix_bytes
FROM orders_task""")
def task_model_context(spark, sf):
    spec = TaskSpec("urgent", "binary", ("o_orderdate", "sparse_price", "o_orderstatus", "closing_reason"), ("no", "yes"), "yes")
    return tk.model_context(d.orders_task(spark, sf), spec, 1000)


@query("task_group_statistics", "SELECT count(*) AS groups, round(avg(n), 6) AS rows_per_group, max(n) AS largest_group FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def task_group_statistics(spark, sf):
    g = tk.group_statistics(table(spark, sf, "orders"), "o_custkey")
    return g.withColumn("rows_per_group", F.round("rows_per_group", 6))


@query("task_suggested_exclusions", """SELECT 'c_custkey' AS "column", 'row_key' AS reason, round(count(DISTINCT c_custkey) * 1e0 / count(*), 6) AS unique_ratio FROM customer
UNION ALL SELECT 'c_name', 'identifier_hint', round(count(DISTINCT c_name) * 1e0 / count(*), 6) FROM customer""")
def task_suggested_exclusions(spark, sf):
    c = table(spark, sf, "customer")
    _, stats, _ = pf.column_stats(c, c.columns)
    rows = tk.suggested_exclusions(stats, "c_mktsegment", ("c_custkey",), ("c_name", "c_custkey"))
    return spark.createDataFrame(rows, "column string, reason string, unique_ratio double")


@query("task_setup_proposal", """
SELECT 'target' AS item, 'o_orderstatus' AS value UNION ALL SELECT 'task_type', 'multiclass' UNION ALL
SELECT 'usable_rows', CAST(count(o_orderstatus) AS VARCHAR) FROM orders UNION ALL
SELECT DISTINCT 'label', o_orderstatus FROM orders UNION ALL
SELECT 'feature', unnest(['o_custkey', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) UNION ALL
SELECT 'time_candidate', 'o_orderdate' UNION ALL
SELECT 'group_candidate', 'o_custkey' FROM orders HAVING count(DISTINCT o_custkey) * 1e0 / count(*) BETWEEN 2e-2 AND 6e-1""")
def task_setup_proposal(spark, sf):
    return tk.propose_task(table(spark, sf, "orders"), "o_orderstatus", row_id="o_orderkey").as_dataframe(spark)


@query("protocol_recommendation", """
SELECT 'grouped' AS task, 'splitter' AS item, 'stratified_group_k_fold' AS value UNION ALL SELECT 'grouped', 'holdout', 'group' UNION ALL
SELECT 'timed', 'splitter', CASE WHEN (SELECT count(DISTINCT o_orderdate) FROM orders) >= 3 THEN 'forward_chaining' ELSE 'k_fold' END UNION ALL SELECT 'timed', 'holdout', 'temporal' UNION ALL
SELECT 'classes', 'splitter', 'stratified_k_fold' UNION ALL SELECT 'classes', 'holdout', 'stratified' UNION ALL
SELECT 'number', 'splitter', 'k_fold' UNION ALL SELECT 'number', 'holdout', 'random'""")
def protocol_recommendation(spark, sf):
    o = d.orders_task(spark, sf)
    tasks = {
        "grouped": TaskSpec("urgent", "binary", ("o_totalprice",), ("no", "yes"), "yes", group="o_custkey"),
        "timed": TaskSpec("urgent", "binary", ("o_totalprice",), ("no", "yes"), "yes", time="o_orderdate"),
        "classes": TaskSpec("urgent", "binary", ("o_totalprice",), ("no", "yes"), "yes"),
        "number": TaskSpec("o_totalprice", "regression", ("o_orderpriority",)),
    }
    parts = [
        pc.describe(pc.recommend(o, spec), spark).select(F.lit(name).alias("task"), "item", "value")
        for name, spec in tasks.items()
    ]
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p)
    return united.filter(F.col("item").isin("splitter", "holdout"))


@query("protocol_warnings", """
SELECT 'time_columns_not_used:o_orderdate' AS value UNION ALL
SELECT 'group_columns_not_used:o_custkey' FROM orders HAVING count(DISTINCT o_custkey) * 1e0 / count(*) BETWEEN 2e-2 AND 6e-1""")
def protocol_warnings(spark, sf):
    spec = TaskSpec("urgent", "binary", ("o_custkey", "o_totalprice", "o_orderdate"), ("no", "yes"), "yes")
    shown = pc.describe(pc.recommend(d.orders_task(spark, sf), spec), spark)
    return shown.filter("item = 'warning'").select("value")


@query("protocol_structural_facts", "SELECT count(*) AS usable_rows, count(DISTINCT o_custkey) AS groups, count(DISTINCT o_orderdate) AS periods FROM orders")
def protocol_structural_facts(spark, sf):
    return pc.structural_facts(d.orders_task(spark, sf), d.BINARY)


# --- scalar functions ---------------------------------------------------------------------------


@query("scalar_calendar_parts", """SELECT event_id, year(ts) * 1e0 AS year, month(ts) * 1e0 AS month, day(ts) * 1e0 AS day, (isodow(ts) - 1) * 1e0 AS dayofweek,
quarter(ts) * 1e0 AS quarter, round(epoch_us(ts) / 864e8, 6) AS epoch_days FROM events""")
def scalar_calendar_parts(spark, sf):
    e = table(spark, sf, "events")
    parts = calendar_parts("ts", dtype_of(e, "ts"))
    return e.select("event_id", *[(F.round(c, 6) if k == "epoch_days" else c).alias(k) for k, c in parts.items()])


@query("scalar_lenient_timestamp", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS micros FROM events""")
def scalar_lenient_timestamp(spark, sf):
    e = table(spark, sf, "events")
    text = F.when(F.col("event_id") % 5 == 0, F.lit("not a date")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    w = e.select("event_id", text.alias("t"))
    return w.select("event_id", F.unix_micros(moment("t", dtype_of(w, "t"))).alias("micros"))


@query("scalar_label_text", "SELECT doc_id, CASE WHEN quality = 1 THEN 'True' ELSE 'False' END AS as_boolean, CAST(toxic AS VARCHAR) AS as_number FROM labels")
def scalar_label_text(spark, sf):
    from fairfold.functions.scalars import label_text

    l = table(spark, sf, "labels").withColumn("b", F.col("quality") == 1)
    return l.select("doc_id", label_text("b", dtype_of(l, "b")).alias("as_boolean"), label_text("toxic", dtype_of(l, "toxic")).alias("as_number"))


@query("scalar_safe_ratio", "SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 0e0 ELSE round(c_acctbal / c_nationkey, 6) END AS ratio FROM customer")
def scalar_safe_ratio(spark, sf):
    from fairfold.functions.scalars import safe_ratio

    return table(spark, sf, "customer").select("c_custkey", safe_ratio(F.col("c_acctbal"), F.col("c_nationkey")).alias("ratio"))


@query("scalar_joined_text", "SELECT o_orderkey, sha256(coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END, '<none>') || '~' || o_orderpriority) AS digest FROM orders")
def scalar_joined_text(spark, sf):
    from fairfold.functions.scalars import joined_text

    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus"))
    return o.select("o_orderkey", F.sha2(joined_text([status, F.col("o_orderpriority")], "~", "<none>"), 256).alias("digest"))


@query("scalar_nfc_text", "SELECT doc_id, sha256(nfc_normalize(text)) AS digest FROM documents")
def scalar_nfc_text(spark, sf):
    from fairfold.functions.scalars import nfc

    return table(spark, sf, "documents").select("doc_id", F.sha2(nfc(F.col("text")), 256).alias("digest"))


@query("scalar_plain_numbers", """SELECT s_suppkey, rtrim(rtrim(CAST(CAST(s_acctbal AS DECIMAL(18, 4)) AS VARCHAR), '0'), '.') AS plain,
CASE WHEN s_nationkey = 3 THEN 0e0 ELSE s_acctbal END AS one_zero FROM supplier""")
def scalar_plain_numbers(spark, sf):
    from fairfold.functions.scalars import plain_decimal, plain_float

    s = table(spark, sf, "supplier")
    signed = F.when(F.col("s_nationkey") == 3, F.lit(-0.0)).otherwise(F.col("s_acctbal"))
    return s.select("s_suppkey", plain_decimal(F.col("s_acctbal").cast("decimal(18,4)")).alias("plain"), plain_float(signed).alias("one_zero"))


# --- folds --------------------------------------------------------------------------------------

HASH = "md5('42:order:' || row_id)"
SIMPLE = TaskSpec("urgent", "binary", ("o_totalprice",), ("no", "yes"), "yes", group="o_custkey", time="o_orderdate")
K5 = Protocol("k_fold", holdout="random")
STRATIFIED = Protocol("stratified_k_fold", holdout="stratified")
GROUPED = Protocol("group_k_fold", holdout="group")
GROUPED_STRATIFIED = Protocol("stratified_group_k_fold", holdout="group")
FORWARD = Protocol("forward_chaining", holdout="temporal")

KFOLD_SQL = d.ORDERS_TASK_SQL + f""",
ordered AS (SELECT row_id, row_number() OVER (ORDER BY {HASH}, row_id) AS r, count(*) OVER () AS n FROM orders_task),
assigned AS (
  SELECT row_id, 'holdout' AS part, CAST(NULL AS INTEGER) AS chunk FROM ordered WHERE r <= ceil(2e-1 * n)
  UNION ALL
  SELECT row_id, 'pool', CAST(ntile(5) OVER (ORDER BY r) - 1 AS INTEGER) FROM ordered WHERE r > ceil(2e-1 * n))"""


@query("folds_k_fold", "WITH " + KFOLD_SQL + " SELECT * FROM assigned")
def folds_k_fold(spark, sf):
    return fd.assign(d.orders_task(spark, sf), SIMPLE, K5)


STRATIFIED_SQL = d.ORDERS_TASK_SQL + f""",
sizes AS (SELECT urgent AS c, count(*) AS m FROM orders_task GROUP BY 1),
quota AS (
  SELECT c, m, floor(2e-1 * m) + CASE WHEN row_number() OVER (ORDER BY 2e-1 * m - floor(2e-1 * m) DESC, c)
         <= ceil(2e-1 * sum(m) OVER ()) - sum(floor(2e-1 * m)) OVER () THEN 1 ELSE 0 END AS q FROM sizes),
starts AS (SELECT *, coalesce(sum(m - q) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM quota),
assigned AS (
  SELECT row_id, c, CASE WHEN r <= q THEN 'holdout' ELSE 'pool' END AS part,
         CASE WHEN r > q THEN CAST((r - q - 1 + s) % 5 AS INTEGER) END AS chunk
  FROM (SELECT row_id, urgent, row_number() OVER (PARTITION BY urgent ORDER BY {HASH}, row_id) AS r FROM orders_task) o
  JOIN starts ON c = urgent)"""


@query("folds_stratified", "WITH " + STRATIFIED_SQL + " SELECT row_id, part, chunk FROM assigned")
def folds_stratified(spark, sf):
    return fd.assign(d.orders_task(spark, sf), SIMPLE, STRATIFIED)


@query("folds_stratified_shares", "WITH " + STRATIFIED_SQL + " SELECT part, chunk, c AS label, count(*) AS n FROM assigned GROUP BY ALL")
def folds_stratified_shares(spark, sf):
    a = fd.assign(d.orders_task(spark, sf), SIMPLE, STRATIFIED, keep=("urgent",))
    return a.groupBy("part", "chunk", F.col("urgent").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _group_sql(stratified: bool) -> str:
    order = "c, m DESC, h" if stratified else "m DESC, h"
    return d.ORDERS_TASK_SQL + f""",
cells AS (SELECT CAST(o_custkey AS VARCHAR) AS g, urgent AS c, count(*) AS k FROM orders_task GROUP BY ALL),
groups AS (
  SELECT g, sum(k) AS m, first(c ORDER BY k DESC, c) AS c, md5('42:group:' || g) AS h FROM cells GROUP BY g),
held AS (SELECT *, row_number() OVER (ORDER BY h, g) AS hr, count(*) OVER () AS n FROM groups),
placed AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS p FROM held WHERE hr > ceil(2e-1 * n)),
plan AS (
  SELECT g, 'pool' AS part, CAST(CASE WHEN p % 10 < 5 THEN p % 10 ELSE 9 - p % 10 END AS INTEGER) AS chunk FROM placed
  UNION ALL SELECT g, 'holdout', NULL FROM held WHERE hr <= ceil(2e-1 * n)),
assigned AS (SELECT row_id, o_custkey, part, chunk FROM orders_task JOIN plan ON g = CAST(o_custkey AS VARCHAR))"""


@query("folds_group", "WITH " + _group_sql(False) + " SELECT row_id, part, chunk FROM assigned")
def folds_group(spark, sf):
    return fd.assign(d.orders_task(spark, sf), SIMPLE, GROUPED)


@query("folds_stratified_group", "WITH " + _group_sql(True) + " SELECT row_id, part, chunk FROM assigned")
def folds_stratified_group(spark, sf):
    return fd.assign(d.orders_task(spark, sf), SIMPLE, GROUPED_STRATIFIED)


FORWARD_SQL = d.ORDERS_TASK_SQL + """,
ordered AS (SELECT row_id, o_orderdate, row_number() OVER (ORDER BY o_orderdate NULLS FIRST, row_id) AS r, count(*) OVER () AS n FROM orders_task),
assigned AS (
  SELECT row_id, o_orderdate, 'holdout' AS part, CAST(NULL AS INTEGER) AS chunk FROM ordered WHERE r > n - greatest(1, round_even(2e-1 * n, 0))
  UNION ALL
  SELECT row_id, o_orderdate, 'pool', CAST(ntile(6) OVER (ORDER BY r) - 1 AS INTEGER) FROM ordered WHERE r <= n - greatest(1, round_even(2e-1 * n, 0)))"""


@query("folds_forward_chaining", "WITH " + FORWARD_SQL + " SELECT row_id, part, chunk FROM assigned")
def folds_forward_chaining(spark, sf):
    return fd.assign(d.orders_task(spark, sf), SIMPLE, FORWARD)


# moments that do not parse are the past: first in order, never held out
@query("folds_unknown_time", """WITH e AS (SELECT event_id AS row_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS ts FROM events),
ordered AS (SELECT row_id, ts, row_number() OVER (ORDER BY ts NULLS FIRST, row_id) AS r, count(*) OVER () AS n FROM e),
a AS (SELECT row_id, ts, CASE WHEN r > n - greatest(1, round_even(2e-1 * n, 0)) THEN 'holdout' ELSE 'pool' END AS part,
      r, n - greatest(1, round_even(2e-1 * n, 0)) AS np FROM ordered),
b AS (SELECT row_id, ts, part, CASE WHEN part = 'pool' THEN ntile(6) OVER (PARTITION BY part ORDER BY r) - 1 END AS chunk FROM a)
SELECT part, CAST(chunk AS INTEGER) AS chunk, count(*) AS n, sum(CASE WHEN ts IS NULL THEN 1 ELSE 0 END)::BIGINT AS unknown FROM b GROUP BY ALL""")
def folds_unknown_time(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("ts"), F.col("event_type").alias("y")
    )
    spec = TaskSpec("y", "multiclass", (), time="ts")
    a = fd.assign(e, spec, FORWARD, keep=("ts",))
    return a.groupBy("part", "chunk").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts").isNull()).alias("unknown"))


@query("folds_lineitem_sizes", """WITH l AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row_id, l_returnflag AS c FROM lineitem),
sizes AS (SELECT c, count(*) AS m FROM l GROUP BY 1),
quota AS (SELECT c, m, floor(2e-1 * m) + CASE WHEN row_number() OVER (ORDER BY 2e-1 * m - floor(2e-1 * m) DESC, c)
  <= ceil(2e-1 * sum(m) OVER ()) - sum(floor(2e-1 * m)) OVER () THEN 1 ELSE 0 END AS q FROM sizes)
SELECT 'holdout' AS part, c AS label, CAST(q AS BIGINT) AS n FROM quota UNION ALL SELECT 'pool', c, CAST(m - q AS BIGINT) FROM quota""")
def folds_lineitem_sizes(spark, sf):
    l = lineitem_rows(spark, sf)
    spec = TaskSpec("l_returnflag", "multiclass", (), ("A", "N", "R"))
    a = fd.assign(l, spec, STRATIFIED, keep=("l_returnflag",))
    return a.groupBy("part", F.col("l_returnflag").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def lineitem_rows(spark, sf):
    """lineitem numbered by storage position."""
    from fairfold.operators.rowid import with_row_id

    return with_row_id(spark, [f"{sf}/lineitem.parquet"])


@query("row_id_storage_position", "SELECT count(*) AS n, min(file_row_number) AS low, max(file_row_number) AS high, sum(file_row_number * l_linenumber)::BIGINT AS weighted FROM (SELECT row_number() OVER () - 1 AS file_row_number, l_linenumber FROM lineitem)")
def row_id_storage_position(spark, sf):
    return lineitem_rows(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("low"), F.max("row_id").alias("high"),
        F.sum(F.col("row_id") * F.col("l_linenumber")).alias("weighted"),
    )


@query("folds_sizes", "WITH " + FORWARD_SQL + """
SELECT CAST(f AS INTEGER) AS fold, sum(CASE WHEN chunk <= f THEN 1 ELSE 0 END)::BIGINT AS train_rows, sum(CASE WHEN chunk = f + 1 THEN 1 ELSE 0 END)::BIGINT AS validation_rows
FROM assigned, range(5) t(f) WHERE part = 'pool' GROUP BY f""")
def folds_sizes(spark, sf):
    return fd.fold_sizes(fd.assign(d.orders_task(spark, sf), SIMPLE, FORWARD), FORWARD)


@query("folds_train_validation_overlap", "SELECT CAST(0 AS BIGINT) AS overlapping_rows, count(*) - count(DISTINCT o_orderkey) AS repeated_rows FROM orders")
def folds_train_validation_overlap(spark, sf):
    return fd.overlap(fd.assign(d.orders_task(spark, sf), SIMPLE, K5), K5)


@query("folds_train_probe", "WITH " + KFOLD_SQL + """
SELECT CAST(f AS INTEGER) AS fold, row_id FROM (
  SELECT f, row_id, row_number() OVER (PARTITION BY f ORDER BY md5('42:probe:' || row_id), row_id) AS place
  FROM assigned, range(5) t(f) WHERE part = 'pool' AND chunk <> f) WHERE place <= 2000""")
def folds_train_probe(spark, sf):
    return fd.train_probe(fd.assign(d.orders_task(spark, sf), SIMPLE, K5), K5)


@query("folds_growing_subsets", "WITH " + FORWARD_SQL + """,
m AS (SELECT f, row_id, row_number() OVER (PARTITION BY f ORDER BY md5('42:subset:' || row_id), row_id) AS place, count(*) OVER (PARTITION BY f) AS n
  FROM assigned, range(5) t(f) WHERE part = 'pool' AND chunk <= f)
SELECT fraction, CAST(f AS INTEGER) AS fold, count(*) AS n, sum(row_id)::BIGINT AS id_sum
FROM m, (VALUES (25e-2), (5e-1), (75e-2), (1e0)) v(fraction) WHERE place <= least(greatest(20, round_even(n * fraction, 0)), n) GROUP BY ALL""")
def folds_growing_subsets(spark, sf):
    subsets = fd.growing_subsets(fd.assign(d.orders_task(spark, sf), SIMPLE, FORWARD), FORWARD)
    return subsets.groupBy("fraction", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("id_sum"))


@query("folds_permutation_pairs", """WITH a AS (SELECT s_suppkey AS row_id, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier),
b AS (SELECT t.repeat, s_suppkey AS donor_id, row_number() OVER (PARTITION BY t.repeat ORDER BY md5('42:permute:' || t.repeat || ':' || s_suppkey)) AS r FROM supplier, range(3) t(repeat))
SELECT CAST(repeat AS INTEGER) AS repeat, row_id, donor_id FROM a JOIN b USING (r)""")
def folds_permutation_pairs(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"))
    return fd.permutation_pairs(s, 3, 42, n_rows=s.count())


@query("folds_rank_buckets", "WITH " + d.ORDERS_TASK_SQL + f" SELECT row_id, row_number() OVER (ORDER BY {HASH}, row_id) AS by_hash, row_number() OVER (ORDER BY o_totalprice NULLS FIRST, row_id) AS by_value FROM orders_task")
def folds_rank_buckets(spark, sf):
    from fairfold.functions.ordering import seeded_hash
    from fairfold.operators.ranking import hash_rank, value_rank

    o = d.orders_task(spark, sf).select("row_id", "o_totalprice").withColumn("h", seeded_hash(42, "order", F.col("row_id")))
    n = o.count()
    ranked = hash_rank(o, "h", "row_id", n_rows=n, out="by_hash", rows_per_bucket=1_000)
    return value_rank(ranked, "o_totalprice", "row_id", n_rows=n, out="by_value", rows_per_bucket=1_000).select("row_id", "by_hash", "by_value")


def _tree_sql(digests: str, header: str) -> str:
    """Three levels of runs of 65 536 row ids, then the root, over CTE ``digests(i, h)``."""
    levels = digests
    for k in range(3):
        levels += f""",
level{k + 1} AS (SELECT i // 65536 AS i, sha256(string_agg(i || '=' || h, chr(10) ORDER BY i)) AS h FROM level{k} GROUP BY i // 65536)"""
    return levels + f""" SELECT 'row-tree-sha256-v1' AS algorithm, sha256('{header}' || chr(10) || string_agg(h, chr(10) ORDER BY i)) AS fingerprint FROM level3"""


@query("fingerprint_split", "WITH " + _tree_sql(
    FORWARD_SQL + ", level0 AS (SELECT row_id AS i, sha256(row_id || '|' || part || '|' || coalesce(CAST(chunk AS VARCHAR), '-')) AS h FROM assigned)",
    '["forward_chaining", 5, true]'))
def fingerprint_split(spark, sf):
    return split_fingerprint(fd.assign(d.orders_task(spark, sf), SIMPLE, FORWARD), FORWARD)


LINEITEM_TYPES = {
    "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer", "l_quantity": "float",
    "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "datetime",
}


def _cell_sql(name: str, kind: str) -> str:
    text = f"CAST({f'epoch_us({name})' if kind == 'datetime' else name} AS VARCHAR)"
    return f"strlen({text}) || ':' || {text}"


@query("fingerprint_content", "WITH " + _tree_sql(
    "level0 AS (SELECT row_number() OVER () - 1 AS i, sha256(" + " || ".join(_cell_sql(k, v) for k, v in LINEITEM_TYPES.items()) + ") AS h FROM lineitem)",
    json.dumps(list(LINEITEM_TYPES.items()))))
def fingerprint_content(spark, sf):
    return content_fingerprint(lineitem_rows(spark, sf), "row_id")
