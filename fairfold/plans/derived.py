"""Task tables and prediction tables derived from the given tables by arithmetic alone.

Each builder has a SQL twin (a list of CTEs for the comparison engine) so that everything computed on
top of it can be checked value by value.  Double literals are written with an exponent on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairfold.plans.registry import table
from fairfold.spec import TaskSpec

BINARY = TaskSpec(
    "urgent", "binary", ("o_totalprice", "o_orderstatus"), ("no", "yes"), "yes", group="o_custkey", time="o_orderdate"
)
MULTI = TaskSpec("o_orderstatus", "multiclass", ("o_totalprice", "o_orderpriority"), ("F", "O", "P"))
REGRESSION = TaskSpec("o_totalprice", "regression", ("o_custkey", "o_orderpriority"))
RUN = "run-1"


def orders_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with row_id, a binary target and a second numeric and a partly missing feature."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("row_id"), "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "yes").otherwise("no").alias("urgent"),
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("sparse_price"),
        (F.col("o_totalprice") * 2.5 + 7.0).alias("doubled_price"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("note-"), key % 13)).alias("closing_reason"),
    )


ORDERS_TASK_SQL = """
orders_task AS (
  SELECT o_orderkey AS row_id, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'yes' ELSE 'no' END AS urgent,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS sparse_price,
         o_totalprice * 25e-1 + 7e0 AS doubled_price,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL
              ELSE 'note-' || CAST(o_orderkey % 13 AS VARCHAR) END AS closing_reason
  FROM orders)"""


def _noise(number: int):
    return ((F.col("row_id") * 7919 + 104729 * number) % 1000) / F.lit(1000.0)


def _split_columns():
    m = (F.col("row_id") * 31) % 6
    return (
        F.when(m < 5, "cv").otherwise("holdout").alias("split"),
        F.when(m < 5, m).otherwise(-1).cast("int").alias("fold"),
    )


def _contenders(entries: list):
    return F.explode(F.array(*[F.struct(*[v.alias(k) for k, v in e.items()]) for e in entries])).alias("c")


def binary_predictions(spark: SparkSession, sf_dir: str, *, probes: bool = False) -> DataFrame:
    """Four contenders on every order: a constant, a good one, a fair one and one without scores."""
    rows = orders_task(spark, sf_dir).select("row_id", F.col("urgent").alias("y_true"), *_split_columns())
    sign = F.when(F.col("y_true") == "yes", 1.0).otherwise(-1.0)

    def contender(key: str, score, given: bool = True) -> dict:
        return {"key": F.lit(key), "score": score, "given": F.lit(given)}

    def expand(base: DataFrame, lift: float) -> DataFrame:
        every = [
            contender("baseline", F.lit(0.4)),
            contender("good", F.lit(0.5) + sign * (0.2 + lift) + (_noise(1) - 0.5) * 0.5),
            contender("fair", F.lit(0.5) + sign * (0.06 + lift) + (_noise(2) - 0.5) * 0.8),
            contender("noproba", F.lit(0.5) + sign * (0.1 + lift) + (_noise(3) - 0.5) * 0.5, False),
        ]
        p = F.least(F.greatest(F.col("c.score"), F.lit(0.0)), F.lit(1.0))
        return base.select("row_id", "y_true", "split", "fold", _contenders(every)).select(
            F.lit(RUN).alias("run_id"), F.col("c.key").alias("contender_key"), "row_id", "split", "fold", "y_true",
            F.when(p >= 0.5, "yes").otherwise("no").alias("y_pred"),
            F.when(F.col("c.given"), F.array((1 - p).cast("float"), p.cast("float"))).alias("proba"),
        )

    predictions = expand(rows, 0.0)
    if probes:
        probe_rows = (
            rows.filter("split = 'cv' and row_id % 10 = 0")
            .withColumn("fold", ((F.col("fold") + 1) % 5).cast("int"))
            .withColumn("split", F.lit("train_probe"))
        )
        predictions = predictions.unionByName(expand(probe_rows, 0.08))
    return predictions


BINARY_SQL = ORDERS_TASK_SQL + """,
bin_rows AS (
  SELECT row_id, urgent AS y_true,
         CASE WHEN (row_id * 31) % 6 < 5 THEN 'cv' ELSE 'holdout' END AS split,
         CAST(CASE WHEN (row_id * 31) % 6 < 5 THEN (row_id * 31) % 6 ELSE -1 END AS INTEGER) AS fold,
         0e0 AS lift
  FROM orders_task),
bin_probe AS (
  SELECT row_id, y_true, 'train_probe' AS split, CAST((fold + 1) % 5 AS INTEGER) AS fold, 8e-2 AS lift
  FROM bin_rows WHERE split = 'cv' AND row_id % 10 = 0),
bin_all AS (SELECT * FROM bin_rows UNION ALL SELECT * FROM bin_probe),
bin_scored AS (
  SELECT contender_key, given, row_id, split, fold, y_true,
         least(greatest(CASE contender_key
           WHEN 'baseline' THEN 4e-1
           WHEN 'good' THEN 5e-1 + s * (2e-1 + lift) + (u1 - 5e-1) * 5e-1
           WHEN 'fair' THEN 5e-1 + s * (6e-2 + lift) + (u2 - 5e-1) * 8e-1
           ELSE 5e-1 + s * (1e-1 + lift) + (u3 - 5e-1) * 5e-1 END, 0e0), 1e0) AS p
  FROM (SELECT *, CASE WHEN y_true = 'yes' THEN 1e0 ELSE -1e0 END AS s,
               ((row_id * 7919 + 104729) % 1000) / 1e3 AS u1,
               ((row_id * 7919 + 209458) % 1000) / 1e3 AS u2,
               ((row_id * 7919 + 314187) % 1000) / 1e3 AS u3 FROM bin_all),
       (VALUES ('baseline', true), ('good', true), ('fair', true), ('noproba', false)) c(contender_key, given)),
bin_every AS (
  SELECT 'run-1' AS run_id, contender_key, row_id, split, fold, y_true,
         CASE WHEN p >= 5e-1 THEN 'yes' ELSE 'no' END AS y_pred,
         CASE WHEN given THEN CAST(CAST(1 - p AS FLOAT) AS DOUBLE) END AS p_no,
         CASE WHEN given THEN CAST(CAST(p AS FLOAT) AS DOUBLE) END AS p_yes
  FROM bin_scored),
bin AS (SELECT * FROM bin_every WHERE split <> 'train_probe')"""


def multiclass_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three contenders for the order status; probabilities lean towards the truth by a weight."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("y_true")
    )
    rows = rows.select("*", *_split_columns())

    def lean(number: int, weight: float):
        guess = F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.floor(_noise(number) * 3) + 1).cast("int"))
        chosen = F.when(_noise(number + 1) < weight, F.col("y_true")).otherwise(guess)
        strength = F.lit(0.4) + _noise(number + 2) * 0.5
        rest = (1 - strength) / 2
        return {
            "pred": chosen,
            "proba": F.array(*[F.when(chosen == x, strength).otherwise(rest).cast("float") for x in ("F", "O", "P")]),
        }

    every = [
        {"key": F.lit("baseline"), "pred": F.lit("F"),
         "proba": F.array(F.lit(0.5).cast("float"), F.lit(0.25).cast("float"), F.lit(0.25).cast("float"))},
        {"key": F.lit("strong"), **lean(3, 0.7)},
        {"key": F.lit("weak"), **lean(11, 0.2)},
    ]
    return rows.select("row_id", "y_true", "split", "fold", _contenders(every)).select(
        F.lit(RUN).alias("run_id"), F.col("c.key").alias("contender_key"), "row_id", "split", "fold", "y_true",
        F.col("c.pred").alias("y_pred"), F.col("c.proba").alias("proba"),
    )


MULTI_SQL = """
multi_rows AS (
  SELECT o_orderkey AS row_id, o_orderstatus AS y_true,
         CASE WHEN (o_orderkey * 31) % 6 < 5 THEN 'cv' ELSE 'holdout' END AS split,
         CAST(CASE WHEN (o_orderkey * 31) % 6 < 5 THEN (o_orderkey * 31) % 6 ELSE -1 END AS INTEGER) AS fold
  FROM orders),
multi_chosen AS (
  SELECT row_id, y_true, split, fold, contender_key,
         CASE WHEN contender_key = 'baseline' THEN 'F'
              WHEN ((row_id * 7919 + 104729 * (n + 1)) % 1000) / 1e3 < w THEN y_true
              ELSE ['F', 'O', 'P'][CAST(floor(((row_id * 7919 + 104729 * n) % 1000) / 1e3 * 3) AS INTEGER) + 1]
         END AS y_pred,
         CASE WHEN contender_key = 'baseline' THEN 5e-1
              ELSE 4e-1 + ((row_id * 7919 + 104729 * (n + 2)) % 1000) / 1e3 * 5e-1 END AS strength
  FROM multi_rows, (VALUES ('baseline', 0, 0e0), ('strong', 3, 7e-1), ('weak', 11, 2e-1)) c(contender_key, n, w)),
multi AS (
  SELECT 'run-1' AS run_id, contender_key, row_id, split, fold, y_true, y_pred,
         CAST(CAST(CASE WHEN y_pred = 'F' THEN strength ELSE (1 - strength) / 2 END AS FLOAT) AS DOUBLE) AS p_f,
         CAST(CAST(CASE WHEN y_pred = 'O' THEN strength ELSE (1 - strength) / 2 END AS FLOAT) AS DOUBLE) AS p_o,
         CAST(CAST(CASE WHEN y_pred = 'P' THEN strength ELSE (1 - strength) / 2 END AS FLOAT) AS DOUBLE) AS p_p
  FROM multi_chosen)"""


def regression_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three contenders for the order total: a constant, a close one and a biased one."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("y_true")
    )
    rows = rows.select("*", *_split_columns())
    every = [
        {"key": F.lit("baseline"), "pred": F.lit(250000.0)},
        {"key": F.lit("close"), "pred": F.col("y_true") * (F.lit(1.0) + (_noise(5) - 0.5) * 0.2)},
        {"key": F.lit("biased"), "pred": F.col("y_true") * (F.lit(1.1) + (_noise(6) - 0.5) * 0.6) + 5000.0},
    ]
    return rows.select("row_id", "y_true", "split", "fold", _contenders(every)).select(
        F.lit(RUN).alias("run_id"), F.col("c.key").alias("contender_key"), "row_id", "split", "fold", "y_true",
        F.col("c.pred").alias("y_pred"),
    )


REGRESSION_SQL = """
reg AS (
  SELECT 'run-1' AS run_id, contender_key, o_orderkey AS row_id,
         CASE WHEN (o_orderkey * 31) % 6 < 5 THEN 'cv' ELSE 'holdout' END AS split,
         CAST(CASE WHEN (o_orderkey * 31) % 6 < 5 THEN (o_orderkey * 31) % 6 ELSE -1 END AS INTEGER) AS fold,
         o_totalprice AS y_true,
         CASE contender_key
           WHEN 'baseline' THEN 25e4
           WHEN 'close' THEN o_totalprice * (1e0 + (((o_orderkey * 7919 + 523645) % 1000) / 1e3 - 5e-1) * 2e-1)
           ELSE o_totalprice * (11e-1 + (((o_orderkey * 7919 + 628374) % 1000) / 1e3 - 5e-1) * 6e-1) + 5e3
         END AS y_pred
  FROM orders, (VALUES ('baseline'), ('close'), ('biased')) c(contender_key))"""


def contender_facts(spark: SparkSession, predictions: DataFrame, baseline: str = "baseline") -> DataFrame:
    """What the run recorded about each contender, here derived from the predictions themselves."""
    key = F.col("contender_key")
    return predictions.groupBy("run_id", "contender_key").agg(F.count(F.lit(1)).alias("rows")).select(
        "run_id", "contender_key", (key == baseline).alias("is_baseline"), F.lit("SUCCEEDED").alias("state"),
        (F.length(key) * 1.0).alias("cost"),
    )
