"""Queries over predictions: metrics, leaderboard, champion."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairfold import fixed
from fairfold.operators import leaderboard as lb
from fairfold.operators import metrics as mt
from fairfold.operators import predictions as pr
from fairfold.plans import derived as d
from fairfold.plans.registry import query
from fairfold.spec import Constraint, Objective

KEYS = "run_id, contender_key, split, fold"


def _metric(folds, metric):
    return folds.filter(F.col("metric") == metric).select("contender_key", "split", "fold", "value", "note")


# --- SQL building blocks ------------------------------------------------------------------------

ROC_SQL = d.BINARY_SQL + """,
norm AS (SELECT *, p_yes / (p_no + p_yes) AS score FROM bin),
steps AS (
  SELECT contender_key, split, fold, score,
         sum(CASE WHEN y_true = 'yes' THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y_true = 'no' THEN 1 ELSE 0 END) AS neg
  FROM norm WHERE score IS NOT NULL GROUP BY ALL),
curve AS (
  SELECT *, sum(pos) OVER w AS cpos, sum(neg) OVER w AS cneg,
         sum(pos) OVER (PARTITION BY contender_key, split, fold) AS tpos,
         sum(neg) OVER (PARTITION BY contender_key, split, fold) AS tneg
  FROM steps WINDOW w AS (PARTITION BY contender_key, split, fold ORDER BY score DESC)),
areas AS (
  SELECT contender_key, split, fold,
         sum(neg * (cpos - pos / 2e0)) / max(tpos * 1e0 * tneg) AS roc,
         sum(pos * (cpos * 1e0 / (cpos + cneg))) / max(tpos) AS ap
  FROM curve GROUP BY ALL),
parts AS (SELECT DISTINCT contender_key, split, fold FROM bin)"""

BIN_FOLDS_SQL = ROC_SQL + """,
counts AS (
  SELECT contender_key, split, fold, count(*) AS n,
         avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END) AS acc,
         sum(CASE WHEN y_true = 'yes' AND y_pred = 'yes' THEN 1e0 ELSE 0e0 END) AS tp,
         sum(CASE WHEN y_true = 'no' AND y_pred = 'no' THEN 1e0 ELSE 0e0 END) AS tn,
         sum(CASE WHEN y_pred = 'yes' THEN 1e0 ELSE 0e0 END) AS named,
         sum(CASE WHEN y_true = 'yes' THEN 1e0 ELSE 0e0 END) AS real,
         sum(CASE WHEN y_true = 'no' THEN 1e0 ELSE 0e0 END) AS unreal,
         avg(power(score - CASE WHEN y_true = 'yes' THEN 1e0 ELSE 0e0 END, 2)) AS brier,
         avg(CASE WHEN score IS NOT NULL THEN -ln(greatest(least(CASE WHEN y_true = 'yes' THEN score ELSE p_no / (p_no + p_yes) END,
                                1e0 - 2.220446049250313e-16), 2.220446049250313e-16)) END) AS ll
  FROM norm GROUP BY ALL),
wide AS (
  SELECT c.*, roc, ap FROM counts c LEFT JOIN areas a USING (contender_key, split, fold)),
folds AS (
  SELECT contender_key, split, fold, metric, round(value, 6) AS value
  FROM (SELECT contender_key, split, fold,
               unnest([{'m': 'roc_auc', 'v': roc}, {'m': 'pr_auc', 'v': ap},
                       {'m': 'f1', 'v': CASE WHEN named + real = 0 THEN 0e0 ELSE 2 * tp / (named + real) END},
                       {'m': 'precision', 'v': CASE WHEN named = 0 THEN 0e0 ELSE tp / named END},
                       {'m': 'recall', 'v': CASE WHEN real = 0 THEN 0e0 ELSE tp / real END},
                       {'m': 'accuracy', 'v': acc},
                       {'m': 'balanced_accuracy', 'v': (tp / real + tn / unreal) / 2},
                       {'m': 'log_loss', 'v': ll}, {'m': 'brier', 'v': brier}]) AS x
        FROM wide), LATERAL (SELECT x.m AS metric, x.v AS value))"""

CV_SQL = """,
cv AS (
  SELECT contender_key, metric, round(avg(value), 6) AS value,
         CASE WHEN count(value) > 1 THEN round(stddev_pop(value), 6) END AS std,
         count(value) AS folds_measured, count(*) AS folds_total
  FROM folds WHERE split = 'cv' GROUP BY ALL)"""


def _binary_folds(spark, sf):
    return mt.fold_metrics(d.binary_predictions(spark, sf), d.BINARY)


def _single(metric: str, title: str) -> None:
    @query(
        title,
        "WITH " + BIN_FOLDS_SQL + f"""
SELECT contender_key, split, fold, value,
       CASE WHEN value IS NULL THEN 'no_probabilities' ELSE '' END AS note
FROM folds WHERE metric = '{metric}'""",
    )
    def build(spark, sf, metric=metric):
        return _metric(_binary_folds(spark, sf), metric)


_single("accuracy", "metric_accuracy")
_single("balanced_accuracy", "metric_balanced_accuracy")
_single("precision", "metric_precision")
_single("recall", "metric_recall")
_single("f1", "metric_f1")
_single("roc_auc", "metric_roc_auc")
_single("pr_auc", "metric_pr_auc")
_single("brier", "metric_brier")
_single("log_loss", "metric_log_loss")


@query(
    "metrics_binary_all",
    "WITH " + BIN_FOLDS_SQL + " SELECT contender_key, split, fold, metric, value FROM folds",
)
def metrics_binary_all(spark, sf):
    return _binary_folds(spark, sf).select("contender_key", "split", "fold", "metric", "value")


MULTI_FOLDS_SQL = d.MULTI_SQL + """,
per_class AS (
  SELECT contender_key, split, fold, label,
         sum(CASE WHEN y_true = label THEN 1e0 ELSE 0e0 END) AS real,
         sum(CASE WHEN y_pred = label THEN 1e0 ELSE 0e0 END) AS named,
         sum(CASE WHEN y_true = label AND y_pred = label THEN 1e0 ELSE 0e0 END) AS tp
  FROM multi, (VALUES ('F'), ('O'), ('P')) l(label) GROUP BY ALL),
macro AS (
  SELECT contender_key, split, fold,
         avg(CASE WHEN real + named = 0 THEN 0e0 ELSE 2 * tp / (real + named) END) AS macro_f1,
         avg(CASE WHEN real > 0 THEN tp / real END) AS bal
  FROM per_class GROUP BY ALL),
plain AS (
  SELECT contender_key, split, fold, avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END) AS acc,
         avg(-ln(greatest(least((CASE y_true WHEN 'F' THEN p_f WHEN 'O' THEN p_o ELSE p_p END) / (p_f + p_o + p_p),
             1e0 - 2.220446049250313e-16), 2.220446049250313e-16))) AS ll
  FROM multi GROUP BY ALL)"""


@query(
    "metric_macro_f1",
    "WITH " + MULTI_FOLDS_SQL + """
SELECT contender_key, split, fold, round(macro_f1, 6) AS value, '' AS note FROM macro""",
)
def metric_macro_f1(spark, sf):
    return _metric(mt.fold_metrics(d.multiclass_predictions(spark, sf), d.MULTI), "macro_f1")


@query(
    "metrics_multiclass_all",
    "WITH " + MULTI_FOLDS_SQL + """
SELECT contender_key, split, fold, round(macro_f1, 6) AS macro_f1, round(acc, 6) AS accuracy,
       round(bal, 6) AS balanced_accuracy, round(ll, 6) AS log_loss
FROM macro JOIN plain USING (contender_key, split, fold)""",
)
def metrics_multiclass_all(spark, sf):
    keys = fixed.METRICS_BY_TASK["multiclass"]
    folds = mt.fold_metrics(d.multiclass_predictions(spark, sf), d.MULTI)
    return folds.groupBy("contender_key", "split", "fold").agg(
        *[F.max(F.when(F.col("metric") == k, F.col("value"))).alias(k) for k in keys]
    )


# one contender's probabilities are scaled so that its whole part must be refused
@query(
    "metric_probability_gate",
    "WITH " + d.BINARY_SQL + """,
bent AS (
  SELECT contender_key, split, fold, y_true,
         CASE WHEN contender_key = 'fair' AND fold = 2 THEN CAST(CAST(p_no AS FLOAT) * CAST(0.5 AS FLOAT) AS DOUBLE) ELSE p_no END AS p_no,
         CASE WHEN contender_key = 'fair' AND fold = 2 THEN CAST(CAST(p_yes AS FLOAT) * CAST(0.5 AS FLOAT) AS DOUBLE) ELSE p_yes END AS p_yes
  FROM bin WHERE split = 'cv')
SELECT contender_key, fold,
       CASE WHEN count(p_yes) < count(*) THEN 'no_probabilities'
            WHEN max(abs(p_no + p_yes - 1)) > 1e-3 THEN 'probabilities_do_not_sum_to_one' ELSE '' END AS note,
       CASE WHEN count(p_yes) = count(*) AND max(abs(p_no + p_yes - 1)) <= 1e-3
            THEN round(avg(power(p_yes / (p_no + p_yes) - CASE WHEN y_true = 'yes' THEN 1e0 ELSE 0e0 END, 2)), 6) END AS value
FROM bent GROUP BY contender_key, fold""",
)
def metric_probability_gate(spark, sf):
    p = pr.of_split(d.binary_predictions(spark, sf), fixed.SPLIT_CV)
    bent = (F.col("contender_key") == "fair") & (F.col("fold") == 2)
    half = F.transform("proba", lambda x: (x * F.lit(0.5).cast("float")).cast("float"))
    p = p.withColumn("proba", F.when(bent, half).otherwise(F.col("proba")))
    return _metric(mt.fold_metrics(p, d.BINARY), "brier").select("contender_key", "fold", "note", "value")


REG_FOLDS_SQL = d.REGRESSION_SQL + """,
reg_wide AS (
  SELECT contender_key, split, fold,
         sqrt(avg(power(y_pred - y_true, 2))) AS rmse, avg(abs(y_pred - y_true)) AS mae,
         1 - sum(power(y_pred - y_true, 2)) / (count(*) * var_pop(y_true)) AS r2,
         avg(abs((y_pred - y_true) / y_true)) AS mape
  FROM reg GROUP BY ALL)"""


@query(
    "metric_rmse_mae",
    "WITH " + REG_FOLDS_SQL + " SELECT contender_key, split, fold, round(rmse, 3) AS rmse, round(mae, 3) AS mae FROM reg_wide",
)
def metric_rmse_mae(spark, sf):
    folds = mt.fold_metrics(d.regression_predictions(spark, sf), d.REGRESSION)
    return folds.groupBy("contender_key", "split", "fold").agg(
        *[F.round(F.max(F.when(F.col("metric") == k, F.col("value"))), 3).alias(k) for k in ("rmse", "mae")]
    )


@query("metric_r2", "WITH " + REG_FOLDS_SQL + " SELECT contender_key, split, fold, round(r2, 6) AS value, '' AS note FROM reg_wide")
def metric_r2(spark, sf):
    return _metric(mt.fold_metrics(d.regression_predictions(spark, sf), d.REGRESSION), "r2")


# the target is shifted so that some rows are exactly zero: the whole fold has no relative error
@query(
    "metric_mape",
    "WITH " + d.REGRESSION_SQL + """
SELECT contender_key, split, fold,
       CASE WHEN sum(CASE WHEN t = 0 THEN 1 ELSE 0 END) = 0 THEN round(avg(abs((y_pred - t) / nullif(t, 0))), 6) END AS value,
       CASE WHEN sum(CASE WHEN t = 0 THEN 1 ELSE 0 END) = 0 THEN ''
            ELSE 'zero_target_rows:' || CAST(sum(CASE WHEN t = 0 THEN 1 ELSE 0 END) AS BIGINT) END AS note
FROM (SELECT *, CASE WHEN fold = 1 AND row_id % 50 = 3 THEN 0e0 ELSE y_true END AS t FROM reg) GROUP BY ALL""",
)
def metric_mape(spark, sf):
    p = d.regression_predictions(spark, sf)
    zero = (F.col("fold") == 1) & (F.col("row_id") % 50 == 3)
    p = p.withColumn("y_true", F.when(zero, 0.0).otherwise(F.col("y_true")))
    return _metric(mt.fold_metrics(p, d.REGRESSION), "mape")


@query(
    "metrics_cross_validated",
    "WITH " + BIN_FOLDS_SQL + CV_SQL + " SELECT * FROM cv",
)
def metrics_cross_validated(spark, sf):
    return mt.cross_validated(_binary_folds(spark, sf)).select(
        "contender_key", "metric", "value", "std", "folds_measured", "folds_total"
    )


@query(
    "metric_registry_primary",
    "WITH " + BIN_FOLDS_SQL + CV_SQL + """
SELECT contender_key, metric, 'higher' AS direction, value FROM cv WHERE metric = 'roc_auc'""",
)
def metric_registry_primary(spark, sf):
    cv = mt.cross_validated(_binary_folds(spark, sf))
    primary = mt.registry(spark).filter("task_type = 'binary' and is_primary").select("metric", "direction")
    return cv.join(F.broadcast(primary), "metric").select("contender_key", "metric", "direction", "value")


# --- comparison, leaderboard, champion ----------------------------------------------------------

OBJECTIVE = Objective.default("binary")
CONSTRAINED = Objective("roc_auc", "binary", (Constraint("recall", "gte", 0.6), Constraint("log_loss", "lte", 0.65)))


def _facts(spark, sf):
    p = d.binary_predictions(spark, sf)
    return mt.fold_metrics(p, d.BINARY), d.contender_facts(spark, p)


FOLD_PAIRS_SQL = """,
auc AS (SELECT contender_key, fold, value FROM folds WHERE metric = 'roc_auc' AND split = 'cv' AND value IS NOT NULL),
pairs AS (
  SELECT a.contender_key AS leader, b.contender_key AS follower, avg(a.value - b.value) AS mean,
         stddev_pop(a.value - b.value) AS spread, count(*) AS folds_compared,
         sum(CASE WHEN a.value - b.value > 0 THEN 1 ELSE 0 END) AS folds_won
  FROM auc a JOIN auc b ON a.fold = b.fold AND a.contender_key <> b.contender_key GROUP BY ALL),
judged AS (
  SELECT leader, follower, round(mean, 6) AS mean_difference, round(spread, 6) AS std_difference, folds_compared,
         CAST(folds_won AS BIGINT) AS folds_won,
         (folds_won = 0 OR folds_won = folds_compared) AND abs(mean) > spread AS stable
  FROM pairs)"""


@query(
    "compare_paired_folds",
    "WITH " + BIN_FOLDS_SQL + FOLD_PAIRS_SQL + " SELECT * FROM judged",
)
def compare_paired_folds(spark, sf):
    folds, contenders = _facts(spark, sf)
    a = contenders.select("run_id", F.col("contender_key").alias("leader"))
    b = contenders.select("run_id", F.col("contender_key").alias("follower"))
    pairs = a.join(b, "run_id").filter("leader <> follower")
    return lb.compare_pairs(folds, pairs, OBJECTIVE).drop("run_id")


BOARD_SQL = """,
facts AS (
  SELECT contender_key, contender_key = 'baseline' AS is_baseline, length(contender_key) * 1e0 AS cost
  FROM (SELECT DISTINCT contender_key FROM bin)),
scored AS (
  SELECT f.*, c.value AS score, c.std, c.value IS NOT NULL AS eligible
  FROM facts f LEFT JOIN cv c ON c.contender_key = f.contender_key AND c.metric = 'roc_auc'),
board AS (
  SELECT *, CASE WHEN eligible THEN CAST(row_number() OVER w AS INTEGER) END AS rank,
         CASE WHEN eligible THEN lead(contender_key) OVER w END AS next_key
  FROM scored WINDOW w AS (PARTITION BY eligible ORDER BY score DESC, std ASC NULLS LAST, cost, contender_key)),
full_board AS (
  SELECT b.contender_key, b.rank, b.score, b.std, b.eligible, b.next_key,
         n.mean_difference AS next_mean_difference, n.stable AS next_stable,
         z.mean_difference AS baseline_mean_difference, z.folds_won AS baseline_folds_won, z.stable AS baseline_stable
  FROM board b LEFT JOIN judged n ON n.leader = b.contender_key AND n.follower = b.next_key
               LEFT JOIN judged z ON z.leader = b.contender_key AND z.follower = 'baseline')"""
BOARD_COLUMNS = (
    "contender_key", "rank", "score", "std", "eligible", "next_key", "next_mean_difference", "next_stable",
    "baseline_mean_difference", "baseline_folds_won", "baseline_stable",
)


@query(
    "leaderboard_binary",
    "WITH " + BIN_FOLDS_SQL + CV_SQL + FOLD_PAIRS_SQL + BOARD_SQL + " SELECT * FROM full_board",
)
def leaderboard_binary(spark, sf):
    folds, contenders = _facts(spark, sf)
    return lb.leaderboard(folds, contenders, OBJECTIVE).select(*BOARD_COLUMNS)


@query(
    "leaderboard_rank_and_next",
    "WITH " + BIN_FOLDS_SQL + CV_SQL + FOLD_PAIRS_SQL + BOARD_SQL + """
SELECT contender_key, rank, next_key,
       CASE WHEN next_key IS NULL THEN NULL
            WHEN score <> (SELECT score FROM board x WHERE x.contender_key = board.next_key) THEN 'score'
            ELSE 'stability' END AS decided_by
FROM board WHERE rank IS NOT NULL""",
)
def leaderboard_rank_and_next(spark, sf):
    folds, contenders = _facts(spark, sf)
    board = lb.ranked(lb.contender_scores(folds, contenders, OBJECTIVE), OBJECTIVE)
    return board.filter("rank is not null").select("contender_key", "rank", "next_key", "decided_by")


@query(
    "leaderboard_constraints",
    "WITH " + BIN_FOLDS_SQL + CV_SQL + """
SELECT contender_key, score,
       CASE WHEN score IS NULL THEN 'metric_not_measured'
            WHEN coalesce(recall < 6e-1, false) OR coalesce(ll > 65e-2, false) THEN 'constraint_failed'
            WHEN recall IS NULL OR ll IS NULL THEN 'constraint_not_checked' ELSE '' END AS reason
FROM (SELECT contender_key, max(CASE WHEN metric = 'roc_auc' THEN value END) AS score,
             max(CASE WHEN metric = 'recall' THEN value END) AS recall,
             max(CASE WHEN metric = 'log_loss' THEN value END) AS ll FROM cv GROUP BY contender_key)""",
)
def leaderboard_constraints(spark, sf):
    folds, contenders = _facts(spark, sf)
    return lb.contender_scores(folds, contenders, CONSTRAINED).select("contender_key", "score", "reason")


# accuracy is measured for the contender without probabilities, the log-loss constraint is not
@query(
    "leaderboard_unchecked_constraint",
    "WITH " + BIN_FOLDS_SQL + CV_SQL + """
SELECT contender_key, score,
       CASE WHEN coalesce(ll > 7e-1, false) THEN 'constraint_failed'
            WHEN ll IS NULL THEN 'constraint_not_checked' ELSE '' END AS reason
FROM (SELECT contender_key, max(CASE WHEN metric = 'accuracy' THEN value END) AS score,
             max(CASE WHEN metric = 'log_loss' THEN value END) AS ll FROM cv GROUP BY contender_key)""",
)
def leaderboard_unchecked_constraint(spark, sf):
    folds, contenders = _facts(spark, sf)
    objective = Objective("accuracy", "binary", (Constraint("log_loss", "lte", 0.7),))
    return lb.contender_scores(folds, contenders, objective).select("contender_key", "score", "reason")


@query(
    "leaderboard_contender_facts",
    "WITH " + BIN_FOLDS_SQL + CV_SQL + """,
facts AS (SELECT contender_key, count(*) AS n FROM bin GROUP BY contender_key)
SELECT contender_key, contender_key = 'baseline' AS is_baseline, 'SUCCEEDED' AS state,
       length(contender_key) * 1e0 AS cost, value AS score
FROM facts LEFT JOIN cv USING (contender_key) WHERE metric = 'roc_auc' OR metric IS NULL""",
)
def leaderboard_contender_facts(spark, sf):
    folds, contenders = _facts(spark, sf)
    return lb.contender_scores(folds, contenders, OBJECTIVE).select(
        "contender_key", "is_baseline", "state", "cost", "score"
    )


@query(
    "champion_verdict",
    "WITH " + BIN_FOLDS_SQL + CV_SQL + FOLD_PAIRS_SQL + BOARD_SQL + """
SELECT CASE WHEN contender_key = 'baseline' THEN 'baseline_leads'
            WHEN baseline_mean_difference IS NULL THEN 'no_common_fold'
            WHEN NOT baseline_stable THEN 'unstable_over_baseline' ELSE 'champion' END AS verdict,
       contender_key AS leader,
       CASE WHEN contender_key <> 'baseline' AND baseline_stable THEN contender_key END AS champion,
       baseline_mean_difference AS gain_over_baseline, next_key AS runner_up
FROM full_board WHERE rank = 1""",
)
def champion_verdict(spark, sf):
    folds, contenders = _facts(spark, sf)
    board = lb.leaderboard(folds, contenders, OBJECTIVE)
    return lb.champion(board, OBJECTIVE).select("verdict", "leader", "champion", "gain_over_baseline", "runner_up")


@query(
    "leaderboard_regression",
    "WITH " + REG_FOLDS_SQL + """
SELECT contender_key, round(avg(rmse), 3) AS score, CAST(row_number() OVER (ORDER BY avg(rmse)) AS INTEGER) AS rank
FROM reg_wide WHERE split = 'cv' GROUP BY contender_key""",
)
def leaderboard_regression(spark, sf):
    p = d.regression_predictions(spark, sf)
    folds = mt.fold_metrics(p, d.REGRESSION)
    board = lb.leaderboard(folds, d.contender_facts(spark, p), Objective.default("regression"))
    return board.select("contender_key", F.round("score", 3).alias("score"), "rank")


@query(
    "roc_curve_points",
    "WITH " + ROC_SQL + """
SELECT contender_key, fold, round(score, 6) AS score, CAST(cpos AS BIGINT) AS true_positives,
       CAST(cneg AS BIGINT) AS false_positives FROM curve WHERE split = 'holdout'""",
)
def roc_curve_points(spark, sf):
    p = pr.of_split(d.binary_predictions(spark, sf), fixed.SPLIT_HOLDOUT)
    rows = mt.with_mass(p, 2).filter("proba is not null")
    scores = rows.select("contender_key", "fold", mt.share_of(F.lit(1)).alias("score"), (F.col("y_true") == "yes").alias("hit"))
    return mt.curve_points(scores, ["contender_key", "fold"]).select(
        "contender_key", "fold", F.round("score", 6).alias("score"),
        F.col("cpos").alias("true_positives"), F.col("cneg").alias("false_positives"),
    )


@query(
    "split_filters",
    "WITH " + d.BINARY_SQL + " SELECT split, count(*) AS n_rows, count(DISTINCT fold) AS folds FROM bin_every GROUP BY split",
)
def split_filters(spark, sf):
    p = d.binary_predictions(spark, sf, probes=True)
    parts = [pr.of_split(p, s) for s in (fixed.SPLIT_CV, fixed.SPLIT_HOLDOUT, fixed.SPLIT_PROBE)]
    united = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return united.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("fold").alias("folds"))
