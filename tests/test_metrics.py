import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairfold.operators import leaderboard as lb
from fairfold.operators import metrics as mt
from fairfold.operators import predictions as pr
from fairfold.operators.gram import strong_correlations
from fairfold.spec import Constraint, Objective, Protocol, RefusedError, TaskSpec
from tests.tables import accuracy_folds, facts

BINARY = TaskSpec("y", "binary", ("x",), ("no", "yes"), "yes")
NUMBER = TaskSpec("y", "regression", ("x",))


def values(folds, **where):
    for k, v in where.items():
        folds = folds.filter(F.col(k) == v)
    return {r["metric"]: (r["value"], r["note"]) for r in folds.collect()}


def test_perfect_predictions(spark):
    p = accuracy_folds(spark, "m", [1.0, 1.0])
    got = values(mt.fold_metrics(p, BINARY), fold=0)
    assert got["roc_auc"] == (1.0, "") and got["f1"] == (1.0, "")
    assert got["log_loss"][0] == pytest.approx(-math.log(0.9), abs=1e-6)


def test_single_class_gives_null_with_reason(spark):
    p = accuracy_folds(spark, "m", [1.0]).filter("y_true = 'no'")
    got = values(mt.fold_metrics(p, BINARY))
    assert got["roc_auc"] == (None, mt.ONE_CLASS)
    assert got["log_loss"] == (None, mt.CLASSES_UNOBSERVED)
    assert got["accuracy"] == (1.0, "")


def test_lost_probability_mass_is_refused_not_renormalised(spark):
    p = accuracy_folds(spark, "m", [0.5]).withColumn("proba", F.array(F.lit(0.3).cast("float"), F.lit(0.3).cast("float")))
    got = values(mt.fold_metrics(p, BINARY))
    assert got["log_loss"] == (None, mt.MASS_OFF) and got["roc_auc"] == (None, mt.MASS_OFF)


def test_zero_target_has_no_relative_error(spark):
    p = spark.createDataFrame(
        [("run", "m", i, "cv", 0, float(i), 0.5 if i == 0 else float(i)) for i in range(6)],
        "run_id string, contender_key string, row_id long, split string, fold int, y_true double, y_pred double",
    )
    got = values(mt.fold_metrics(p, NUMBER))
    assert got["mape"] == (None, "zero_target_rows:1") and got["rmse"][0] == pytest.approx(math.sqrt(0.25 / 6), abs=1e-6)


def test_constant_target_has_no_r2(spark):
    p = spark.createDataFrame(
        [("run", "m", i, "cv", 0, 3.0, 2.0) for i in range(5)],
        "run_id string, contender_key string, row_id long, split string, fold int, y_true double, y_pred double",
    )
    assert values(mt.fold_metrics(p, NUMBER))["r2"] == (None, mt.CONSTANT_TARGET)


def test_ranking_areas_match_brute_force_with_ties_and_extreme_scores(spark):
    scores = [0.0, 1e-30, 1e-30, 1e-9, 0.25, 0.25, 0.25, 0.5, 0.5, 0.75, 0.999, 1.0, 1.0]
    hits = [0, 1, 0, 0, 1, 0, 0, 1, 1, 0, 1, 1, 0]
    df = spark.createDataFrame([("k", s, bool(h)) for s, h in zip(scores, hits, strict=True)], "g string, score double, hit boolean")
    row = mt.ranking_areas(df, ["g"]).first()
    pos = [s for s, h in zip(scores, hits, strict=True) if h]
    neg = [s for s, h in zip(scores, hits, strict=True) if not h]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert row["roc_area"] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)
    ap, seen = 0.0, 0
    for t in sorted(set(scores), reverse=True):
        at = sum(1 for s in pos if s == t)
        tp, named = sum(s >= t for s in pos), sum(s >= t for s in scores)
        ap += at / len(pos) * tp / named
        seen += at
    assert seen == len(pos) and row["pr_area"] == pytest.approx(ap, abs=1e-12)


def test_cross_validation_skips_null_folds_and_says_so(spark):
    p = accuracy_folds(spark, "m", [1.0, 0.5])
    p = p.filter("fold = 0 or y_true = 'no'")
    cv = {r["metric"]: r for r in mt.cross_validated(mt.fold_metrics(p, BINARY)).collect()}
    assert cv["roc_auc"]["folds_measured"] == 1 and cv["roc_auc"]["std"] is None
    assert cv["roc_auc"]["note"].startswith(mt.PARTIAL)
    assert cv["accuracy"]["folds_measured"] == 2 and cv["accuracy"]["note"] == ""


def board(spark, contenders, objective, baseline="base", states=None, costs=None):
    p = None
    for key, accuracies in contenders.items():
        one = accuracy_folds(spark, key, accuracies)
        p = one if p is None else p.unionByName(one)
    rows = [(k, k == baseline, (states or {}).get(k, "SUCCEEDED"), float((costs or {}).get(k, 1))) for k in contenders]
    return lb.leaderboard(mt.fold_metrics(p, BINARY), facts(spark, rows), objective)


ACC = Objective("accuracy", "binary")


def verdict(table, objective=ACC):
    return lb.champion(table, objective).first()


def test_champion_beats_baseline_on_every_fold(spark):
    v = verdict(board(spark, {"base": [0.5, 0.6, 0.5], "good": [0.8, 0.9, 0.8], "fair": [0.6, 0.7, 0.6]}, ACC))
    assert (v["verdict"], v["champion"], v["runner_up"]) == (lb.CHAMPION, "good", "fair")
    assert v["decided_by_tie_rule"] is None


def test_baseline_on_top_means_no_champion(spark):
    assert verdict(board(spark, {"base": [0.9, 0.9], "good": [0.6, 0.7]}, ACC))["verdict"] == lb.BASELINE_LEADS


def test_unstable_lead_is_not_a_victory(spark):
    v = verdict(board(spark, {"base": [0.5, 0.7, 0.5], "good": [0.9, 0.6, 0.6]}, ACC))
    assert v["verdict"] == lb.UNSTABLE and v["champion"] is None


def test_minimal_gain(spark):
    objective = Objective("accuracy", "binary", min_gain=0.2)
    assert verdict(board(spark, {"base": [0.5, 0.5], "good": [0.6, 0.6]}, objective), objective)["verdict"] == lb.BELOW_GAIN


def test_missing_baseline_and_nobody_eligible(spark):
    assert verdict(board(spark, {"good": [0.6, 0.6]}, ACC))["verdict"] == lb.BASELINE_UNMEASURED
    failed = board(spark, {"base": [0.5], "good": [0.6]}, ACC, states={"base": "FAILED", "good": "FAILED"})
    assert verdict(failed)["verdict"] == lb.NONE_ELIGIBLE


def test_ties_go_by_stability_then_cost_then_key(spark):
    rows = {r["contender_key"]: r for r in board(
        spark, {"base": [0.5, 0.5], "b": [0.8, 0.8], "a": [0.8, 0.8], "c": [0.7, 0.9]}, ACC, costs={"a": 2, "b": 2, "c": 1}).collect()}
    assert [rows[k]["rank"] for k in ("a", "b", "c", "base")] == [1, 2, 3, 4]
    assert rows["a"]["decided_by"] == "key" and rows["b"]["decided_by"] == "stability"


def test_unchecked_constraint_disqualifies(spark):
    objective = Objective("accuracy", "binary", (Constraint("log_loss", "lte", 0.5),))
    p = accuracy_folds(spark, "m", [0.9, 0.9]).withColumn("proba", F.lit(None).cast("array<float>"))
    row = lb.contender_scores(mt.fold_metrics(p, BINARY), facts(spark, [("m", False, "SUCCEEDED", 1.0)]), objective).first()
    assert (row["eligible"], row["reason"]) == (False, "constraint_not_checked")


def test_paired_comparison_vectors(spark):
    hard = [0.90, 0.60, 0.75, 0.55, 0.85]

    def compare(a, b, objective=ACC):
        rows = [("run", k, "cv", f, objective.metric, v, "", 1) for k, vs in (("a", a), ("b", b)) for f, v in enumerate(vs)]
        folds = spark.createDataFrame(rows, "run_id string, contender_key string, split string, fold int, metric string, value double, note string, n_rows long")
        pairs = spark.createDataFrame([("run", "a", "b")], "run_id string, leader string, follower string")
        return lb.compare_pairs(folds, pairs, objective).first()

    better = compare([v + 0.05 for v in hard], hard)
    assert better["stable"] and better["folds_won"] == 5 and better["mean_difference"] == pytest.approx(0.05)
    assert not compare([v + (0.05 if f else -0.05) for f, v in enumerate(hard)], hard)["stable"]
    lower = compare([0.1, 0.2], [0.3, 0.4], Objective("log_loss", "binary"))
    assert lower["mean_difference"] == pytest.approx(0.2) and lower["folds_won"] == 2
    assert compare([None, 0.5], [0.5, None]) is None


def test_objective_refuses_foreign_metrics():
    with pytest.raises(RefusedError):
        Objective("rmse", "binary")
    with pytest.raises(RefusedError):
        Objective("roc_auc", "binary", (Constraint("r2", "gte", 0.1),))


def coverage(spark, pairs, pool, protocol):
    p = spark.createDataFrame([("run", "m", r, "cv", f) for r, f in pairs], "run_id string, contender_key string, row_id long, split string, fold int")
    ids = spark.createDataFrame([(r,) for r in pool], "row_id long")
    return pr.oof_coverage(p, ids, protocol).first()["verdict"]


def test_out_of_fold_coverage(spark):
    kfold, forward = Protocol("k_fold"), Protocol("forward_chaining", holdout="temporal")
    assert coverage(spark, [(1, 0), (2, 1)], [1, 2], kfold) == "complete"
    assert coverage(spark, [(1, 0), (1, 1), (2, 1)], [1, 2], kfold) == "duplicated"
    assert coverage(spark, [(1, 0), (9, 1)], [1, 2], kfold) == "stray"
    assert coverage(spark, [(1, 0)], [1, 2], kfold) == "incomplete"
    assert coverage(spark, [(2, 0)], [1, 2], forward) == "first_period_only_trains"


def test_alignment_fills_unseen_and_refuses_unknown_classes(spark):
    df = spark.createDataFrame([([0.7, 0.3],)], "p array<double>")
    aligned = df.select(pr.align_probabilities(F.col("p"), ["c", "a"], ("a", "b", "c")).alias("x")).first()["x"]
    assert aligned == pytest.approx([0.3, 0.0, 0.7])
    assert pr.unseen_classes(["c", "a"], ("a", "b", "c")) == ["b"]
    with pytest.raises(RefusedError):
        pr.align_probabilities(F.col("p"), ["z", "a"], ("a", "b", "c"))


def test_every_part_is_counted(spark):
    p = spark.createDataFrame([("r", "m", "holdout", -1, 1), ("r", "m", "cv", 0, 2), ("r", "m", "cv", 0, 2), ("r", "m", "cv", 1, 3), ("r", "m", "cv", 1, 9)],
                              "run_id string, contender_key string, split string, fold int, row_id long")
    want = spark.createDataFrame([("holdout", -1, 1), ("holdout", -1, 4), ("cv", 0, 2), ("cv", 1, 3), ("train_probe", 0, 3)], "split string, fold int, row_id long")
    got = {(r["split"], r["fold"]): (r["expected_rows"], r["covered_rows"], r["verdict"]) for r in pr.part_coverage(p, want).collect()}
    assert got == {("holdout", -1): (2, 1, "incomplete"), ("cv", 0): (1, 1, "duplicated"), ("cv", 1): (1, 1, "stray"), ("train_probe", 0): (1, 0, "incomplete")}
    assert {r["verdict"] for r in pr.part_coverage(p, want.limit(0)).collect()} == {"stray", "duplicated"}


def test_correlations_in_one_pass(spark):
    """Against all pairs: gaps, a constant, large offsets, values that are not finite, more columns than a block."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(500, 3))
    x = np.concatenate([base @ rng.normal(size=(3, 20)) + 0.3 * rng.normal(size=(500, 20)), 1e9 + base, np.full((500, 1), 7.1)], axis=1)
    names = [f"k{i}" for i in range(x.shape[1])] + ["bad one"]
    rows = [[None if rng.random() < 0.1 and j < 20 else float(v) for j, v in enumerate(r)] + [float("nan") if i == 50 else float(r[0])] for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(5)
    got = {(r["first"], r["second"]): r["correlation"] for r in strong_correlations(df, names, 0.8).collect()}
    r = pd.DataFrame([row[:-1] for row in rows], columns=names[:-1], dtype=float).corr()  # over rows where both are known
    want = {(a, b): r.loc[a, b] for i, a in enumerate(names[:-1]) for b in names[i + 1 : -1] if abs(r.loc[a, b]) >= 0.8 and "k23" not in (a, b)}
    # the value that is no number is in row 50: only a column with a gap there goes with it
    assert all(rows[50][names.index(a)] is None for a, b in got if b == "bad one")
    got = {p: v for p, v in got.items() if p[1] != "bad one"}
    assert len(want) > 30 and got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=2e-4) for p in want)
    plan = strong_correlations(df, names, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 2 and strong_correlations(df.limit(0), names, 0.8).count() == 0
