"""Eligibility, ranking, paired comparison and the champion verdict.

Ranking uses cross-validation only.  Inputs here have contenders x folds x metrics rows, so all of it
is small; it is still partitioned by run so that many runs are ranked by one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairfold import fixed
from fairfold.operators.metrics import cross_validated
from fairfold.spec import Objective

# verdict codes
NONE_ELIGIBLE = "none_eligible"
BASELINE_LEADS = "baseline_leads"
BASELINE_UNMEASURED = "baseline_unmeasured"
NO_COMMON_FOLD = "no_common_fold"
UNSTABLE = "unstable_over_baseline"
BELOW_GAIN = "below_minimal_gain"
CHAMPION = "champion"


def constraint_ok(value: Column, operator: str, threshold: float) -> Column:
    """Three-valued: NULL means the constraint could not be checked."""
    return value >= F.lit(threshold) if operator == "gte" else value <= F.lit(threshold)


def contender_scores(folds: DataFrame, contenders: DataFrame, objective: Objective) -> DataFrame:
    """One row per contender: score, std, eligibility and the reason for exclusion.

    ``contenders``: run_id, contender_key, is_baseline, state, cost.
    """
    cv = cross_validated(folds)
    target = F.col("metric") == objective.metric
    picks = [
        F.max(F.when(target, F.col("value"))).alias("score"),
        F.max(F.when(target, F.col("std"))).alias("std"),
        F.max(F.when(target, F.col("per_fold"))).alias("per_fold"),
        F.count(F.lit(1)).alias("measured"),
    ] + [
        F.max(F.when(F.col("metric") == c.metric, F.col("value"))).alias(f"observed_{i}")
        for i, c in enumerate(objective.constraints)
    ]
    scored = contenders.join(
        cv.groupBy("run_id", "contender_key").agg(*picks), ["run_id", "contender_key"], "left"
    )
    oks = [
        constraint_ok(F.col(f"observed_{i}"), c.operator, c.value)
        for i, c in enumerate(objective.constraints)
    ]
    failed = unknown = F.lit(False)
    for ok in oks:
        failed = failed | F.coalesce(~ok, F.lit(False))
        unknown = unknown | ok.isNull()
    reason = (
        F.when(F.col("state") != "SUCCEEDED", F.concat(F.lit("state:"), F.col("state")))
        .when(F.col("measured").isNull(), "no_out_of_fold_predictions")
        .when(F.col("score").isNull(), "metric_not_measured")
        .when(failed, "constraint_failed")
        .when(unknown, "constraint_not_checked")
        .otherwise("")
    )
    ran = F.col("state") == "SUCCEEDED"
    return scored.select(
        "run_id", "contender_key", "is_baseline", "state", "cost",
        F.when(ran, F.col("score")).alias("score"),
        F.when(ran, F.col("std")).alias("std"),
        F.when(ran, F.col("per_fold")).alias("per_fold"),
        (reason == "").alias("eligible"), reason.alias("reason"),
    )


def _rank_order(objective: Objective) -> list[Column]:
    order = [F.desc("score") if objective.higher_is_better else F.asc("score")]
    for rule in objective.tie_breakers:
        order.append({"stability": F.asc_nulls_last("std"), "cost": F.asc("cost"), "key": F.asc("contender_key")}[rule])
    return order


def ranked(scores: DataFrame, objective: Objective) -> DataFrame:
    """Adds ``rank`` (NULL when not eligible), ``next_key`` and the rule that decided the pair."""
    window = Window.partitionBy("run_id", "eligible").orderBy(*_rank_order(objective))
    decided = F.when(F.lead("score").over(window) != F.col("score"), "score")
    for rule in objective.tie_breakers:
        if rule == "key":
            decided = decided.when(F.lead("contender_key").over(window).isNotNull(), "key")
        else:
            column = "std" if rule == "stability" else "cost"
            differs = ~F.lead(column).over(window).eqNullSafe(F.col(column))
            decided = decided.when(F.lead("contender_key").over(window).isNotNull() & differs, rule)
    eligible = F.col("eligible")
    return (
        scores.withColumn("__rank", F.row_number().over(window).cast("int"))
        .withColumn("__next", F.lead("contender_key").over(window))
        .withColumn("__rule", decided)
        .withColumn("rank", F.when(eligible, F.col("__rank")))
        .withColumn("next_key", F.when(eligible, F.col("__next")))
        .withColumn("decided_by", F.when(eligible, F.col("__rule")))
        .drop("__rank", "__next", "__rule")
    )


def paired(leader: Column, follower: Column, objective: Objective) -> Column:
    """Compare two ``array<struct<fold,value>>`` on the folds both were measured on.

    A struct of mean and population std of the difference, folds compared and won, and whether the
    sign holds on every fold and the mean exceeds the spread.  NULL when there is no common fold:
    that is not a tie.  Arrays have one entry per fold, so this needs no join.
    """
    sign = F.lit(1.0 if objective.higher_is_better else -1.0)
    lookup = F.map_from_entries(follower)
    differences = F.filter(
        F.transform(leader, lambda x: (x["value"] - F.try_element_at(lookup, x["fold"])) * sign),
        lambda d: d.isNotNull(),
    )
    n = F.size(differences)
    mean = F.aggregate(differences, F.lit(0.0), lambda a, d: a + d) / n
    spread = F.sqrt(F.aggregate(differences, F.lit(0.0), lambda a, d: a + (d - mean) * (d - mean)) / n)
    won = F.size(F.filter(differences, lambda d: d > 0))
    stable = ((won == 0) | (won == n)) & (F.abs(mean) > fixed.STABILITY_RATIO * spread)
    return F.when(
        n > 0,
        F.struct(
            F.round(mean, 6).alias("mean_difference"),
            F.round(spread, 6).alias("std_difference"),
            n.cast("long").alias("folds_compared"),
            won.cast("long").alias("folds_won"),
            stable.alias("stable"),
        ),
    )


def compare_pairs(folds: DataFrame, pairs: DataFrame, objective: Objective) -> DataFrame:
    """Paired comparison of every (run_id, leader, follower); a pair without common folds has no row."""
    values = cross_validated(folds.filter(F.col("metric") == objective.metric))
    a = values.select("run_id", F.col("contender_key").alias("leader"), F.col("per_fold").alias("a"))
    b = values.select("run_id", F.col("contender_key").alias("follower"), F.col("per_fold").alias("b"))
    return (
        pairs.join(a, ["run_id", "leader"])
        .join(b, ["run_id", "follower"])
        .select("run_id", "leader", "follower", paired(F.col("a"), F.col("b"), objective).alias("c"))
        .filter("c is not null")
        .select("run_id", "leader", "follower", "c.*")
    )


def leaderboard(folds: DataFrame, contenders: DataFrame, objective: Objective) -> DataFrame:
    """Every contender with its rank or the reason for having none, and both paired comparisons.

    One pass over the fold metrics: the next row and the baseline are reached by window functions
    over the contenders of a run, not by joining the metrics with themselves.
    """
    board = ranked(contender_scores(folds, contenders, objective), objective)
    by_rank = Window.partitionBy("run_id", "eligible").orderBy(*_rank_order(objective))
    run = Window.partitionBy("run_id")
    baseline_folds = F.max(F.when(F.col("is_baseline"), F.col("per_fold"))).over(run)
    has_rank = F.col("rank").isNotNull()
    board = board.withColumn("__next", F.lead("per_fold").over(by_rank)).withColumn("__base", baseline_folds)
    board = board.withColumn(
        "next", F.when(F.col("next_key").isNotNull(), paired(F.col("per_fold"), F.col("__next"), objective))
    ).withColumn(
        "versus",
        F.when(has_rank & ~F.col("is_baseline"), paired(F.col("per_fold"), F.col("__base"), objective)),
    )
    fields = ("mean_difference", "std_difference", "folds_compared", "folds_won", "stable")
    return board.select(
        "run_id", "contender_key", "is_baseline", "state", "cost", "rank", "score", "std", "eligible",
        "reason", "next_key", "decided_by",
        *[F.col(f"next.{c}").alias(f"next_{c}") for c in fields],
        *[F.col(f"versus.{c}").alias(f"baseline_{c}") for c in fields],
    )


def champion(board: DataFrame, objective: Objective) -> DataFrame:
    """One verdict row per run from :func:`leaderboard` rows."""
    first = F.col("rank") == 1
    fields = (
        "contender_key", "is_baseline", "next_key", "next_stable", "decided_by", "baseline_stable",
        "baseline_mean_difference", "baseline_folds_compared",
    )
    lead = board.groupBy("run_id").agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in fields],
        F.max(F.when(F.col("is_baseline"), F.col("score"))).alias("baseline_score"),
    )
    verdict = (
        F.when(F.col("contender_key").isNull(), NONE_ELIGIBLE)
        .when(F.col("is_baseline"), BASELINE_LEADS)
        .when(F.col("baseline_score").isNull(), BASELINE_UNMEASURED)
        .when(F.col("baseline_folds_compared").isNull(), NO_COMMON_FOLD)
        .when(~F.col("baseline_stable"), UNSTABLE)
        .when(F.col("baseline_mean_difference") < objective.min_gain, BELOW_GAIN)
        .otherwise(CHAMPION)
    )
    won = F.col("verdict") == CHAMPION
    return lead.withColumn("verdict", verdict).select(
        "run_id", "verdict",
        F.col("contender_key").alias("leader"),
        F.when(won, F.col("contender_key")).alias("champion"),
        F.col("baseline_mean_difference").alias("gain_over_baseline"),
        F.col("next_key").alias("runner_up"),
        F.when(won & ~F.col("next_stable"), F.col("decided_by")).alias("decided_by_tie_rule"),
    )
