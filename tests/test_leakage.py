import pytest
from pyspark.sql import functions as F

from fairfold.operators import folds as fd
from fairfold.operators import leakage as lk
from fairfold.operators import readiness as rd
from fairfold.spec import Protocol, TaskSpec
from tests.tables import honest, numbered, pick

i = F.col("row_id")
KFOLD = Protocol("stratified_k_fold", 5, "stratified")
PLAIN = Protocol("k_fold", 5)


def churn(features, **more):
    return TaskSpec("churned", "binary", tuple(features), ("False", "True"), "True", **more)


def report(df, spec, protocol=KFOLD):
    keep = tuple(dict.fromkeys([*spec.features, spec.target, *(c for c in (spec.group, spec.time) if c)]))
    found = lk.inspect(fd.assign(df, spec, protocol, keep=keep), spec, protocol)
    signals = {r["code"]: r for r in found.collect() if r["evaluated"]}
    skipped = {(r["code"], r["scope"]) for r in found.collect() if not r["evaluated"]}
    return signals, skipped, lk.risk(found).first()["risk"]


def test_honest_table_raises_nothing(spark):
    signals, _, risk = report(honest(spark), churn(["spend", "plan", "tenure"]))
    assert signals == {} and risk == "none"


def test_renamed_copy_of_the_target(spark):
    df = honest(spark).withColumn("flag", F.initcap(F.col("churned").cast("string")))
    signals, _, risk = report(df, churn(["spend", "flag"]))
    assert signals["target_copy_among_features"]["columns"] == ["flag"] and risk == "confirmed"


def test_affine_and_near_copies_of_a_number(spark):
    df = numbered(spark, 300).withColumns({"feature": (i % 53) * 1.0, "noise": (i % 17) * 1.0})
    df = df.withColumn("price", F.col("feature") * 2.5 + 7).withColumns({
        "share": F.col("price") * 0.2 - 3, "almost": F.col("price") + (i % 3) * 0.001,
    })
    spec = TaskSpec("price", "regression", ("noise", "share", "almost"))
    signals, skipped, _ = report(df, spec, PLAIN)
    assert signals["target_derived_feature"]["columns"] == ["share"] and signals["target_derived_feature"]["blocking"]
    assert "almost" in signals["single_feature_reconstructs_target"]["columns"]
    assert ("missingness_encodes_target", "features") in skipped


def test_duplicates_crossing_the_folds(spark):
    df = numbered(spark, 300).select("row_id", ((i % 60) * 1.0).alias("spend"), pick(["a", "b", "c"]).alias("plan"), ((i % 60) % 4 == 0).alias("churned"))
    signals, _, _ = report(df, churn(["spend", "plan"]))
    assert signals["duplicate_rows_cross_folds"]["blocking"]
    other_answers = honest(spark).select("row_id", F.lit(1.0).alias("spend"), F.col("row_id").alias("z"), (i % 4 == 0).alias("churned"))
    assert "duplicate_rows_cross_folds" not in report(other_answers, churn(["spend", "z"]))[0]


def test_duplicate_counts_match_brute_force_under_skew(spark):
    df = numbered(spark, 400).select("row_id", F.when(i % 3 == 0, -1).otherwise(i % 40).alias("k"), (i % 2).cast("string").alias("y"))
    spec = TaskSpec("y", "binary", ("k",), ("0", "1"), "1", time="t")
    for protocol in (PLAIN, Protocol("forward_chaining", 4, "temporal")):
        timed = df.withColumn("t", F.timestamp_seconds(i * 60))
        a = fd.assign(timed, spec, protocol, keep=("k", "y"))
        rows = [(r["k"], r["y"], r["part"], r["chunk"]) for r in a.collect()]
        crossing = 0
        for fold in range(protocol.n_splits):
            train = lambda c: c <= fold if protocol.forward else c != fold  # noqa: B023, E731
            seen = {(k, y) for k, y, p, c in rows if p == "pool" and train(c)}
            own = fold + 1 if protocol.forward else fold
            crossing += sum((k, y) in seen for k, y, p, c in rows if p == "pool" and c == own)
        pool = {(k, y) for k, y, p, _ in rows if p == "pool"}
        held = sum((k, y) in pool for k, y, p, _ in rows if p == "holdout")
        got = lk.duplicate_crossing(a, spec, protocol).first()
        assert (got["crossing_validation_rows"], got["crossing_holdout_rows"]) == (crossing, held)


def test_groups_and_time_under_the_wrong_splitter(spark):
    df = honest(spark).withColumns({"customer": F.floor(i / 3), "t": F.timestamp_seconds(i * 3600)})
    signals, _, _ = report(df, churn(["spend"], group="customer", time="t"))
    assert signals["group_crosses_fold_boundary"]["blocking"] and signals["training_after_validation_in_time"]["blocking"]
    clean, _, _ = report(df, churn(["spend"], group="customer"), Protocol("group_k_fold", 5, "group"))
    assert "group_crosses_fold_boundary" not in clean
    ordered, _, _ = report(df, churn(["spend"], time="t"), Protocol("forward_chaining", 4, "temporal"))
    assert "training_after_validation_in_time" not in ordered


def test_missing_cells_that_give_the_answer_away(spark):
    df = numbered(spark, 400).select(
        "row_id", F.round(i * 1.13, 2).alias("spend"), F.when(i % 4 != 0, F.concat(F.lit("note-"), i)).alias("closing_note"), (i % 4 == 0).alias("churned")
    )
    signals, _, risk = report(df, churn(["spend", "closing_note"]))
    assert signals["missingness_encodes_target"]["columns"] == ["closing_note"] and risk == "high"


def test_name_alone_never_blocks(spark):
    df = honest(spark).withColumnRenamed("tenure", "refund_reason_code")
    signals, _, risk = report(df, churn(["spend", "plan", "refund_reason_code"]))
    assert set(signals) == {"post_outcome_naming"} and not signals["post_outcome_naming"]["blocking"] and risk == "suspected"


def test_what_could_not_run_is_named(spark):
    small = honest(spark, 36)
    _, skipped, _ = report(small, churn(["spend"]), Protocol("stratified_k_fold", 2, "stratified"))
    assert ("single_feature_reconstructs_target", "features") in skipped
    flat = numbered(spark, 120).select("row_id", ((i % 61) * 1.0).alias("spend"), F.lit("same").alias("constant"), (i % 4 == 0).alias("churned"))
    _, skipped, _ = report(flat, churn(["spend", "constant"]))
    assert ("single_feature_reconstructs_target", "column:constant") in skipped


def test_probe_finds_thresholds_and_categories(spark):
    df = numbered(spark, 1000).withColumns({
        "amount": ((i * 41) % 997) * 1.0, "code": F.concat(F.lit("c"), i % 40), "fog": ((i * 7) % 13) * 1.0,
    }).withColumn("churned", (F.col("amount") > 420) | (F.col("amount") < 100))
    spec = churn(["amount", "code", "fog"])
    a = fd.assign(df, spec, KFOLD, keep=(*spec.features, "churned"))
    scores = {r["feature"]: r["score"] for r in lk.probe_scores(lk.probe_histograms(a, spec), spec, KFOLD).collect()}
    assert scores["amount"] >= 0.995 and scores["code"] < 0.9 and scores["fog"] < 0.9


def test_every_feature_of_a_wide_table_is_probed(spark):
    names = [f"f{k}" for k in range(30)]
    df = numbered(spark, 200).select("row_id", *[((i * (k + 3)) % 47).cast("double").alias(f"f{k}") for k in range(30)], (i % 4 == 0).alias("churned"))
    spec = churn(names)
    a = fd.assign(df, spec, KFOLD, keep=(*names, "churned"))
    assert lk.probe_scores(lk.probe_histograms(a, spec), spec, KFOLD).filter("score is not null").count() == 30


# --- readiness -----------------------------------------------------------------------------------------


def codes(df, spec, protocol=KFOLD, leaks=None):
    found = rd.assess(df, spec, protocol, leaks)
    return {r["code"]: r["severity"] for r in found.collect()}, rd.status(found).first()["status"]


def test_healthy_table_is_ready(spark):
    df = numbered(spark, 600).select("row_id", F.round(i * 1.37, 2).alias("spend"), pick(["basic", "pro", "enterprise"]).alias("plan"), (i % 3 == 0).alias("churned"))
    assert codes(df, churn(["spend", "plan"])) == ({}, "READY")


@pytest.mark.parametrize("every,code,status", [(200, "target_almost_constant", "BLOCKED"), (8, "target_imbalanced", "CAUTION")])
def test_imbalance(spark, every, code, status):
    df = numbered(spark, 1000).select("row_id", (i * 1.5).alias("spend"), (i % every == 0).alias("churned"))
    found, got = codes(df, churn(["spend"]))
    assert code in found and got == status


def test_structure_that_the_protocol_ignores(spark):
    df = honest(spark).withColumns({"when": F.timestamp_seconds(i * 3600), "customer": F.floor(i / 5)})
    found, status = codes(df, churn(["spend", "when", "customer"]))
    assert found["time_structure_ignored"] == found["group_structure_ignored"] == "high_risk" and status == "HIGH_RISK"


def test_small_and_flat_things(spark):
    df = numbered(spark, 40).select("row_id", F.lit(1).alias("one"), (i * 1.0).alias("x"), F.when(i % 2 == 0, i * 1.0).alias("y"))
    found, _ = codes(df, TaskSpec("y", "regression", ("one", "x")), PLAIN)
    assert found["target_missing_values"] == "high_risk" and found["constant_feature"] == "caution"
    assert found["validation_fold_too_small"] == "high_risk" and found["holdout_too_small_for_intervals"] == "caution"
    flat, status = codes(df.withColumn("y", F.lit(3.0)), TaskSpec("y", "regression", ("x",)), PLAIN)
    assert "regression_target_constant" in flat and status == "BLOCKED"


def test_leakage_joins_readiness(spark):
    df = honest(spark).withColumn("flag", F.col("churned"))
    spec = churn(["spend", "flag"])
    leaks = lk.inspect(fd.assign(df, spec, KFOLD, keep=("spend", "flag", "churned")), spec, KFOLD)
    found, status = codes(df, spec, KFOLD, leaks)
    assert "leakage.target_copy_among_features" in found and status == "BLOCKED"
