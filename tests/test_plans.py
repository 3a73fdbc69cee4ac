"""What the physical plans must not contain, and results that must not depend on partitioning."""

import importlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fairfold.operators import folds as fd
from fairfold.operators import leakage as lk
from fairfold.operators import metrics as mt
from fairfold.plans import derived
from fairfold.session import balanced
from fairfold.spec import Protocol, TaskSpec
from tests.tables import honest

SPEC = TaskSpec("churned", "binary", ("spend", "plan"), ("False", "True"), "True")
STRATIFIED = Protocol("stratified_k_fold", 5, "stratified")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_metrics_use_no_single_task_and_no_python(spark, sf):
    text = plan(mt.fold_metrics(derived.binary_predictions(spark, sf), derived.BINARY))
    assert "SinglePartition" not in text and "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_fold_assignment_reads_two_columns_and_numbers_rows_in_buckets(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").withColumnRenamed("o_orderkey", "row_id")
    spec = TaskSpec("o_orderstatus", "multiclass", (), ("F", "O", "P"))
    text = plan(fd.assign(rows, spec, STRATIFIED, rows_per_bucket=100))
    assert "SinglePartition" not in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text and "IsNotNull(o_orderstatus)" in text


def test_duplicate_check_is_one_aggregation_by_key(spark):
    a = fd.assign(honest(spark), SPEC, STRATIFIED, keep=("spend", "plan", "churned")).checkpoint()
    text = plan(lk.duplicate_crossing(a, SPEC, STRATIFIED))
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["leaderboard_binary", "folds_stratified_group", "leakage_missingness", "profile_numeric_stats"])
def test_results_do_not_depend_on_partitioning(spark, sf, name):
    build = entry.queries()[name]
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = build(spark, sf).collect()
            seen.add(tuple(sorted(str(r) for r in rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_growth_is_linear_in_rows(spark):
    """Ten times the copies of one key still give one counter row per key."""
    one = honest(spark, 200).withColumn("spend", F.lit(1.0)).withColumn("plan", F.lit("a"))
    a = fd.assign(one, SPEC, STRATIFIED, keep=("spend", "plan", "churned"))
    got = lk.duplicate_crossing(a, SPEC, STRATIFIED).first()
    assert got["crossing_validation_rows"] == 160 and got["share"] == 1.0


def test_dealt_rows_a_task_do_not_grow(spark):
    """More rows, in more scan tasks, make more partitions, none of them larger."""
    small = [f"spark.sql.adaptive.{k}" for k in ("advisoryPartitionSizeInBytes", "coalescePartitions.minPartitionSize")]
    for key in small:
        spark.conf.set(key, "64k")
    try:
        largest = []
        for n in (100_000, 800_000):
            rows = balanced(spark.range(0, n, 1, n // 50_000).withColumnRenamed("id", "row_id"), "row_id")
            sizes = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
            assert sum(r["count"] for r in sizes) == n
            largest.append(max(r["count"] for r in sizes))
        assert largest[1] < 2 * largest[0]
    finally:
        for key in small:
            spark.conf.unset(key)


@pytest.mark.parametrize("name", ["predictions_sink", "snapshot_store"])
def test_writers_deal_their_rows(spark, sf, monkeypatch, name):
    module = importlib.import_module("fairfold.plans.compete" if name == "predictions_sink" else "fairfold.plans.intake")
    dealt, real = [], module.balanced
    monkeypatch.setattr(module, "balanced", lambda df, by: dealt.append(by) or real(df, by))
    assert getattr(module, name)(spark, sf).count() and dealt == ["row_id"]
