import pytest
from pyspark.sql import functions as F

from fairfold.operators import profile as pf
from fairfold.operators import protocol as pc
from fairfold.operators import task as tk
from fairfold.spec import RefusedError, TaskSpec
from tests.tables import honest, numbered, pick

i = F.col("row_id")


def columns(df, **options):
    return {r["column"]: r for r in pf.profile_columns(df, **options).collect()}


def test_missing_counts_and_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "b")], "value long, label string")
    row = pf.profile_table(df).first()
    assert (row["missing_cell_count"], row["missing_cell_ratio"], row["duplicate_row_count"]) == (1, 0.125, 1)
    got = columns(df)
    assert got["value"]["unique_count"] == 3 and not got["value"]["is_constant"]  # a missing value is a value
    assert [(t["value"], t["count"]) for t in got["label"]["top_values"]] == [("a", 2), ("b", 2)]


def test_identifiers(spark):
    df = spark.range(1, 21).select(F.col("id"), (F.col("id") * 1.0).alias("value"), (F.col("id") * 3).alias("sparse_id"))
    got = columns(df)
    assert got["id"]["id_reason"] == "gap_free_counter" and got["sparse_id"]["id_reason"] == "almost_unique"
    assert not got["value"]["is_probable_id"]
    assert not columns(df.limit(5))["id"]["is_probable_id"]


def test_near_constant_is_not_constant(spark):
    df = numbered(spark, 200).select(F.lit("same").alias("constant"), F.when(i == 7, "other").otherwise("same").alias("near"), i.cast("string").alias("varied"))
    got = columns(df)
    assert got["constant"]["is_constant"] and got["constant"]["is_near_constant"]
    assert not got["near"]["is_constant"] and got["near"]["is_near_constant"]
    assert not got["varied"]["is_near_constant"]


def test_numeric_statistics_ignore_missing_cells(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None), (3.0, 3.0), (4.0, None)], "a double, b double")
    got = columns(df)
    assert got["a"]["stats"]["median"] == 2.5 and got["b"]["stats"]["mean"] == 2.0
    assert (got["a"]["stats"]["q1"], got["a"]["stats"]["q3"]) == (2.0, 3.0)
    assert got["a"]["stats"]["std"] == pytest.approx(1.290994)


def test_examples_come_in_row_order_even_when_late(spark):
    df = numbered(spark, 5000).select("row_id", F.when(i > 4000, F.concat(F.lit("v"), i)).alias("late"), i.alias("early"))
    got = columns(df.repartition(6), row_id="row_id")
    assert got["late"]["examples"] == [f"v{k}" for k in range(4001, 4006)] and got["early"]["examples"] == list("01234")


def test_approximate_counts_are_close(spark):
    df = numbered(spark, 3000).select((i % 500).alias("a"))
    _, exact, _ = pf.column_stats(df, ["a"])
    _, rough, _ = pf.column_stats(df, ["a"], exact=False)
    assert exact["a"].unique == 500 and abs(rough["a"].unique - 500) < 50


# --- task -------------------------------------------------------------------------------------------------


def test_task_types_and_refusals(spark):
    df = numbered(spark, 2000).select(
        (i % 2 == 0).alias("flag"), (i % 10).alias("digit"), (i * 1.1).alias("amount"), F.lit(1).alias("one"),
        F.lit(None).cast("double").alias("nothing"), F.timestamp_seconds(i).alias("t"), F.concat(F.lit("u"), i).alias("text"),
    )
    got = {r["column"]: (r["task_type"], r["refusal"]) for r in tk.task_types(df, df.columns).collect()}
    assert got == {
        "flag": ("binary", None), "digit": ("multiclass", None), "amount": ("regression", None), "one": (None, "target_constant"),
        "nothing": (None, "target_empty"), "t": (None, "target_temporal"), "text": (None, "too_many_classes"),
    }


def test_proposal(spark):
    df = honest(spark).withColumns({"customer": F.floor(i / 5), "created": F.format_string("2024-01-01 00:%02d:00", i.cast("int") % 60)})
    p = tk.propose_task(df, "churned", row_id="row_id", row_key=("tenure",))
    assert (p.task_type, p.labels, p.positive) == ("binary", ("False", "True"), "True")
    assert p.excluded == (("tenure", "row_key"),) and "tenure" not in p.features
    assert p.time_candidates == ("created",) and "customer" in p.group_candidates
    with pytest.raises(RefusedError):
        tk.propose_task(df.limit(10), "churned", row_id="row_id")


def test_spec_guards(spark):
    df = honest(spark)
    good = tk.build_spec(df, "churned", "binary", ("spend",), positive="True")
    assert good.labels == ("False", "True")
    for kwargs in ({"features": ()}, {"features": ("churned",)}, {"features": ("spend", "spend")}, {"features": ("nope",)}, {"features": ("spend",), "positive": "maybe"}):
        with pytest.raises(RefusedError):
            tk.build_spec(df, "churned", "binary", **{"positive": "True", **kwargs})


def recommend(df, **kwargs):
    spec = TaskSpec("churned", "binary", tuple(c for c in df.columns if c not in ("row_id", "churned")), ("False", "True"), "True", **kwargs)
    return pc.recommend(df, spec)


def test_protocol_rules(spark):
    balanced = numbered(spark, 200).select("row_id", (i * 1.0).alias("spend"), pick(["basic", "pro"], 2).alias("plan"), (i % 2 == 0).alias("churned"))
    p = recommend(balanced)
    assert (p.splitter, p.n_splits, p.holdout, p.notes) == ("stratified_k_fold", 5, "stratified", ())
    rare = balanced.withColumn("churned", i < 3)
    p = recommend(rare)
    assert p.n_splits == 3 and p.notes[0].startswith("folds_reduced:5->3")
    with pytest.raises(RefusedError):
        recommend(balanced.withColumn("churned", i < 1))
    grouped = balanced.withColumn("g", F.floor(i / 5))
    assert recommend(grouped, group="g").splitter == "stratified_group_k_fold"
    assert any(w.startswith("group_columns_not_used") for w in recommend(grouped).warnings)
    with pytest.raises(RefusedError):
        recommend(grouped.withColumn("g", F.lit(1)), group="g")
    timed = balanced.withColumn("t", F.timestamp_seconds(i))
    assert (recommend(timed, time="t").splitter, recommend(timed, time="t").holdout) == ("forward_chaining", "temporal")
    two = recommend(timed.withColumn("t", F.timestamp_seconds(i % 2)), time="t")
    assert (two.splitter, two.holdout) == ("k_fold", "temporal")
    assert "small_dataset" in recommend(balanced.limit(40)).warnings


def test_time_candidates_read_whole_columns(spark):
    """Dates at the head alone are none; a few bad cells are forgiven; nine moments are too few."""
    i = F.col("id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), i.cast("int")).cast("string")
    df = spark.range(1000).select(
        i.alias("row_id"), F.when(i < 300, day).otherwise("n/a").alias("head"), F.when(i % 20 == 0, "?").otherwise(day).alias("few bad"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 9).cast("int")).cast("string").alias("nine"), F.when(i > 900, day).alias("late"),
    )
    _, stats, _ = pf.column_stats(df, df.columns[1:])
    assert tk.time_candidates(df, stats) == ["few bad", "late"]


def test_distinct_counts_of_all_types(spark):
    df = spark.sql(
        "select id % 7 as a, if(id % 3 = 0, null, cast(id % 5 as double)) as b, cast(id % 2 as boolean) as c, date_add(date '2020-01-01', cast(id % 9 as int)) as d, "
        "timestamp_micros(id % 11) as e, cast(id % 4 as string) as f, cast(id % 6 as decimal(10, 2)) as g, array(id % 8) as h, cast(null as string) as i, "
        "case id % 4 when 0 then double('NaN') when 1 then -0D when 2 then 0D end as j, cast(id % 10 as tinyint) as k, timestamp_ntz '2020-01-01' as l from range(500)"
    )
    assert pf.distinct_counts(df, df.columns) == [7, 6, 2, 9, 11, 4, 6, 8, 1, 3, 10, 1]
    assert pf.distinct_counts(df.limit(0), df.columns) == [0] * 12
