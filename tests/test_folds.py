import hashlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fairfold.functions.ordering import seeded_hash
from fairfold.operators import folds as fd
from fairfold.operators.fingerprint import content_fingerprint, split_fingerprint
from fairfold.operators.ranking import exact_quantiles, hash_rank, value_rank
from fairfold.spec import Protocol, RefusedError, TaskSpec
from tests.tables import honest, numbered

i = F.col("row_id")
SPEC = TaskSpec("churned", "binary", ("spend", "plan"), ("False", "True"), "True")


def rows(a):
    return {r["row_id"]: (r["part"], r["chunk"]) for r in a.collect()}


@pytest.mark.parametrize("splitter,holdout", [("k_fold", "random"), ("stratified_k_fold", "stratified")])
def test_partition_is_disjoint_complete_balanced_and_deterministic(spark, splitter, holdout):
    protocol = Protocol(splitter, 5, holdout)
    a = rows(fd.assign(honest(spark), SPEC, protocol))
    assert len(a) == 300 and sum(p == "holdout" for p, _ in a.values()) == 60
    sizes = [sum(c == k for _, c in a.values()) for k in range(5)]
    assert sum(sizes) == 240 and max(sizes) - min(sizes) <= 1
    assert a == rows(fd.assign(honest(spark).repartition(7), SPEC, protocol, rows_per_bucket=40))


def test_strata_keep_their_shares(spark):
    a = fd.assign(honest(spark), SPEC, Protocol("stratified_k_fold", 5, "stratified"), keep=("churned",))
    counts = {(r["part"], r["chunk"], r["churned"]): r["n"] for r in a.groupBy("part", "chunk", "churned").agg(F.count("*").alias("n")).collect()}
    assert counts[("holdout", None, True)] == 15
    assert {counts[("pool", k, True)] for k in range(5)} == {12}


def test_groups_stay_whole_even_when_one_holds_a_third(spark):
    df = numbered(spark, 600).withColumns({
        "g": F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.floor(i / 5))), "spend": i * 1.0, "churned": F.floor(i / 5) % 4 == 0,
    })
    spec = TaskSpec("churned", "binary", ("spend",), ("False", "True"), "True", group="g")
    for splitter in ("group_k_fold", "stratified_group_k_fold"):
        protocol = Protocol(splitter, 4, "group")
        a = fd.assign(df, spec, protocol, keep=("g",))
        assert a.count() == 600
        assert a.groupBy("g").agg(F.count_distinct(F.struct("part", "chunk")).alias("n")).filter("n > 1").count() == 0


def test_hot_groups_are_attached_apart_from_the_others(spark):
    df = numbered(spark, 3000).select("row_id", F.when(i % 3 == 0, "hot").otherwise(i.cast("string")).alias("__g"))
    plan = df.groupBy("__g").agg(F.count("*").alias("__n")).withColumns({"part": F.lit("pool"), "chunk": F.length("__g")})
    joined = fd.attach_by_group(df, plan, 3000)
    assert joined.count() == 3000 and joined.filter("__g = 'hot'").count() == 1000


def test_forward_chaining_trains_on_the_past_only(spark):
    df = numbered(spark, 300).withColumns({
        "created": F.format_string("2024-%02d-%02d", (i / 26 + 1).cast("int"), (i % 26 + 1).cast("int")), "churned": i % 4 == 0,
    })
    spec = TaskSpec("churned", "binary", (), ("False", "True"), "True", time="created")
    protocol = Protocol("forward_chaining", 5, "temporal")
    a = fd.assign(df, spec, protocol, keep=("created",))
    assert a.filter("part = 'holdout'").count() == 60
    edges = {r["chunk"]: (r["lo"], r["hi"]) for r in a.groupBy("chunk").agg(F.min("created").alias("lo"), F.max("created").alias("hi")).collect()}
    for fold in range(5):
        assert edges[fold][1] <= edges[fold + 1][0]
    assert edges[5][1] <= edges[None][0]
    assert rows(a) == rows(fd.assign(df, spec, protocol, rows_per_bucket=25))


def test_rows_without_time_are_the_past(spark):
    df = numbered(spark, 100).withColumns({"t": F.when(i % 10 == 0, F.lit("soon")).otherwise(F.format_string("2024-01-01 00:%02d:00", i.cast("int") % 60)), "y": i % 2})
    a = fd.assign(df, TaskSpec("y", "binary", (), ("0", "1"), "1", time="t"), Protocol("forward_chaining", 4, "temporal"), keep=("t",))
    assert a.filter("t = 'soon' and part = 'holdout'").count() == 0
    assert a.filter("t = 'soon' and chunk = 0").count() == 10


def test_too_few_rows_are_refused(spark):
    with pytest.raises(RefusedError):
        fd.assign(honest(spark, 5), SPEC, Protocol("k_fold", 5))


def test_holdout_quotas_sum_to_the_ceiling():
    for _ in range(50):
        counts = {str(k): random.randint(1, 50) for k in range(random.randint(2, 8))}
        q = fd.holdout_quotas(counts, 0.2)
        assert sum(q.values()) == -(-sum(counts.values()) // 5)
        assert all(0 <= q[c] <= counts[c] for c in counts)


def test_bucketed_ranks_equal_the_plain_window(spark):
    df = numbered(spark, 2000).select(
        "row_id", F.when(i % 3 == 0, 7.0).when(i % 50 == 1, None).otherwise((i * 37 % 101) * 1.0).alias("v"), seeded_hash(1, "s", i).alias("h")
    )
    plain = df.withColumn("want", F.row_number().over(Window.orderBy(F.col("v").asc_nulls_first(), "row_id")))
    got = value_rank(plain, "v", "row_id", n_rows=2000, rows_per_bucket=50)
    assert got.filter("rank <> want").count() == 0 and got.count() == 2000
    plain = df.withColumn("want", F.row_number().over(Window.orderBy("h", "row_id")))
    assert hash_rank(plain, "h", "row_id", n_rows=2000, rows_per_bucket=20).filter("rank <> want").count() == 0
    few = value_rank(df, "v", "row_id", n_rows=2000, rows_per_bucket=20, max_splits=4)
    smooth = df.withColumn("v", (i * 37 % 1999) * 0.5)
    fine = value_rank(smooth.withColumn("want", F.row_number().over(Window.orderBy("v", "row_id"))), "v", "row_id", n_rows=2000, rows_per_bucket=20, max_splits=4)
    want = df.withColumn("want", F.row_number().over(Window.orderBy(F.col("v").asc_nulls_first(), "row_id")))
    assert few.join(want.select("row_id", "want"), "row_id").filter("rank <> want").count() == 0
    assert fine.filter("rank <> want").count() == 0 and fine.count() == 2000
    down = value_rank(df.filter("v is not null"), "v", "row_id", n_rows=2000, descending=True, rows_per_bucket=50)
    want = df.filter("v is not null").withColumn("want", F.row_number().over(Window.orderBy(F.desc("v"), "row_id")))
    assert down.join(want.select("row_id", "want"), "row_id").filter("rank <> want").count() == 0


def test_exact_quantiles_by_narrowing(spark):
    values = [float((k * 7919) % 1009) if k % 3 else 500.0 for k in range(3000)]
    df = spark.createDataFrame([(v, None if k % 2 else v) for k, v in enumerate(values)], "a double, b double")
    shares = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    import numpy as np

    got = exact_quantiles(df, {"a": shares, "b": shares}, final_rows=50)
    assert got["a"] == pytest.approx(list(np.quantile(values, shares)))
    assert got["b"] == pytest.approx(list(np.quantile(values[::2], shares)))
    nearest = exact_quantiles(df, {"a": [0.25, 0.75]}, rule="nearest", final_rows=50)["a"]
    ordered = sorted(values)
    assert nearest == [ordered[int(2999 * q + 0.5)] for q in (0.25, 0.75)]


def test_quantiles_need_a_sketch_only_where_steps_do_not_cut(spark, monkeypatch):
    from fairfold.operators import ranking

    i = F.col("id")
    df = spark.range(6000).select(
        (i * 37 % 6000).cast("double").alias("even"), (i % 3).alias("few"), F.lit(2.5).alias("flat"), F.when(i % 2 == 0, i * 1e-3).otherwise(0.0).alias("half"),
        F.when(i == 0, 1e300).otherwise(i * 1.0).alias("far"), F.when(i < 9, float("inf")).otherwise(-i).alias("open"), F.pow(10.0, (i % 600) - 300.0).alias("steep"),
    )
    sketched = []
    sketch = ranking._narrow_by_sketch
    monkeypatch.setattr(ranking, "_narrow_by_sketch", lambda df, brackets: sketched.append({b.column for b in brackets}) or sketch(df, brackets))
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = exact_quantiles(df, {c: shares for c in df.columns}, rule="nearest", final_rows=40)
    for c in df.columns:
        ordered = sorted(r[0] for r in df.select(F.col(c).cast("double")).collect())
        assert got[c] == [ordered[int(5999 * p + 0.5)] for p in shares]
    assert sketched and set().union(*sketched) <= {"open", "steep", "far"}
    sketched.clear()
    exact_quantiles(df, {c: shares for c in ("even", "few", "flat", "half")}, final_rows=40)
    assert not sketched


def test_samples_inside_the_training_side(spark):
    protocol = Protocol("k_fold", 3)
    a = fd.assign(honest(spark), SPEC, protocol)
    probe = fd.train_probe(a, protocol, rows=50)
    assert {r["n"] for r in probe.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {50}
    assert probe.join(a, "row_id").filter("fold = chunk").count() == 0
    subsets = fd.growing_subsets(a, protocol, rows_per_bucket=60)
    by = {(r["fraction"], r["fold"]): set(r["ids"]) for r in subsets.groupBy("fraction", "fold").agg(F.collect_list("row_id").alias("ids")).collect()}
    assert len(by[(0.25, 0)]) == 40 and by[(0.25, 0)] < by[(0.5, 0)] < by[(1.0, 0)]


def test_permutation_is_a_bijection_per_repeat(spark):
    pairs = fd.permutation_pairs(numbered(spark, 500), 3, 42, n_rows=500, rows_per_bucket=100)
    for r in pairs.groupBy("repeat").agg(F.count_distinct("row_id").alias("a"), F.count_distinct("donor_id").alias("b"), F.count("*").alias("n")).collect():
        assert (r["a"], r["b"], r["n"]) == (500, 500, 500)


def test_fingerprints_see_values_order_and_sides_but_not_layout(spark):
    df = honest(spark)
    base = content_fingerprint(df, "row_id").first()["fingerprint"]
    assert base == content_fingerprint(df.repartition(5), "row_id").first()["fingerprint"]
    assert base == content_fingerprint(df.withColumn("tenure", F.col("tenure").cast("int")), "row_id").first()["fingerprint"]
    swapped = df.withColumn("row_id", F.when(i == 0, 1).when(i == 1, 0).otherwise(i).cast("long"))
    assert base != content_fingerprint(swapped, "row_id").first()["fingerprint"]
    gap = df.withColumn("plan", F.when(i != 3, F.col("plan")))
    assert content_fingerprint(gap, "row_id").first() != content_fingerprint(gap.na.fill("", ["plan"]), "row_id").first()
    protocol = Protocol("k_fold", 5)
    a = fd.assign(df, SPEC, protocol)
    assert split_fingerprint(a, protocol).first() != split_fingerprint(a, Protocol("forward_chaining", 5)).first()


def test_hexadecimal_ties(spark):
    df = numbered(spark, 1000).select((i % 3).alias("size"), seeded_hash(3, "g", i).alias("h"))
    want = df.withColumn("want", F.row_number().over(Window.orderBy("size", "h")))
    assert value_rank(want, "size", "h", n_rows=1000, hex_tie=True, rows_per_bucket=50).filter("rank <> want").count() == 0


def test_fingerprint_is_the_tree_of_whole_digests(spark):
    """Rows, runs of 65 536 row ids in id order, three levels and a root, as hashlib has it."""

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def root(header, rows):
        level = dict(rows)
        for _ in range(3):
            runs = {}
            for k in sorted(level):
                runs.setdefault(k // 65_536, []).append(f"{k}={level[k]}")
            level = {k: digest("\n".join(v)) for k, v in runs.items()}
        return digest(header + "\n" + "\n".join(level[k] for k in sorted(level)))

    ids = [0, 1, 65_535, 65_536, 200_000]
    df = spark.createDataFrame([(k, f"t{k}", None if k == 1 else k) for k in ids], "row_id long, t string, n long")
    cells = {k: digest(f"{len(f't{k}')}:t{k}" + ("-;" if k == 1 else f"{len(str(k))}:{k}")) for k in ids}
    out = content_fingerprint(df, "row_id").first()
    assert tuple(out) == ("row-tree-sha256-v1", root('[["t", "string"], ["n", "integer"]]', cells.items()))
    assert content_fingerprint(df.limit(0), "row_id").first()["fingerprint"] == digest('[["t", "string"], ["n", "integer"]]\n')
    sides = spark.createDataFrame([(k, "pool", k % 2) for k in ids] + [(7, "holdout", None)], "row_id long, part string, chunk int")
    texts = {**{k: f"{k}|pool|{k % 2}" for k in ids}, 7: "7|holdout|-"}
    want = root('["k_fold", 5, false]', [(k, digest(v)) for k, v in texts.items()])
    assert split_fingerprint(sides, Protocol("k_fold", 5)).first()["fingerprint"] == want


@pytest.mark.parametrize("splitter,excess", [("k_fold", 4), ("k_fold", 1.02), ("forward_chaining", 4)])
def test_train_probe_ranks_a_few_rows(spark, monkeypatch, splitter, excess):
    """The first rows by hash of every fold, also where the first cut leaves too few; only some times as many are ranked."""
    monkeypatch.setattr(fd, "PROBE_EXCESS", excess)
    protocol = Protocol(splitter, 5, "random" if splitter == "k_fold" else "temporal")
    a = spark.range(20_000).select(F.col("id").alias("row_id"), F.lit("pool").alias("part"), (F.col("id") % 100 * F.col("id") % 7 % 5).cast("int").alias("chunk")).cache()
    members = a.select("row_id", F.explode(fd.training_folds(protocol)).alias("fold")).withColumn("h", seeded_hash(protocol.seed, "probe", F.col("row_id")))
    order = Window.partitionBy("fold").orderBy("h", "row_id")
    for count in (30, 100_000):
        want = {(r["fold"], r["row_id"]) for r in members.withColumn("p", F.row_number().over(order)).filter(F.col("p") <= count).collect()}
        assert {tuple(r) for r in fd.train_probe(a, protocol, count).collect()} == want
    hashed = a.select("row_id", fd.training_folds(protocol).alias("folds"), seeded_hash(protocol.seed, "probe", F.col("row_id")).alias("__h"))
    assert fd._below(hashed, {f: 0.01 for f in range(6)}).groupBy("fold").count().agg(F.max("count")).first()[0] < 300
