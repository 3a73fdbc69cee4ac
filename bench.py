"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is materialised in full (``noop`` sink).  ``queries`` holds the second run of each query,
``cold`` the first one in the same session.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from fairfold.operators import folds, leakage, metrics, profile
from fairfold.operators import leaderboard as board
from fairfold.operators.fingerprint import content_fingerprint
from fairfold.operators.rowid import with_row_id
from fairfold.plans import derived
from fairfold.plans.registry import table
from fairfold.session import local_session
from fairfold.spec import Objective, Protocol, TaskSpec

FEATURES = (
    "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus",
)
SPEC = TaskSpec("l_returnflag", "multiclass", FEATURES, ("A", "N", "R"), time="l_shipdate", group="l_orderkey")
PLAIN = TaskSpec("l_returnflag", "multiclass", FEATURES, ("A", "N", "R"))
STRATIFIED = Protocol("stratified_k_fold", 5, "stratified")


def lineitem(spark, sf):
    return with_row_id(spark, [f"{sf}/lineitem.parquet"])


def materialise(df):
    df.write.format("noop").mode("overwrite").save()


def fold_assignment(spark, sf):
    materialise(folds.assign(lineitem(spark, sf), PLAIN, STRATIFIED))


def fold_assignment_group(spark, sf):
    materialise(folds.assign(lineitem(spark, sf), SPEC, Protocol("group_k_fold", 5, "group")))


def fold_assignment_forward(spark, sf):
    materialise(folds.assign(lineitem(spark, sf), SPEC, Protocol("forward_chaining", 5, "temporal")))


def _assigned(spark, sf):
    return folds.assign(lineitem(spark, sf), PLAIN, STRATIFIED, keep=(*FEATURES, "l_returnflag"))


def leakage_report(spark, sf):
    # the assigned table is read by several checks and therefore cut from its lineage, as in analyze_task
    materialise(leakage.inspect(_assigned(spark, sf).checkpoint(), PLAIN, STRATIFIED))


def duplicate_crossing(spark, sf):
    materialise(leakage.duplicate_crossing(_assigned(spark, sf), PLAIN, STRATIFIED))


def fingerprint(spark, sf):
    materialise(content_fingerprint(lineitem(spark, sf), "row_id"))


def profile_lineitem(spark, sf):
    materialise(profile.profile_columns(table(spark, sf, "lineitem")))


def metrics_leaderboard(spark, sf):
    p = derived.binary_predictions(spark, sf)
    folds_ = metrics.fold_metrics(p, derived.BINARY)
    objective = Objective.default("binary")
    materialise(board.champion(board.leaderboard(folds_, derived.contender_facts(spark, p), objective), objective))


QUERIES = {
    f.__name__: f
    for f in (
        fold_assignment, fold_assignment_group, fold_assignment_forward, leakage_report, duplicate_crossing,
        fingerprint, profile_lineitem, metrics_leaderboard,
    )
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cores)
    table(spark, sf, "lineitem").agg(F.count("*")).collect()
    cold, warm = {}, {}
    for name, run in QUERIES.items():
        for times in (cold, warm):
            started = time.perf_counter()
            run(spark, sf)
            times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "sf": sf.rsplit("sf", 1)[-1],
        "cold": cold, "spark": spark.version, "master": f"local[{cores}]", "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
