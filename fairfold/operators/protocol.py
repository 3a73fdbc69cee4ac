"""Protocol recommendation: a rule over a handful of counts taken in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairfold import fixed
from fairfold.operators.profile import ColumnStats, column_stats
from fairfold.operators.task import class_summary, group_candidates, time_candidates, usable
from fairfold.spec import Protocol, RefusedError, TaskSpec


def recommend(
    df: DataFrame,
    spec: TaskSpec,
    *,
    n_splits: int = fixed.DEFAULT_SPLITS,
    holdout_size: float = fixed.DEFAULT_HOLDOUT,
    seed: int = fixed.DEFAULT_SEED,
    feature_stats: tuple[int, dict[str, ColumnStats]] | None = None,
) -> Protocol:
    """Group structure first, then time, then class balance; regression gets plain folds."""
    if not fixed.MIN_SPLITS <= n_splits <= fixed.MAX_SPLITS:
        raise RefusedError("n_splits_out_of_range", str(n_splits))
    if not fixed.MIN_HOLDOUT <= holdout_size <= fixed.MAX_HOLDOUT:
        raise RefusedError("holdout_size_out_of_range", str(holdout_size))
    rows_df = usable(df, spec.target)
    if feature_stats is None:
        names = list(dict.fromkeys([*spec.features, *(x for x in (spec.group, spec.time) if x)]))
        rows, stats, _ = column_stats(rows_df, names)
    else:
        rows, stats = feature_stats
    minority, minority_label = None, None
    if spec.is_classification:
        summary = class_summary(df, spec.target).first()
        minority, minority_label = summary["minority_rows"], summary["minority_label"]

    notes: list[str] = []

    def at_most(available: int, why: str) -> int:
        if available >= n_splits:
            return n_splits
        reduced = max(fixed.MIN_SPLITS, available)
        notes.append(f"folds_reduced:{n_splits}->{reduced}:{why}")
        return reduced

    if spec.group:
        groups = stats[spec.group].unique
        if groups < fixed.MIN_SPLITS:
            raise RefusedError("too_few_groups", str(groups))
        folds = at_most(groups, "groups")
        splitter, holdout = "group_k_fold", "group"
        if spec.is_classification:
            if minority < folds:
                notes.append(f"no_stratification:{minority_label}")
            else:
                splitter = "stratified_group_k_fold"
    elif spec.time:
        periods = stats[spec.time].unique
        holdout = "temporal"
        if periods < fixed.MIN_PERIODS:
            notes.append(f"too_few_periods:{periods}")
            splitter, folds = "k_fold", n_splits
        else:
            splitter, folds = "forward_chaining", at_most(periods, "periods")
    elif spec.is_classification:
        if minority < fixed.MIN_SPLITS:
            raise RefusedError("class_too_rare", str(minority_label))
        splitter, holdout = "stratified_k_fold", "stratified"
        folds = at_most(minority, "rarest_class")
        if minority / folds < fixed.MIN_SPLITS:
            notes.append(f"rare_class_thin:{minority_label}")
    else:
        splitter, holdout, folds = "k_fold", "random", n_splits

    features = {c: stats[c] for c in spec.features if c in stats}
    warnings: list[str] = []
    if not spec.time:
        found = time_candidates(rows_df, features)
        if found:
            warnings.append("time_columns_not_used:" + ",".join(found))
    if not spec.group:
        found = group_candidates(rows, features)
        if found:
            warnings.append("group_columns_not_used:" + ",".join(found))
    if rows < fixed.SMALL_DATASET_ROWS:
        warnings.append("small_dataset")
    if round(rows * holdout_size) < fixed.MIN_ROWS_FOR_INTERVALS:
        warnings.append("holdout_too_small_for_intervals")
    return Protocol(splitter, folds, holdout, holdout_size, seed, tuple(notes), tuple(warnings))


def describe(protocol: Protocol, spark: SparkSession) -> DataFrame:
    rows = [
        ("splitter", protocol.splitter), ("n_splits", str(protocol.n_splits)), ("holdout", protocol.holdout),
        ("shuffle", str(protocol.shuffle)), ("seed", str(protocol.seed)),
    ]
    rows += [("note", x) for x in protocol.notes] + [("warning", x) for x in protocol.warnings]
    return spark.createDataFrame(rows, "item string, value string")


def structural_facts(df: DataFrame, spec: TaskSpec) -> DataFrame:
    """The counts a recommendation rests on, as one row."""
    rows_df = usable(df, spec.target)
    measures = [F.count(F.lit(1)).alias("usable_rows")]
    if spec.group:
        measures.append(F.count_distinct(F.struct(spec.group)).alias("groups"))
    if spec.time:
        measures.append(F.count_distinct(F.struct(spec.time)).alias("periods"))
    return rows_df.agg(*measures)
