"""Task setup: what can be predicted, from which columns, and what structure the rows carry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairfold import fixed
from fairfold.functions.scalars import FLOATING, NUMERIC, TEMPORAL, dtype_of, feature_kinds, label_text, moment
from fairfold.operators.profile import ColumnStats, column_stats
from fairfold.spec import RefusedError, TaskSpec


def usable(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is known. NaN is a value, not a missing one."""
    return df.filter(F.col(target).isNotNull())


def project_features(df: DataFrame, features: tuple[str, ...], *keep: str) -> DataFrame:
    return df.select(*keep, *features)


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """label, n over rows with a known target."""
    return (
        usable(df, target)
        .groupBy(label_text(target, dtype_of(df, target)).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_summary(df: DataFrame, target: str) -> DataFrame:
    """Number of classes with the rarest and the most frequent one; equal counts go by label."""
    return class_counts(df, target).agg(
        F.count(F.lit(1)).alias("classes"),
        F.sum("n").alias("usable_rows"),
        F.min_by("label", F.struct("n", "label")).alias("minority_label"),
        F.min("n").alias("minority_rows"),
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("majority_label"),
        F.max("n").alias("majority_rows"),
    )


def bounded_labels(df: DataFrame, target: str) -> list[str]:
    """Sorted class labels; refuses more than the allowed number instead of listing them."""
    label = label_text(target, dtype_of(df, target))
    found = usable(df, target).select(label.alias("label")).distinct().limit(fixed.MAX_CLASSES_ALLOWED + 1).collect()
    if len(found) > fixed.MAX_CLASSES_ALLOWED:
        raise RefusedError("too_many_classes", target)
    return sorted(r["label"] for r in found)


def class_limit(present: int) -> int:
    return max(fixed.MIN_CLASS_LIMIT, min(fixed.MAX_CLASSES_LISTED, round(present * fixed.CLASS_SHARE)))


def target_verdict(stats: ColumnStats) -> tuple[str | None, str | None]:
    """(task type, refusal code) of a column considered as a target."""
    unique = stats.unique - (1 if stats.missing else 0)
    if stats.present == 0:
        return None, "target_empty"
    if stats.is_temporal:
        return None, "target_temporal"
    if unique < 2:
        return None, "target_constant"
    if not isinstance(stats.dtype, NUMERIC) or unique <= class_limit(stats.present):
        if unique > fixed.MAX_CLASSES_ALLOWED:
            return None, "too_many_classes"
        return ("binary" if unique == 2 else "multiclass"), None
    return "regression", None


def task_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """The verdict for every column as a possible target, from one aggregation."""
    _, stats, _ = column_stats(df, columns)
    rows = []
    for s in stats.values():
        task, refusal = target_verdict(s)
        rows.append((s.name, s.present, s.unique - (1 if s.missing else 0), task, refusal))
    return df.sparkSession.createDataFrame(
        rows, "column string, known_rows long, distinct_values long, task_type string, refusal string"
    )


def time_candidates(df: DataFrame, stats: dict[str, ColumnStats]) -> list[str]:
    """Temporal columns with enough distinct moments, or text columns whose cells are dates, but for a few.

    All cells have a say, in one aggregate; distinct moments are only counted as far as they must be.
    """
    texts = [n for n, s in stats.items() if isinstance(s.dtype, T.StringType) and s.present >= fixed.MIN_TIMESTAMPS]
    parsed = [moment(f"`{n.replace('`', '``')}`", T.StringType()) for n in texts]
    dates: set[str] = set()
    if texts:
        row = df.agg(*[F.count(p).alias(f"c{i}") for i, p in enumerate(parsed)]).first()
        for i, (name, p) in enumerate(zip(texts, parsed, strict=True)):
            if row[i] >= (1 - fixed.TIME_PARSE_FAILURES) * stats[name].present:
                some = df.select(p.alias("ts")).where("ts is not null").distinct().limit(fixed.MIN_TIMESTAMPS).count()
                if some >= fixed.MIN_TIMESTAMPS:
                    dates.add(name)
    return [n for n, s in stats.items() if n in dates or s.is_temporal and s.unique >= fixed.MIN_TIMESTAMPS]


def group_candidates(rows: int, stats: dict[str, ColumnStats]) -> list[str]:
    """Columns that look like a recurring entity."""
    if rows < fixed.GROUP_MIN_ROWS:
        return []
    return [
        s.name
        for s in stats.values()
        if not isinstance(s.dtype, (*FLOATING, *TEMPORAL))
        and fixed.GROUP_MIN_COUNT <= s.unique < rows
        and fixed.GROUP_RATIO_LOW <= s.unique / rows <= fixed.GROUP_RATIO_HIGH
    ]


def encoded_width(stats: ColumnStats) -> int:
    """Columns a feature becomes after encoding."""
    if stats.is_temporal:
        return len(fixed.DATETIME_PARTS)
    if stats.is_numeric or stats.logical == "boolean":
        return 1
    return max(1, min(stats.unique, fixed.ONE_HOT_CAP))


def effective_dimension(stats: dict[str, ColumnStats]) -> int:
    return sum(encoded_width(s) for s in stats.values())


def model_context(df: DataFrame, spec: TaskSpec, n_train_rows: int) -> DataFrame:
    """Properties of the usable rows that decide which models apply: one row."""
    rows_df = usable(df, spec.target)
    rows, stats, _ = column_stats(rows_df, spec.features)
    kinds = feature_kinds(df, spec.features)
    # boolean counts as categorical here although it is a single dimension
    cardinalities = [s.unique for s in stats.values() if not s.is_numeric]
    missing = sum(s.missing for s in stats.values())
    dimension = effective_dimension(stats)
    classes = least = None
    if spec.is_classification:
        summary = class_summary(df, spec.target).first()
        classes, least = summary["classes"], summary["minority_rows"]
    cells = max(1, rows * max(1, len(spec.features)))
    return df.sparkSession.createDataFrame(
        [(
            spec.task_type, rows, n_train_rows, len(spec.features), dimension, len(kinds.numeric),
            len(spec.features) - len(kinds.numeric) - len(kinds.datetime), len(kinds.datetime),
            max(cardinalities, default=0), round(missing / cells, 6), missing > 0, classes, least,
            n_train_rows * dimension * 8,
        )],
        "task_type string, n_rows long, n_train_rows long, n_features int, effective_dimension int, n_numeric int, "
        "n_categorical int, n_datetime int, max_cardinality long, missing_ratio double, has_missing boolean, "
        "n_classes long, min_class_count long, matrix_bytes long",
    )


def group_statistics(df: DataFrame, group: str) -> DataFrame:
    """Number of groups (missing is one), rows per group on average and in the largest."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("groups"), F.avg("n").alias("rows_per_group"), F.max("n").alias("largest_group")
    )


@dataclass(frozen=True)
class TaskProposal:
    target: str
    task_type: str
    labels: tuple[str, ...]
    positive: str | None
    features: tuple[str, ...]
    excluded: tuple[tuple[str, str], ...]  # (column, reason)
    time_candidates: tuple[str, ...]
    group_candidates: tuple[str, ...]
    rows: int
    usable_rows: int
    warnings: tuple[str, ...]

    def as_dataframe(self, spark: SparkSession) -> DataFrame:
        rows = [("target", self.target), ("task_type", self.task_type), ("usable_rows", str(self.usable_rows))]
        rows += [("label", x) for x in self.labels] + ([("positive", self.positive)] if self.positive else [])
        rows += [("feature", x) for x in self.features]
        rows += [(f"excluded:{why}", x) for x, why in self.excluded]
        rows += [("time_candidate", x) for x in self.time_candidates]
        rows += [("group_candidate", x) for x in self.group_candidates]
        rows += [("warning", x) for x in self.warnings]
        return spark.createDataFrame(rows, "item string, value string")


def suggested_exclusions(
    stats: dict[str, ColumnStats], target: str, row_key: tuple[str, ...] = (), identifier_hints: tuple[str, ...] = ()
) -> list[tuple[str, str, float]]:
    """(column, reason, measured unique ratio): declared keys first, then hinted identifiers, then the row id."""
    result: dict[str, tuple[str, str, float]] = {}
    for reason, names in (("row_key", row_key), ("identifier_hint", identifier_hints)):
        for name in names:
            if name != target and name in stats and name not in result:
                result[name] = (name, reason, stats[name].unique_ratio)
    if fixed.RESERVED_ROW_ID in stats:
        result[fixed.RESERVED_ROW_ID] = (fixed.RESERVED_ROW_ID, "reserved", stats[fixed.RESERVED_ROW_ID].unique_ratio)
    return list(result.values())


def propose_task(
    df: DataFrame,
    target: str,
    *,
    row_id: str,
    row_key: tuple[str, ...] = (),
    identifier_hints: tuple[str, ...] = (),
    stats: dict[str, ColumnStats] | None = None,
) -> TaskProposal:
    """Task type, features, exclusions and structural candidates for a target column.

    ``stats`` of all columns spare the aggregation when the caller has them already.
    """
    if target not in df.columns:
        raise RefusedError("unknown_column", target)
    columns = [c for c in df.columns if c != row_id]
    if stats is None:
        _, stats, _ = column_stats(df, columns)
    rows = stats[target].rows
    goal = stats[target]
    task, refusal = target_verdict(goal)
    if refusal:
        raise RefusedError(refusal, target)
    if goal.present < fixed.MIN_TRAINING_ROWS:
        raise RefusedError("too_few_rows", f"{goal.present} rows with a known target")
    excluded = suggested_exclusions(stats, target, row_key, identifier_hints)
    dropped = {x[0] for x in excluded}
    features = tuple(c for c in columns if c != target and c not in dropped)
    if not features:
        raise RefusedError("no_features", target)
    others = {c: stats[c] for c in columns if c != target and c not in dropped}
    labels: tuple[str, ...] = ()
    positive = None
    if task != "regression":
        labels = tuple(bounded_labels(df, target))
        if task == "binary":
            positive = class_summary(df, target).first()["minority_label"]
    warnings = []
    if goal.missing:
        warnings.append("target_has_missing_values")
    if task == "multiclass" and len(labels) > fixed.MAX_CLASSES_LISTED:
        warnings.append("very_many_classes")
    return TaskProposal(
        target, task, labels, positive, features, tuple((n, why) for n, why, _ in excluded),
        tuple(time_candidates(df, others)), tuple(group_candidates(rows, others)),
        rows, goal.present, tuple(warnings),
    )


def build_spec(
    df: DataFrame, target: str, task_type: str, features: tuple[str, ...], *,
    positive: str | None = None, group: str | None = None, time: str | None = None, row_id: str = "row_id",
) -> TaskSpec:
    """A checked task; every refusal happens before any model is fitted."""
    for name in (target, *features, *(x for x in (group, time) if x)):
        if name not in df.columns:
            raise RefusedError("unknown_column", name)
    if not features:
        raise RefusedError("no_features")
    if target in features or row_id in features:
        raise RefusedError("feature_is_target_or_row_id")
    if len(set(features)) != len(features):
        raise RefusedError("duplicate_features")
    labels = tuple(bounded_labels(df, target)) if task_type != "regression" else ()
    if task_type == "binary" and len(labels) != 2:
        raise RefusedError("binary_needs_two_classes", str(len(labels)))
    if task_type == "multiclass" and len(labels) < 2:
        raise RefusedError("fewer_than_two_classes")
    if task_type == "binary" and positive not in labels:
        raise RefusedError("positive_label_unknown", str(positive))
    return TaskSpec(
        target, task_type, tuple(features), labels, positive if task_type == "binary" else None, group, time, row_id
    )
