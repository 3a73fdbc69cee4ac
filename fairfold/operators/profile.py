"""Dataset profile: a fixed number of Spark jobs whatever the number of columns.

Counts and moments are one wide aggregation, exact distinct counts another.  Value counts are taken only
for the columns that can need them, and quartiles come from exact order statistics by narrowing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairfold import fixed
from fairfold.functions.scalars import FLOATING, INTEGRAL, TEMPORAL, dtype_of, label_text, logical_type
from fairfold.operators.ranking import exact_order_statistics, exact_quantiles


@dataclass(frozen=True)
class ColumnStats:
    name: str
    dtype: T.DataType
    rows: int
    missing: int
    unique: int  # a missing value counts as one value
    low: float | None = None
    high: float | None = None
    mean: float | None = None
    std: float | None = None

    @property
    def logical(self) -> str | None:
        return logical_type(self.dtype)

    @property
    def present(self) -> int:
        return self.rows - self.missing

    @property
    def unique_ratio(self) -> float:
        return round(self.unique / self.rows, 6) if self.rows else 0.0

    @property
    def missing_ratio(self) -> float:
        return round(self.missing / self.rows, 6) if self.rows else 0.0

    @property
    def is_constant(self) -> bool:
        return self.unique <= 1

    @property
    def is_temporal(self) -> bool:
        return isinstance(self.dtype, TEMPORAL)

    @property
    def is_numeric(self) -> bool:
        return self.logical in ("integer", "float", "decimal")

    @property
    def id_reason(self) -> str | None:
        """Why the column looks like an identifier; NULL when it does not."""
        if self.rows < fixed.ID_MIN_ROWS or self.missing or isinstance(self.dtype, FLOATING):
            return None
        if self.unique / self.rows < fixed.ID_UNIQUE_RATIO:
            return None
        # n distinct integers spanning exactly n values can only be a gap-free counter
        if isinstance(self.dtype, INTEGRAL) and self.unique == self.rows and self.high - self.low == self.rows - 1:
            return "gap_free_counter"
        return "almost_unique"


def column_stats(
    df: DataFrame, columns: list[str] | tuple[str, ...], *, exact: bool = True, extra: dict[str, Column] | None = None
) -> tuple[int, dict[str, ColumnStats], dict]:
    """Two jobs over the table for all columns together: moments, then distinct counts.

    ``exact=False`` swaps the distinct counts for HyperLogLog estimates, which removes the only shuffle.
    """
    plain = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        c = F.col(f"`{name}`")
        plain.append(F.count_if(c.isNull()).alias(f"m{i}"))
        if not exact:
            plain.append((F.approx_count_distinct(c) + F.max(c.isNull().cast("int"))).alias(f"u{i}"))
        if logical_type(dtype_of(df, name)) in ("integer", "float", "decimal"):
            number = c.cast("double")
            exact_type = c.cast("long") if isinstance(dtype_of(df, name), INTEGRAL) else number
            plain += [
                F.min(exact_type).alias(f"lo{i}"), F.max(exact_type).alias(f"hi{i}"),
                F.avg(number).alias(f"av{i}"), F.stddev_samp(number).alias(f"sd{i}"),
            ]
    for key, expression in (extra or {}).items():
        plain.append(expression.alias(key))
    row = df.agg(*plain).first().asDict()
    if exact:
        row |= {f"u{i}": n for i, n in enumerate(distinct_counts(df, columns))}
    stats = {
        name: ColumnStats(
            name, dtype_of(df, name), row["rows"], row[f"m{i}"], row[f"u{i}"],
            row.get(f"lo{i}"), row.get(f"hi{i}"), row.get(f"av{i}"), row.get(f"sd{i}"),
        )
        for i, name in enumerate(columns)
    }
    return row["rows"], stats, {k: row[k] for k in (extra or {})}


def distinct_counts(df: DataFrame, columns: list[str] | tuple[str, ...]) -> list[int]:
    """Exact numbers of distinct values; a missing value counts as one value.

    Columns that one type holds without loss travel as (number, value): a key of two fields, whatever
    the table's width.
    """
    kinds: dict[str, list[tuple[int, Column]]] = {}
    other = []
    for i, name in enumerate(columns):
        c, dtype = F.col(f"`{name}`"), dtype_of(df, name)
        if isinstance(dtype, (*INTEGRAL, T.BooleanType)):
            kinds.setdefault("long", []).append((i, c.cast("long")))
        elif isinstance(dtype, T.DateType):
            kinds.setdefault("long", []).append((i, F.unix_date(c).cast("long")))
        elif isinstance(dtype, T.TimestampType):
            kinds.setdefault("long", []).append((i, F.unix_micros(c)))
        elif isinstance(dtype, FLOATING):
            kinds.setdefault("double", []).append((i, c.cast("double")))
        elif dtype == T.StringType():
            kinds.setdefault("string", []).append((i, c))
        else:
            other.append((i, c))
    counts = [0] * len(columns)
    parts = []
    for members in kinds.values():
        number = F.get(F.array(*[F.lit(i) for i, _ in members]), F.col("at"))
        cells = df.select(F.posexplode(F.array(*[c for _, c in members])).alias("at", "v")).distinct()
        parts.append(cells.groupBy(number.alias("i")).agg(F.count(F.lit(1)).alias("n")))
    if parts:
        for r in reduce(DataFrame.unionAll, parts).collect():
            counts[r["i"]] = r["n"]
    if other:
        row = df.agg(*[F.count_distinct(F.struct(c)).alias(f"u{i}") for i, c in other]).first()
        for i, _ in other:
            counts[i] = row[f"u{i}"]
    return counts


def long_cells(df: DataFrame, columns: list[str], *keep: Column) -> DataFrame:
    """(keep..., column, text) for every non-null cell of ``columns``."""
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("column"), label_text(F.col(f"`{name}`"), dtype_of(df, name)).alias("text"))
            for name in columns
        ]
    )
    return df.select(*keep, F.explode(cells).alias("x")).select(
        *[c for c in df.select(*keep).columns], "x.column", "x.text"
    ).filter("text is not null")


def value_counts(df: DataFrame, columns: list[str], keep: int) -> DataFrame:
    """Most frequent values per column (ties by value) with the share among non-null cells.

    The rank filter is pushed below the shuffle, so each task sends at most ``keep`` rows per column.
    """
    counts = long_cells(df, columns).groupBy("column", "text").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("text"))
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)


def first_values(df: DataFrame, stats: dict[str, ColumnStats], row_id: str, keep: int) -> DataFrame:
    """(column, place, row_id, text): the first ``keep`` non-null values of each column by row id.

    Usually the head of the table has them all; only columns that are sparse there are searched in full.
    """
    columns = list(stats)
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "column string, place int, row_id long, text string")
    start = df.agg(F.min(row_id)).first()[0] or 0
    head = df.filter(F.col(row_id) < start + 20 * keep + 1_000)
    found = head.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    ready = [c for i, c in enumerate(columns) if found[f"c{i}"] >= min(keep, stats[c].present)]
    sparse = [c for c in columns if c not in ready]
    order = Window.partitionBy("column").orderBy("row_id")
    parts = []
    for source, names in ((head, ready), (df, sparse)):
        if names:
            cells = long_cells(source, names, F.col(row_id).alias("row_id"))
            parts.append(cells.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep))
    united = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return united.select("column", "place", "row_id", "text")


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows, distinct rows and the surplus; partial aggregation collapses copies before the shuffle."""
    columns = columns or df.columns
    return (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count(F.lit(1)).alias("distinct_rows"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        )
    )


def numeric_quartiles(df: DataFrame, stats: dict[str, ColumnStats]) -> dict[str, tuple[float, float, float]]:
    """(q1, median, q3): quartiles at the nearest rank, the median averaging the two middle values."""
    names = [s.name for s in stats.values() if s.is_numeric and s.present]
    if not names:
        return {}
    counts = {c: stats[c].present for c in names}
    places = {}
    for c, n in counts.items():
        middle = (n - 1) / 2
        places[c] = (math.floor((n - 1) * 0.25 + 0.5), math.floor(middle), math.ceil(middle), math.floor((n - 1) * 0.75 + 0.5))
    found = exact_order_statistics(df, {c: sorted(set(p)) for c, p in places.items()}, counts)
    return {
        c: (found[c][a], (found[c][low] + found[c][high]) / 2, found[c][b]) for c, (a, low, high, b) in places.items()
    }


PROFILE_SCHEMA = (
    "column string, logical_type string, missing_count long, missing_ratio double, unique_count long, "
    "unique_ratio double, is_constant boolean, is_probable_id boolean, id_reason string, "
    "stats struct<min:double,max:double,mean:double,median:double,std:double,q1:double,q3:double>"
)


def profile_columns(df: DataFrame, *, row_id: str | None = None, exact: bool = True) -> DataFrame:
    """One row per column: counts, ratios, flags, numeric statistics, top values and examples."""
    spark = df.sparkSession
    columns = [c for c in df.columns if c != row_id]
    rows, stats, _ = column_stats(df, columns, exact=exact)
    quartiles = numeric_quartiles(df, stats)

    def numbers(s: ColumnStats):
        if s.name not in quartiles:
            return None
        q1, median, q3 = quartiles[s.name]
        values = (s.low, s.high, s.mean, median, s.std, q1, q3)
        return tuple(round(float(v), 6) if v is not None else 0.0 for v in values)

    base = spark.createDataFrame(
        [
            (s.name, s.logical, s.missing, s.missing_ratio, s.unique, s.unique_ratio, s.is_constant,
             s.id_reason is not None, s.id_reason, numbers(s))
            for s in stats.values()
        ],
        PROFILE_SCHEMA,
    )
    # a value can cover 99% of the cells only where distinct values are few
    counted = [
        s.name
        for s in stats.values()
        if s.logical in ("string", "boolean") or s.unique - 1 <= rows * (1 - fixed.NEAR_CONSTANT_SHARE) + 1
    ]
    if counted:
        present = F.create_map(*[x for s in stats.values() for x in (F.lit(s.name), F.lit(s.present))])
        texty = [s.name for s in stats.values() if s.logical in ("string", "boolean")]
        share = F.col("n") / F.element_at(present, F.col("column"))
        entry = F.struct("place", F.col("text").alias("value"), F.col("n").alias("count"), F.round(share, 6).alias("ratio"))
        tops = (
            value_counts(df, counted, fixed.TOP_VALUES)
            .groupBy("column")
            .agg(
                (F.max(share) >= fixed.NEAR_CONSTANT_SHARE).alias("near"),
                F.sort_array(F.collect_list(entry)).alias("top"),
            )
            .select("column", "near", F.when(F.col("column").isin(texty), F.col("top")).alias("top_values"))
        )
        base = base.join(tops, "column", "left")
    else:
        empty = "array<struct<place:int,value:string,count:long,ratio:double>>"
        base = base.withColumn("near", F.lit(False)).withColumn("top_values", F.lit(None).cast(empty))
    base = base.withColumn("is_near_constant", F.coalesce("near", F.lit(False))).drop("near")
    if row_id:
        examples = (
            first_values(df, stats, row_id, fixed.EXAMPLES)
            .groupBy("column")
            .agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("e"))
            .select("column", F.col("e.text").alias("examples"))
        )
        base = base.join(examples, "column", "left")
    return base


def profile_table(df: DataFrame) -> DataFrame:
    """Rows, columns, duplicates and missing cells of the whole table: one row."""
    missing = sum((F.sum(F.col(f"`{c}`").isNull().cast("long")) for c in df.columns), F.lit(0))
    width = len(df.columns)
    overall = df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(missing, F.lit(0)).alias("missing_cells"))
    duplicates = duplicate_rows(df).select("duplicate_rows").scalar()
    return overall.select(
        "row_count", F.lit(width).alias("column_count"),
        duplicates.alias("duplicate_row_count"),
        F.col("missing_cells").alias("missing_cell_count"),
        F.round(F.coalesce(F.try_divide("missing_cells", F.col("row_count") * width), F.lit(0.0)), 6).alias("missing_cell_ratio"),
    )


def outliers(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """Rows outside 1.5 interquartile ranges (linear quartiles), with their row id."""
    q1, q3 = exact_quantiles(df, {column: [0.25, 0.75]})[column]
    if q1 is None:
        return df.filter(F.lit(False)).select(row_id, column)
    reach = fixed.OUTLIER_IQR_FACTOR * (q3 - q1)
    return df.filter((F.col(column) < q1 - reach) | (F.col(column) > q3 + reach)).select(row_id, column)


def counter_gaps(df: DataFrame, column: str) -> DataFrame:
    """Number of steps different from 1 between consecutive values, via min, max and distinct count.

    Zero means a gap-free counter; no ordering of the rows is needed.
    """
    facts = df.agg(
        F.count(column).alias("n"), F.count_distinct(column).alias("d"),
        F.min(column).alias("lo"), F.max(column).alias("hi"),
    )
    return facts.select(
        (F.col("n") - F.col("d")).alias("repeats"),
        (F.col("hi") - F.col("lo") + 1 - F.col("d")).alias("holes"),
        ((F.col("n") == F.col("d")) & (F.col("hi") - F.col("lo") + 1 == F.col("d"))).alias("gap_free"),
    )
