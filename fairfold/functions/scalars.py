"""Scalar expressions. All of them stay inside the JVM except Unicode normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairfold.spec import FeatureKinds

FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NON_ASCII = r"[^\x00-\x7F]"
NUMERIC = (*FLOATING, *INTEGRAL, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def label_text(column: Column | str, dtype: T.DataType) -> Column:
    """Canonical label: booleans become ``True``/``False``, everything else its string form."""
    column = F.col(column) if isinstance(column, str) else column
    text = column.cast("string")
    return F.initcap(text) if isinstance(dtype, T.BooleanType) else text


def moment(column: Column | str, dtype: T.DataType) -> Column:
    """A timestamp from a temporal or a string column; unparsable text is unknown, never an error."""
    column = F.col(column) if isinstance(column, str) else column
    if isinstance(dtype, T.StringType):
        # a year, a clock time or a code of digits is not a date; a clock time would even become today's
        return F.when(F.trim(column).rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(column))
    if isinstance(dtype, T.TimestampNTZType) and SparkSession.active().conf.get("spark.sql.session.timeZone") != "UTC":
        # a moment without a zone is UTC, whatever zone the session shows times in
        return F.convert_timezone(F.lit("UTC"), F.current_timezone(), column).cast("timestamp")
    return column.cast("timestamp")


def moment_micros(column: Column | str, dtype: T.DataType) -> Column:
    return F.unix_micros(moment(column, dtype))


def calendar_parts(column: Column | str, dtype: T.DataType) -> dict[str, Column]:
    """Calendar parts of a date; Monday is 0 and the epoch part is fractional days."""
    instant = moment(column, dtype)
    plain = F.col(column) if isinstance(column, str) else column
    ts = plain if isinstance(dtype, T.TimestampNTZType) else instant
    return {
        "year": F.year(ts).cast("double"),
        "month": F.month(ts).cast("double"),
        "day": F.day(ts).cast("double"),
        "dayofweek": F.weekday(ts).cast("double"),
        "quarter": F.quarter(ts).cast("double"),
        "epoch_days": F.unix_micros(instant) / F.lit(86_400_000_000.0),
    }


def plain_float(column: Column) -> Column:
    """One zero and one NaN: adding 0.0 turns -0.0 into 0.0."""
    value = column.cast("double")
    return F.when(F.isnan(value), F.lit(float("nan"))).otherwise(value + F.lit(0.0))


def plain_decimal(column: Column) -> Column:
    """Decimal in plain notation without trailing zeros."""
    text = column.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


@F.pandas_udf(T.StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda value: None if value is None else unicodedata.normalize("NFC", value))


def nfc(column: Column) -> Column:
    """Unicode NFC. Only non-ASCII cells are handed to Python; ASCII is already normal."""
    foreign = F.when(column.rlike(NON_ASCII), column)
    return F.coalesce(_compose(foreign), column)


def safe_ratio(numerator: Column, denominator: Column, digits: int = 6) -> Column:
    ratio = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.round(F.coalesce(ratio, F.lit(0.0)), digits)


def not_finite(column: Column) -> Column:
    value = column.cast("double")
    return value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))


def joined_text(columns: list[Column], separator: str = "\x1f", missing: str = "\x00<null>") -> Column:
    """Concatenation in which a missing cell stays visible."""
    return F.concat_ws(separator, *[F.coalesce(c.cast("string"), F.lit(missing)) for c in columns])


def feature_kinds(df: DataFrame, features: tuple[str, ...] | list[str]) -> FeatureKinds:
    """Numeric, datetime or categorical by type, never by name; boolean is categorical."""
    numeric, datetime, categorical = [], [], []
    for name in features:
        dtype = dtype_of(df, name)
        if isinstance(dtype, NUMERIC):
            numeric.append(name)
        elif isinstance(dtype, TEMPORAL):
            datetime.append(name)
        else:
            categorical.append(name)
    return FeatureKinds(tuple(numeric), tuple(datetime), tuple(categorical))


def logical_type(dtype: T.DataType) -> str | None:
    """Ten logical types; anything else is refused rather than coerced."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, INTEGRAL):
        return "integer"
    if isinstance(dtype, FLOATING):
        return "float"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, T.DayTimeIntervalType):
        return "duration"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BinaryType):
        return "binary"
    if dtype.typeName().startswith("time"):
        return "time"
    return None
