"""Preprocessing fitted on training rows only, expressed as plain Spark ML stages.

Fitting takes a few aggregations over the training side; the fitted result is SQL projections, string
indexers and an assembler, so it can be saved inside a ``PipelineModel`` and runs inside codegen.

Four profiles: ``scaled_onehot``, ``tree_ordinal``, ``native_missing``, ``passthrough_dummy``.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass
from threading import Lock
from typing import Any

from pyspark.ml import Transformer
from pyspark.ml.feature import SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairfold import fixed
from fairfold.functions.scalars import dtype_of, feature_kinds
from fairfold.operators.profile import long_cells
from fairfold.operators.ranking import exact_quantiles
from fairfold.session import ensure_checkpoint_dir
from fairfold.spec import RefusedError

MISSING_NUMBER = -999_999.0
MAX_VOCABULARY = 10_000  # beyond this an ordinal vocabulary is no longer a small model


class Once:
    """Results made by the first thread that asks and given to all others."""

    def __init__(self) -> None:
        self._lock, self._made = Lock(), {}

    def __call__(self, key: str, make: Callable[[], Any]) -> Any:
        with self._lock:
            first = key not in self._made
            result = self._made.setdefault(key, Future())
        if first:
            try:
                result.set_result(make())
            except BaseException as error:
                result.set_exception(error)
        return result.result()


@dataclass(frozen=True)
class FittedRecipe:
    stages: list[Transformer]
    inputs: list[str]  # names of the assembled columns, in order

    def prepare(self, df: DataFrame) -> DataFrame:
        """Everything but the assembler: one plain column per encoded feature."""
        for stage in self.stages[:-1]:
            df = stage.transform(df)
        return df


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_number(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text_sql(name: str, dtype: T.DataType) -> str:
    text = f"CAST({_quoted(name)} AS STRING)"
    return f"initcap({text})" if isinstance(dtype, T.BooleanType) else text


def _numbers(df: DataFrame, features: tuple[str, ...]) -> dict[str, str]:
    """SQL of every numeric input: numbers as they are, dates as calendar parts; NaN is missing."""
    kinds = feature_kinds(df, features)
    numbers = {
        name: f"nullif(CAST({_quoted(name)} AS DOUBLE), CAST('NaN' AS DOUBLE))" for name in kinds.numeric
    }
    for name in kinds.datetime:
        ts = f"CAST({_quoted(name)} AS TIMESTAMP)"
        parts = (
            f"year({ts})", f"month({ts})", f"day({ts})", f"weekday({ts})", f"quarter({ts})",
            f"(unix_micros({ts}) / 86400000000D)",
        )
        for part, sql in zip(fixed.DATETIME_PARTS, parts, strict=True):
            numbers[f"{name}__{part}"] = f"CAST({sql} AS DOUBLE)"
    return numbers


@dataclass(frozen=True)
class NumberFit:
    median: float
    mean: float
    std: float


def fit_numbers(df: DataFrame, numbers: dict[str, str]) -> dict[str, NumberFit]:
    """Median, then mean and population std after imputation, for all columns together.

    Imputing a constant changes moments in closed form, so the table is not scanned again for them.
    """
    if not numbers:
        return {}
    names = list(numbers)
    values = df.select(*[F.expr(sql).alias(f"v{i}") for i, sql in enumerate(numbers.values())])
    measures = [F.count(F.lit(1)).alias("n")]
    for i in range(len(names)):
        measures += [F.count(f"v{i}").alias(f"n{i}"), F.avg(f"v{i}").alias(f"m{i}"), F.var_pop(f"v{i}").alias(f"s{i}")]
    row = values.agg(*measures).first()
    counts = {f"v{i}": row[f"n{i}"] for i in range(len(names))}
    medians = exact_quantiles(values, {f"v{i}": [0.5] for i in range(len(names))}, counts=counts)
    fits = {}
    for i, name in enumerate(names):
        present, total = row[f"n{i}"], row["n"]
        if not present:
            fits[name] = NumberFit(0.0, 0.0, 0.0)
            continue
        median = medians[f"v{i}"][0]
        mean = (present * row[f"m{i}"] + (total - present) * median) / total
        var = (present * (row[f"s{i}"] + (row[f"m{i}"] - mean) ** 2) + (total - present) * (median - mean) ** 2) / total
        fits[name] = NumberFit(float(median), float(mean), float(var) ** 0.5)
    return fits


@dataclass(frozen=True)
class CategoryFit:
    mode: str | None
    frequent: tuple[str, ...]  # categories with a column of their own, in text order
    rest: bool  # whether an infrequent column exists
    vocabulary: tuple[str, ...]  # every category in text order, for ordinal codes


def count_categories(df: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, int]:
    """``column, text, n`` of all categories, kept because it is read several times, and the number of rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return long_cells(df, list(columns)).groupBy("column", "text").agg(F.count(F.lit(1)).alias("n")).checkpoint(), df.count()


def fit_categories(
    df: DataFrame, columns: tuple[str, ...], *, ordinal: bool, counted: tuple[DataFrame, int] | None = None
) -> dict[str, CategoryFit]:
    """Mode (smallest on ties) and the kept categories of each column.

    A category keeps its own column when it occurs at least twice; if that would make more than 50
    columns together with the infrequent one, only the 49 most frequent do.
    """
    if not columns:
        return {}
    counts, total = counted or count_categories(df, columns)
    facts = {
        r["column"]: r
        for r in counts.groupBy("column").agg(
            F.count(F.lit(1)).alias("levels"), F.sum("n").alias("present"),
            F.min_by("text", F.struct(-F.col("n"), F.col("text"))).alias("mode"),
            F.count_if(F.col("n") >= fixed.MIN_CATEGORY_FREQUENCY).alias("repeated"),
        ).collect()
    }
    if ordinal:
        for name, r in facts.items():
            if r["levels"] > MAX_VOCABULARY:
                raise RefusedError("vocabulary_too_large", f"{name}: {r['levels']} categories")
    keep = MAX_VOCABULARY if ordinal else fixed.MAX_CATEGORIES
    # the imputed cells count for the mode before frequencies are compared
    lifts = F.create_map(*[
        x for name, r in facts.items() for x in (F.lit(f"{name}\x1f{r['mode']}"), F.lit(total - r["present"]))
    ]) if facts else None
    listed: dict[str, list[tuple[str, int]]] = {}
    if facts:
        lift = F.coalesce(F.try_element_at(lifts, F.concat_ws("\x1f", "column", "text")), F.lit(0))
        order = Window.partitionBy("column").orderBy(F.desc("n"), F.desc("text"))
        top = counts.withColumn("n", F.col("n") + lift).withColumn("place", F.row_number().over(order))
        for r in top.filter(F.col("place") <= keep).orderBy("column", "place").collect():
            listed.setdefault(r["column"], []).append((r["text"], r["n"]))
    fits = {}
    for name in columns:
        if name not in facts:
            fits[name] = CategoryFit(None, (), False, ())
            continue
        r, rows = facts[name], listed[name]
        common = [t for t, n in rows if n >= fixed.MIN_CATEGORY_FREQUENCY]
        if ordinal:
            fits[name] = CategoryFit(r["mode"], (), False, tuple(sorted(t for t, _ in rows)))
            continue
        if len(common) + 1 > fixed.MAX_CATEGORIES:
            common = common[: fixed.MAX_CATEGORIES - 1]
        fits[name] = CategoryFit(r["mode"], tuple(sorted(common)), len(common) < r["levels"], ())
    return fits


def fit_recipe(
    train: DataFrame, features: tuple[str, ...], profile: str, output: str = "features", once: Once | None = None
) -> FittedRecipe:
    """``once`` has what recipes of other profiles found on the same training rows."""
    once = once or Once()
    if profile == "passthrough_dummy":
        return FittedRecipe([], [])
    kinds = feature_kinds(train, features)
    numbers = _numbers(train, features)
    first: list[str] = []
    second: list[str] = []
    inputs: list[str] = []
    if profile == "native_missing":
        for name, sql in numbers.items():
            first.append(f"coalesce({sql}, {sql_number(MISSING_NUMBER)}) AS {_quoted('num__' + name)}")
            first.append(f"CASE WHEN {sql} IS NULL THEN 1D ELSE 0D END AS {_quoted('gap__' + name)}")
            inputs += [f"num__{name}", f"gap__{name}"]
    else:
        for name, fit in once("numbers", lambda: fit_numbers(train, numbers)).items():
            filled = f"coalesce({numbers[name]}, {sql_number(fit.median)})"
            if profile == "scaled_onehot":
                scale = fit.std if fit.std > 0 else 1.0
                filled = f"({filled} - {sql_number(fit.mean)}) / {sql_number(scale)}"
            first.append(f"{filled} AS {_quoted('num__' + name)}")
            inputs.append(f"num__{name}")
    stages: list[Transformer] = []
    counted = once("categories", lambda: count_categories(train, kinds.categorical)) if kinds.categorical else None
    fits = fit_categories(train, kinds.categorical, ordinal=profile != "scaled_onehot", counted=counted)
    indexed: list[tuple[str, CategoryFit, tuple[str, ...]]] = []
    for name, fit in fits.items():
        if fit.mode is None:
            continue
        words = fit.frequent if profile == "scaled_onehot" else fit.vocabulary
        text = _text_sql(name, dtype_of(train, name))
        first.append(f"coalesce({text}, {sql_text(fit.mode)}) AS {_quoted('text__' + name)}")
        indexed.append((name, fit, words))
        code, unknown = _quoted("code__" + name), len(words)
        if profile == "scaled_onehot":
            for i, word in enumerate(words):
                column = f"cat__{name}__{i}"
                second.append(f"CASE WHEN {code} = {i} THEN 1D ELSE 0D END AS {_quoted(column)}")
                inputs.append(column)
            if fit.rest:
                second.append(f"CASE WHEN {code} = {unknown} THEN 1D ELSE 0D END AS {_quoted('cat__' + name + '__rest')}")
                inputs.append(f"cat__{name}__rest")
        else:
            second.append(
                f"CASE WHEN {code} = {unknown} THEN {sql_number(fixed.UNKNOWN_ORDINAL)} ELSE {code} END AS {_quoted('ord__' + name)}"
            )
            inputs.append(f"ord__{name}")
    if first:
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(first) + " FROM __THIS__"))
    with_words = [(n, w) for n, _, w in indexed if w]
    if with_words:
        indexer = StringIndexerModel.from_arrays_of_labels(
            [list(w) for _, w in with_words], inputCols=[f"text__{n}" for n, _ in with_words],
            outputCols=[f"code__{n}" for n, _ in with_words], handleInvalid="keep",
        )
        stages.append(indexer)
    wordless = [n for n, _, w in indexed if not w]
    if wordless:
        zero = ", ".join(f"0D AS {_quoted('code__' + n)}" for n in wordless)
        stages.append(SQLTransformer(statement=f"SELECT *, {zero} FROM __THIS__"))
    if second:
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(second) + " FROM __THIS__"))
    if not inputs:
        raise RefusedError("no_usable_features")
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="keep"))
    return FittedRecipe(stages, inputs)
