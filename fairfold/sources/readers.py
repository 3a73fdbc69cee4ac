"""Reading tables: format by suffix, CSV dialects per file, JSON arrays or lines, ordered parts."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairfold import fixed
from fairfold.session import ensure_checkpoint_dir
from fairfold.sources import quoted
from fairfold.spec import RefusedError

BAD_LINE = "_corrupt_record"


def format_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    suffix = name[name.rfind(".") :] if "." in name else ""
    if suffix not in fixed.FORMATS:
        raise RefusedError("unsupported_format", name)
    return fixed.FORMATS[suffix]


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    kind = format_of(path)
    if kind == "csv":
        if path.lower().endswith(".tsv"):
            options.setdefault("separator", "\t")
        return read_csv(spark, path, **options)
    if kind == "parquet":
        return spark.read.parquet(path)
    return read_json(spark, path)


def _lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Non-blank lines of all files below ``path`` with their file and place in it."""
    return spark.read.option("recursiveFileLookup", "true").option("encoding", encoding).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        # the place inside one block, which one task reads in order
        F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i")).alias("place"),
    ).filter(F.trim("value") != "")


def _json_parts(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files with one value a line, and files that are one document.

    A file is a document if its first line is no whole object or array and most other lines are none either.
    """
    text = F.trim("value")
    whole = (text.startswith("{") & text.endswith("}") | text.startswith("[") & text.endswith("]")) & F.try_parse_json(text).isNotNull()
    facts = _lines(spark, path).select("file", "place", whole.alias("whole")).groupBy("file").agg(
        F.min_by("whole", "place").alias("first"), (2 * F.count_if("whole") >= F.count("*")).alias("most")
    )
    found = facts.select("file", (~F.col("first") & ~F.col("most")).alias("document")).collect()
    return sorted(unquote(r["file"]) for r in found if not r["document"]), sorted(unquote(r["file"]) for r in found if r["document"])


def _json_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    schema = spark.read.option("columnNameOfCorruptRecord", BAD_LINE).json(files).schema
    schema = T.StructType([f for f in schema if f.name != BAD_LINE] + [T.StructField(BAD_LINE, T.StringType())])
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    # a line may also hold a whole array
    one = F.array(F.from_json("value", schema, {"columnNameOfCorruptRecord": BAD_LINE}))
    rows = F.when(F.trim("value").startswith("["), F.from_json("value", T.ArrayType(schema))).otherwise(one)
    return lines.select("file", "value", F.explode_outer(rows).alias("row"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One object per line, or a JSON array of objects spread over many lines; decided file by file.

    A line that is no JSON is no row; ``bad_json_lines`` returns these lines.
    """
    lines, documents = _json_parts(spark, path)
    frames = []
    if lines:
        frames.append(_json_lines(spark, lines).filter(F.col("row").isNotNull() & F.col("row")[BAD_LINE].isNull()).select("row.*").drop(BAD_LINE))
    if documents:
        # a file that is one document cannot be split, so each file is one task here
        frames.append(spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", BAD_LINE).json(documents).drop(BAD_LINE))
    if not frames:
        raise RefusedError("table_unreadable", path)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line`` of lines that are no JSON."""
    lines, _ = _json_parts(spark, path)
    if not lines:
        return spark.createDataFrame([], "file string, line string")
    bad = F.col("row").isNull() | F.col("row")[BAD_LINE].isNotNull()
    return _json_lines(spark, lines).filter(bad).select("file", F.col("value").alias("line"))


def file_facts(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, delimiter, header, breaks) for every file below ``path``, from all its lines in one pass.

    The delimiter that splits the lines of a file most evenly wins, then the one that splits more; the
    default is a comma.  ``breaks`` says that a quoted cell goes over several lines: some line holds an
    odd number of quotes.
    """
    plain = F.regexp_replace("value", '"[^"]*"', "")
    counts = [(F.length(plain) - F.length(F.replace(plain, F.lit(x)))).alias(f"n{i}") for i, x in enumerate(fixed.DELIMITERS)]
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1
    facts = _lines(spark, path, encoding).select("file", "value", "place", odd.alias("odd"), *counts).groupBy("file").agg(
        F.min_by("value", "place").alias("header"), F.max("odd").alias("breaks"),
        *[f(f"n{i}").alias(f"{n}{i}") for i in range(len(counts)) for f, n in ((F.avg, "mean"), (F.stddev_pop, "spread"))],
    )
    ranked = F.array_max(F.array(*[
        F.struct(
            (F.col(f"mean{i}") > 0).alias("found"), (-F.try_divide(f"spread{i}", f"mean{i}")).alias("even"), F.col(f"mean{i}").alias("mean"),
            F.lit(-i).alias("i"), F.lit(x).alias("delimiter"),
        )
        for i, x in enumerate(fixed.DELIMITERS)
    ]))
    return facts.withColumn("b", ranked).select(
        "file", F.when(F.col("b.found"), F.col("b.delimiter")).otherwise(",").alias("delimiter"), "header", "breaks"
    )


def sniff_dialects(spark: SparkSession, path: str) -> DataFrame:
    """(file, delimiter) for every file below ``path``."""
    return file_facts(spark, path).select("file", "delimiter")


def _wider(kinds: list[T.DataType], exact: bool) -> T.DataType:
    """One type that holds the cells of all groups of files; text where nothing else does.

    ``exact`` says that all long values are below 2^53, so that a double holds them.
    """
    if not kinds:
        return T.StringType()
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    held = {type(k) for k in kinds}
    if held <= {T.IntegerType, T.LongType}:
        return T.LongType()
    if held <= {T.IntegerType, T.LongType, T.DecimalType}:
        return T.DecimalType(38, max(k.scale for k in kinds if isinstance(k, T.DecimalType)))
    if held <= {T.IntegerType, T.LongType, T.DoubleType} and exact:
        return T.DoubleType()
    return T.StringType()


def _common_types(groups: list[tuple[DataFrame, T.StructType]]) -> dict[str, T.DataType]:
    """The type of every column over groups of files (frame, inferred schema).

    Only where groups disagree, their cells are looked at again: a column without any cell in a group has
    no say, and long values next to doubles must fit into them.
    """
    kinds: dict[str, list[T.DataType]] = {}
    for _, schema in groups:
        for f in schema:
            kinds.setdefault(f.name, []).append(f.dataType)
    split = {c for c, k in kinds.items() if any(x != k[0] for x in k)}
    said: dict[str, list[T.DataType]] = {c: [] if c in split else k for c, k in kinds.items()}
    exact = dict.fromkeys(kinds, True)
    for frame, schema in groups:
        asked = [f for f in schema if f.name in split]
        if not asked:
            continue
        cells = [F.count(F.col(f"`{f.name}`")) for f in asked]
        most = [F.max(F.greatest(F.col(f"`{f.name}`"), -F.col(f"`{f.name}`"))) if isinstance(f.dataType, T.LongType) else F.lit(None) for f in asked]
        row = frame.agg(*[x.alias(f"c{i}") for i, x in enumerate(cells + most)]).first()
        for i, f in enumerate(asked):
            if row[i]:
                said[f.name].append(f.dataType)
                exact[f.name] &= row[len(asked) + i] is None or 0 <= row[len(asked) + i] < 2**53
    return {c: _wider(said[c], exact[c]) for c in kinds}


def read_csv(spark: SparkSession, path: str, *, separator: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file, or a folder of them in several dialects, as one table; cells are matched by header.

    Files with one delimiter and header line are read together, each by as many tasks as it has blocks, also
    those with line breaks in quoted cells (see ``quoted``); only files in encodings of several bytes a
    character or with lone carriage returns are then one task each.  A quote inside a quoted cell is
    doubled.  Types come from all rows of all files: a column with a cell that is no number is text, long
    integers stay exact (as decimals, or as text next to fractions), files without a cell in a column have no say in its type, so no
    cell gets lost by its type.  Cells beyond the header's are cut off, missing ones are NULL.
    """
    groups: dict[tuple, list[str]] = {}
    # one entry per file, like the file listing the driver holds anyway
    for r in file_facts(spark, path, encoding).collect():
        groups.setdefault((separator or r["delimiter"], r["header"], r["breaks"]), []).append(unquote(r["file"]))
    if not groups:
        raise RefusedError("table_unreadable", path)
    readers = []
    for (delimiter, _, breaks), files in sorted(groups.items()):
        serial = files
        if breaks and not encoding.upper().startswith(("UTF-16", "UTF-32")):
            serial, split = _by_blocks(spark, files, delimiter, encoding)
            if split:
                readers.append(split)
        if not serial:
            continue

        def reader(delimiter=delimiter, breaks=breaks):
            options = {"header": True, "sep": delimiter, "escape": '"', "encoding": encoding, "multiLine": breaks, "mode": "PERMISSIVE"}
            return spark.read.options(**options)

        def typed(schema, reader=reader, files=serial):
            return reader().schema(schema).csv(files)

        readers.append((typed, reader().option("inferSchema", True).option("prefersDate", True).csv(serial).schema))
    kinds = _common_types([(typed(schema), schema) for typed, schema in readers])
    frames = [typed(T.StructType([T.StructField(f.name, kinds[f.name]) for f in schema])) for typed, schema in readers]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _by_blocks(spark: SparkSession, files: list[str], delimiter: str, encoding: str) -> tuple[list[str], tuple | None]:
    """Files that have to be read serially, and a reader with its schema for the others."""
    ensure_checkpoint_dir(spark)
    size = quoted.block_size(spark)
    states = quoted.block_states(spark, files, delimiter, size, encoding).checkpoint()  # one row a block
    # one entry per file, like the file listing the driver holds anyway
    lone = {unquote(r["file"]) for r in states.groupBy("file").agg(F.max("lone").alias("lone")).where("lone").collect()}
    rest = [f for f in files if f not in lone]
    if not rest:
        return files, None
    # the header's names as Spark makes them; no more than the first record of a file is read for them
    named = spark.read.options(header=True, sep=delimiter, escape='"', encoding=encoding, multiLine=True).csv(rest[:1]).schema
    rows = quoted.records(spark, rest, delimiter, size, states, encoding).where("start > 0 or place > 0")  # the first one is the header

    def typed(schema):
        return quoted.parsed(rows, schema, delimiter)

    return sorted(lone), (typed, quoted.infer_types(typed(T.StructType([T.StructField(f.name, T.StringType()) for f in named]))))


read_mixed_csv = read_csv


def same_schema(spark: SparkSession, files: list[str]) -> bool:
    """Whether all parts have the names, order and types of the first; reads footers only."""
    try:
        first = [(f.name, f.dataType) for f in spark.read.parquet(files[0]).schema]
        return all([(f.name, f.dataType) for f in spark.read.parquet(p).schema] == first for p in files[1:])
    except AnalysisException as error:
        raise RefusedError("package_part_missing", str(error)[:200]) from error


def page(df: DataFrame, row_id: str, offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit - 1 by row id: a filter, not a skip."""
    if int(limit) < 1 or int(offset) < 0:
        raise RefusedError("bad_page", f"{offset}, {limit}")
    limit, offset = int(limit), int(offset)
    return df.filter((F.col(row_id) >= offset) & (F.col(row_id) < offset + limit))
