"""CSV records over several lines, read by as many tasks as the files have blocks.

Whether a line starts inside a quoted cell depends on everything before it.  Each block therefore reports
where it would end under either answer, a prefix over the blocks of a file says which answer holds, and
only records that cross a block's border are put together from their pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the rest of a quoted cell and its closing quote; doubled quotes belong to the cell
CLOSING = re.compile('(?:[^"]|"")*+"')

_PIECE = "file string, start long, place long, opens boolean, closes boolean, record string"


def ends_inside(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a line that starts inside a quoted cell, or outside, ends inside one.

    A quote opens a cell only at the cell's beginning; elsewhere it is a character like others.
    """
    at, opening = 0, delimiter + '"'
    if not inside:
        if line.startswith('"'):
            at = 1
        elif (at := line.find(opening) + len(opening)) < len(opening):
            return False
    while True:
        closed = CLOSING.match(line, at)
        if closed is None:
            return True
        at = line.find(opening, closed.end())
        if at < 0:
            return False
        at += len(opening)


def block_size(spark: SparkSession) -> int:
    """``spark.sql.files.maxPartitionBytes`` in bytes."""
    count, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]?)[a-z]*\s*", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return int(count) << 10 * " kmgtp".index(unit.replace("b", " ") or " ")


def _lines(spark: SparkSession, files: list[str], size: int, encoding: str) -> DataFrame:
    """``file, start, value``: the lines of the files in blocks of ``size`` bytes.

    How a scan cuts files depends on the settings and the number of cores when it is planned.  The states of
    blocks hold for these blocks alone, so the scan gets a session of its own whose settings leave no choice.
    """
    own = spark.newSession()
    for key in ("maxPartitionBytes", "openCostInBytes"):
        own.conf.set(f"spark.sql.files.{key}", str(size))
    text = own.read.option("lineSep", "\n").option("encoding", encoding).text(files)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    # united with nothing, it is a table of the caller's session
    lines = spark.createDataFrame([], "file string, start long, value string").union(lines)
    known = F.when(F.col("start") % F.lit(size) == 0, F.col("start")).otherwise(F.raise_error(F.lit("a file was cut elsewhere than at its blocks")).cast("long"))
    return lines.select("file", known.alias("start"), "value")


def _answers(delimiter: str):
    """One row per block: whether it ends inside a cell if it starts outside or inside, and if it holds a lone carriage return."""

    def answers(batches: Iterable[pa.RecordBatch]):
        block, ends, lone = None, [False, True], False
        for batch in batches:
            # a task reads a block's lines one after the other
            for file, start, value, other in zip(*(batch[c].to_pylist() for c in ("file", "start", "value", "lone")), strict=True):
                if (file, start) != block:
                    if block:
                        yield _block_row(block, ends, lone)
                    block, ends, lone = (file, start), [False, True], False
                lone |= other
                if value is not None:
                    first = ends_inside(value, ends[0], delimiter)
                    ends = [first, first if ends[0] == ends[1] else ends_inside(value, ends[1], delimiter)]
        if block:
            yield _block_row(block, ends, lone)

    return answers


def _block_row(block: tuple[str, int], ends: list[bool], lone: bool) -> pa.RecordBatch:
    row = {"file": block[0], "start": block[1], "outside": ends[0], "inside": ends[1], "lone": lone}
    return pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.string()), ("start", pa.int64()), *((c, pa.bool_()) for c in ("outside", "inside", "lone"))]))


def block_states(spark: SparkSession, files: list[str], delimiter: str, size: int, encoding: str = "UTF-8") -> DataFrame:
    """``file, start, starts_inside, lone`` for every block of the files.

    A block either ends in the same state whatever came before, or keeps the state, or turns it.  So the
    state before a block is that of the last block of the first kind, turned as often as blocks since then
    turn it.
    """
    lines = _lines(spark, files, size, encoding)
    quote = F.when(F.contains("value", F.lit('"')), F.col("value"))  # other lines change nothing
    asked = lines.select("file", "start", quote.alias("value"), F.col("value").rlike("\r.").alias("lone"))
    blocks = asked.mapInArrow(_answers(delimiter), "file string, start long, outside boolean, inside boolean, lone boolean")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.col("outside") == F.col("inside")
    turned = blocks.withColumn("turned", F.sum((F.col("outside") & ~F.col("inside")).cast("int")).over(until))
    turns = F.coalesce(F.last("turned").over(before), F.lit(0)) - F.coalesce(F.last(F.when(fixed, F.col("turned")), True).over(before), F.lit(0))
    state = F.coalesce(F.last(F.when(fixed, F.col("outside")), True).over(before), F.lit(False))
    return turned.select("file", "start", (state != (turns % 2 == 1)).alias("starts_inside"), "lone")


def _pieces(delimiter: str):
    """Lines with their block's state: whole records, and the pieces of those that cross the block's borders."""

    names, kinds = ("file", "start", "place", "opens", "closes", "record"), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema)

    def pieces(batches: Iterable[pa.RecordBatch]):
        block, place, inside, opens, held = None, 0, False, True, []
        out: list[tuple] = []

        def add(closes: bool):
            nonlocal place
            out.append((*block, place, opens, closes, "\n".join(held)))
            place += 1

        for batch in batches:
            for file, start, value, first in zip(*(batch[c].to_pylist() for c in ("file", "start", "value", "starts_inside")), strict=True):
                if (file, start) != block:
                    if held:
                        add(False)
                    block, place, inside, opens, held = (file, start), 0, first, not first, []
                if inside or value.strip():
                    inside = ends_inside(value, inside, delimiter) if '"' in value else inside
                    held.append(value if inside else value.removesuffix("\r"))
                    if not inside:
                        add(True)
                        opens, held = True, []
            if out:
                yield packed(out)
                out.clear()
        if held:
            add(False)
            yield packed(out)

    return pieces


def records(spark: SparkSession, files: list[str], delimiter: str, size: int, states: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """``file, start, place, record``: the records of the files, header included, blank lines not.

    ``start`` and ``place`` order the records of a file.  Lines end with a line feed, or a carriage return
    and one; those inside a cell are kept as they are.  A cell whose quote is never closed goes on to the
    end of its file, as in a serial read.
    """
    # most blocks start outside; at most one row a block, of which the scan itself keeps a list on the driver
    begun = F.broadcast(states.where("starts_inside").select("file", "start", "starts_inside"))
    lines = _lines(spark, files, size, encoding).join(begun, ["file", "start"], "left")  # broadcast: lines stay in their order
    pieces = lines.select("file", "start", "value", F.coalesce("starts_inside", F.lit(False)).alias("starts_inside")).mapInArrow(_pieces(delimiter), _PIECE)
    # at most two pieces a block
    parts = pieces.where("not (opens and closes)")
    order = Window.partitionBy("file").orderBy("start", "place")
    parts = parts.withColumn("number", F.sum(F.col("opens").cast("int")).over(order))
    joined = parts.groupBy("file", "number").agg(F.min(F.struct("start", "place")).alias("at"), F.array_sort(F.collect_list(F.struct("start", "place", "record"))).alias("parts"))
    # at most one record a block, joined once and kept, so that reading the records is one scan
    crossing = joined.select("file", "at.start", "at.place", F.array_join("parts.record", "\n").alias("record")).checkpoint()
    return pieces.where("opens and closes").select("file", "start", "place", "record").unionByName(crossing)


def parsed(rows: DataFrame, schema: T.StructType, delimiter: str) -> DataFrame:
    """Records (without headers) as columns."""
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    options = {"sep": delimiter, "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    return rows.select(F.from_csv("record", ddl, options).alias("r")).select("r.*")


def infer_types(cells: DataFrame) -> T.StructType:
    """The narrowest type that holds all cells of each text column: integer, long, decimal, double, date, timestamp, boolean or text.

    One aggregate over all rows, no sample.  A column without any cell is text.
    """
    kinds = []
    for name in cells.columns:
        c = F.col(f"`{name.replace('`', '``')}`")
        whole = c.rlike(r"^[+-]?[0-9]{1,38}$")
        number = c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
        size = F.max(F.abs(F.when(whole, c.try_cast("decimal(38,0)"))))
        day = c.rlike(r"^\d{4}-\d\d-\d\d$") & c.try_cast("date").isNotNull()
        moment = c.rlike(r"^\d{4}-\d\d-\d\d") & c.try_cast("timestamp").isNotNull()
        kinds.append(F.struct(
            F.count(c).alias("n"), F.count_if(whole).alias("whole"), F.count_if(number).alias("number"), size.alias("size"), F.count_if(day).alias("day"),
            F.count_if(moment).alias("moment"), F.count_if(F.lower(c).isin("true", "false")).alias("truth"),
        ))
    row = cells.agg(*[k.alias(f"c{i}") for i, k in enumerate(kinds)]).first() if kinds else ()
    return T.StructType([T.StructField(name, _type_of(facts)) for name, facts in zip(cells.columns, row, strict=True)])


def _type_of(facts) -> T.DataType:
    n = facts["n"]
    if not n:
        return T.StringType()
    if facts["whole"] == n:
        return T.IntegerType() if facts["size"] < 2**31 else T.LongType() if facts["size"] < 2**63 else T.DecimalType(38, 0)
    for kind, held in ((T.DoubleType(), "number"), (T.DateType(), "day"), (T.TimestampType(), "moment"), (T.BooleanType(), "truth")):
        if facts[held] == n:
            return kind
    return T.StringType()
