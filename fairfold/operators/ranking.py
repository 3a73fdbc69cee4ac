"""Exact ranks and exact quantiles without putting a whole table, group or hot value into one task.

A plain ``row_number().over(Window.orderBy(...))`` moves every row to one task.  Here rows are first
cut into ordered buckets of bounded size, the (small) bucket counts are prefix-summed, and rows are
numbered only inside their own bucket:

* seeded hash orders are uniform, so a hex prefix of the hash is a balanced bucket;
* value orders use approximate quantiles as split points.  A split point that carries many equal
  values becomes a bucket of its own, and that one is cut further by the (unique) tie-breaking id,
  so even a value held by a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 250_000
BROADCAST_ROWS = 1_000_000
MAX_SPLITS = 10_000
FILTERED = 16  # columns whose brackets are a filter
STEPS = 4096  # of a bracket's values, counted together


def bounded_broadcast(df: DataFrame, rows_bound: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when the caller can name an upper bound of the row count within limits."""
    return F.broadcast(df) if rows_bound <= limit else df


def _number_inside(
    df: DataFrame, within: list[str], buckets: list[str], order: list[Column], out: str, bound: int
) -> DataFrame:
    """Row number inside (within, buckets) plus the prefix sum of the preceding buckets."""
    keys = [*within, *buckets]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*within).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    # the window runs over bucket counts (bounded), not over rows
    offsets = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("__rn", F.row_number().over(inside))
    joined = numbered.join(bounded_broadcast(offsets, bound), keys)
    return joined.withColumn(out, (F.col("__rn") + F.col("__before")).cast("long")).drop(
        "__rn", "__before"
    )


def hash_rank(
    df: DataFrame,
    hash_col: str,
    tie: str,
    *,
    n_rows: int,
    within: tuple[str, ...] = (),
    n_groups: int = 1,
    out: str = "rank",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """1-based rank by a hex hash (ties by ``tie``), per ``within`` group or over the whole table."""
    digits = 0
    while digits < 6 and n_rows / 16**digits > rows_per_bucket:
        digits += 1
    order = [F.col(hash_col), F.col(tie)]
    if digits == 0:
        # bounded by rows_per_bucket in total, so one window per group is safe
        return df.withColumn(
            out, F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long")
        )
    bucketed = df.withColumn("__b", F.substring(hash_col, 1, digits))
    bound = min(n_rows, n_groups * 16**digits)
    return _number_inside(bucketed, list(within), ["__b"], order, out, bound).drop("__b")


def value_rank(
    df: DataFrame,
    value: str,
    tie: str,
    *,
    n_rows: int,
    descending: bool = False,
    hex_tie: bool = False,
    out: str = "rank",
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_splits: int = MAX_SPLITS,
) -> DataFrame:
    """1-based rank by ``value`` (unknown first), ties by ``tie``, over the whole table.

    ``value`` must be numeric; it is compared as a double.  ``tie`` is a dense integer id, or a uniform
    hexadecimal text with ``hex_tie``; either is cut into runs where many rows share one value.
    """
    key = F.col(value).cast("double")
    key = F.nanvl(-key if descending else key, F.lit(math.inf))
    work = df.withColumn("__v", key)
    order = [F.col("__v").asc_nulls_first(), F.col(tie)]
    if n_rows <= rows_per_bucket:
        ranked = work.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long"))
        return ranked.drop("__v")
    parts = min(max_splits, math.ceil(n_rows / rows_per_bucket) * 2)
    # the extremes are split points too, so nothing lies outside the outer ones
    points = work.stat.approxQuantile("__v", [i / parts for i in range(parts + 1)], 0.25 / parts)
    edges = [-math.inf, *sorted({p for p in points if abs(p) != math.inf}), math.inf]
    if len(edges) < 3:
        edges = [-math.inf, 0.0, math.inf]
    # beyond the affordable number of split points, an interval is subdivided evenly by value
    finer = max(1, math.ceil(n_rows / (parts * rows_per_bucket)))
    if hex_tie:
        digits = 1
        while digits < 6 and n_rows / 16**digits > rows_per_bucket:
            digits += 1
        run, runs = F.substring(tie, 1, digits), 16**digits
    else:
        run = F.lpad(F.floor(F.col(tie) / F.lit(rows_per_bucket)).cast("string"), 19, "0")
        runs = 1 + n_rows // rows_per_bucket
    cut = Bucketizer(splits=edges, inputCol="__v", outputCol="__k", handleInvalid="keep")
    bounds = F.array(*[F.lit(float(e)) for e in edges])
    # an unknown value has no bucket; it must come first, in a bucket of its own
    at = F.coalesce(F.col("__k"), F.lit(0.0)).cast("int")
    rows = cut.transform(work).withColumn("__low", F.get(bounds, at)).withColumn("__high", F.get(bounds, at + 1))
    single = F.col("__v").isNull() | (F.col("__v") == F.col("__low"))
    inside = F.lit("")
    if finer > 1:
        share = (F.col("__v") - F.col("__low")) / (F.col("__high") - F.col("__low"))
        inside = F.lpad(F.coalesce(F.floor(share * finer), F.lit(0)).cast("string"), 12, "0")
    rows = (
        rows.withColumn("__b", F.when(F.col("__v").isNull(), F.lit(-1)).otherwise(at))
        .withColumn("__open", F.when(single, F.lit(0)).otherwise(F.lit(1)))
        .withColumn("__t", F.when(single, run).otherwise(inside))
        .drop("__k", "__low", "__high")
    )
    ranked = _number_inside(rows, [], ["__b", "__open", "__t"], order, out, len(edges) * (runs + finer))
    return ranked.drop("__v", "__b", "__open", "__t")


@dataclass
class _Bracket:
    column: str
    rank: int  # 0-based rank among non-null values
    low: float = -math.inf
    high: float = math.inf
    below: int = 0  # rows below ``low``
    inside: int = 0  # rows from ``low`` to ``high``
    answer: float | None = None

    @property
    def member(self) -> Column:
        value = F.col(self.column).cast("double")
        ok = value.isNotNull()
        if self.low > -math.inf:
            ok = ok & (value >= F.lit(self.low))
        if self.high < math.inf:
            ok = ok & (value <= F.lit(self.high))
        return ok


def _nearest(position: float) -> int:
    return math.floor(position + 0.5)


def _shared(brackets: list[_Bracket]) -> list[list[_Bracket]]:
    """Ranks that still share a bracket are looked for together."""
    groups: dict[tuple[str, float, float], list[_Bracket]] = {}
    for b in brackets:
        groups.setdefault((b.column, b.low, b.high), []).append(b)
    return list(groups.values())


def _cells(df: DataFrame, groups: list[list[_Bracket]]) -> DataFrame:
    """``g, v``: the values inside each group's bracket."""
    cells = [F.when(g[0].member, F.col(g[0].column).cast("double") + F.lit(0.0)) for g in groups]
    # few rows are inside narrow brackets: the others need no array; planning a filter of many columns takes longer than that
    if all(g[0].low > -math.inf for g in groups) and len({g[0].column for g in groups}) <= FILTERED:
        df = df.filter(F.coalesce(*cells, F.lit(None)).isNotNull())
    return df.select(F.posexplode(F.array(*cells)).alias("g", "v")).filter("v is not null")


def _narrow_by_steps(df: DataFrame, brackets: list[_Bracket]) -> None:
    """Rows, least and greatest value of STEPS equal steps per bracket; a wanted rank lies in one of them."""
    groups = _shared(brackets)
    low, span = (F.get(F.array(*[F.lit(f(g[0])) for g in groups]), F.col("g")) for f in (lambda b: b.low, lambda b: b.high - b.low))
    step = F.least(F.floor((F.col("v") - low) / span * F.lit(float(STEPS))), F.lit(STEPS - 1))  # never falls as v grows
    counted = _cells(df, groups).groupBy("g", step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    steps: dict[int, list] = {}
    for r in sorted(counted.collect(), key=lambda r: (r["g"], r["step"])):  # at most STEPS a bracket
        steps.setdefault(r["g"], []).append(r)
    for g, members in enumerate(groups):
        for b in members:
            below = b.below
            for r in steps[g]:
                if b.rank < below + r["n"]:
                    b.low, b.high, b.below, b.inside = r["low"], r["high"], below, r["n"]
                    break
                below += r["n"]


def _narrow_by_sketch(df: DataFrame, brackets: list[_Bracket]) -> None:
    """An approximate percentile brackets every wanted rank; one count of what lies below and inside verifies it."""
    groups = _shared(brackets)
    sketches = []
    for i, members in enumerate(groups):
        shares = []
        for b in members:
            share = (b.rank - b.below + 0.5) / b.inside
            shares += [max(0.0, share - 3e-4), min(1.0, share + 3e-4)]
        value = F.when(members[0].member, F.col(members[0].column).cast("double"))
        sketches.append(F.percentile_approx(value, shares, 10_000).alias(f"q{i}"))
    row = df.agg(*sketches).first()
    found = [(b, row[f"q{i}"][2 * j], row[f"q{i}"][2 * j + 1]) for i, members in enumerate(groups) for j, b in enumerate(members)]
    checks = []
    for i, (b, low, high) in enumerate(found):
        value = F.col(b.column).cast("double")
        checks += [
            F.count_if(value < F.lit(low)).alias(f"b{i}"),
            F.count_if((value >= F.lit(low)) & (value <= F.lit(high))).alias(f"n{i}"),
        ]
    seen = df.agg(*checks).first()
    for i, (b, low, high) in enumerate(found):
        below, inside = seen[f"b{i}"], seen[f"n{i}"]
        if below <= b.rank < below + inside:
            b.low, b.high, b.below, b.inside = low, high, below, inside
        elif b.rank < below:  # approximation missed: keep the side that holds the rank
            b.high, b.inside = low, below - b.below
        else:  # the side above, without the value itself
            above = b.below + b.inside
            b.low, b.below = math.nextafter(high, math.inf), below + inside
            b.inside = above - b.below


def exact_order_statistics(
    df: DataFrame,
    wanted: dict[str, list[int]],
    counts: dict[str, int],
    *,
    final_rows: int = 1_000_000,
) -> dict[str, dict[int, float]]:
    """The exact k-th smallest non-null value of several numeric columns.

    Works by narrowing: counts by equal steps between a column's extremes say which step holds a wanted
    rank and what lies below it, again inside that step while it holds many rows; where steps cut little
    off, an approximate percentile does.  Only when a bracket holds few rows are its values counted one by
    one.  One Spark job per round for all columns together; nothing but counts is collected.
    """
    brackets = [_Bracket(c, r, inside=counts[c]) for c, ranks in wanted.items() for r in ranks if counts[c] > 0]
    bounded: set[str] = set()
    uneven: set[int] = set()  # brackets that equal steps hardly narrow
    for _ in range(8):
        wide = [b for b in brackets if b.inside > final_rows and b.low < b.high]
        if not wide:
            break
        new = sorted({b.column for b in wide} - bounded)
        if new:
            bounded.update(new)
            value = [F.col(c).cast("double") + F.lit(0.0) for c in new]
            row = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(value) for n, f in (("lo", F.min), ("hi", F.max))]).first()
            for i, c in enumerate(new):
                low, high = row[f"lo{i}"], row[f"hi{i}"]
                if math.isfinite(high - low):
                    for b in brackets:
                        if b.column == c:
                            b.low, b.high = low, high
            wide = [b for b in wide if b.low < b.high]
        even = [b for b in wide if math.isfinite(b.high - b.low) and id(b) not in uneven]
        before = {id(b): b.inside for b in even}
        if even:
            _narrow_by_steps(df, even)
            uneven.update(id(b) for b in even if 4 * b.inside > before[id(b)])
        rest = [b for b in wide if id(b) not in before]
        if rest:
            _narrow_by_sketch(df, rest)

    for b in brackets:
        if b.low == b.high:
            b.answer = b.low
    groups = _shared([b for b in brackets if b.answer is None])
    if groups:
        values = _cells(df, groups).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        cumulative = values.withColumn("upto", F.sum("n").over(upto))
        asked = [(g, b) for g, members in enumerate(groups) for b in members]
        targets = df.sparkSession.createDataFrame([(g, k, b.rank - b.below) for k, (g, b) in enumerate(asked)], "g int, k int, target long")
        # each wanted rank falls into exactly one run of equal values
        hits = cumulative.join(F.broadcast(targets), "g").filter("upto > target and upto - n <= target")
        for r in hits.select("k", "v").collect():
            asked[r["k"]][1].answer = r["v"]
    answers: dict[str, dict[int, float]] = {}
    for b in brackets:
        answers.setdefault(b.column, {})[b.rank] = b.answer
    return answers


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, list[float]],
    *,
    rule: str = "linear",
    counts: dict[str, int] | None = None,
    final_rows: int = 1_000_000,
) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns; ``rule`` is ``linear`` or ``nearest``."""
    if counts is None:
        row = df.agg(*[F.count(F.col(c)).alias(c) for c in columns]).first()
        counts = {c: row[c] for c in columns}
    wanted: dict[str, set[int]] = {}
    for c, probabilities in columns.items():
        for p in probabilities:
            position = p * (counts[c] - 1)
            ranks = {_nearest(position)} if rule == "nearest" else {math.floor(position), math.ceil(position)}
            wanted.setdefault(c, set()).update(ranks if counts[c] else set())
    stats = exact_order_statistics(
        df, {c: sorted(r) for c, r in wanted.items()}, counts, final_rows=final_rows
    )
    result: dict[str, list[float | None]] = {}
    for c, probabilities in columns.items():
        values: list[float | None] = []
        for p in probabilities:
            if not counts[c]:
                values.append(None)
                continue
            position = p * (counts[c] - 1)
            if rule == "nearest":
                values.append(stats[c][_nearest(position)])
            else:
                low, high = stats[c][math.floor(position)], stats[c][math.ceil(position)]
                values.append(low + (high - low) * (position - math.floor(position)))
        result[c] = values
    return result
