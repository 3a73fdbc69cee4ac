"""Holdout and folds: built once, shared by every contender.

The result is one row per usable row: ``row_id, part (holdout | pool), chunk``.  Who trains whom is a
predicate over ``chunk`` and never stored k times:

* K-fold families: fold f validates on chunk f and trains on every other chunk of the pool;
* forward chaining: fold f validates on chunk f + 1 and trains on all chunks before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairfold import fixed
from fairfold.functions.ordering import seeded_hash
from fairfold.functions.scalars import dtype_of, label_text, moment_micros
from fairfold.operators.ranking import ROWS_PER_BUCKET, bounded_broadcast, hash_rank, value_rank
from fairfold.operators.task import usable
from fairfold.session import ensure_checkpoint_dir
from fairfold.spec import Protocol, RefusedError, TaskSpec

HOT_SHARE = 1_000  # a group above 1/1000 of all rows is hot; there can be at most 1000 of them


def equal_chunk(position: Column, n: int, k: int) -> Column:
    """Chunk of a 0-based position when n rows are cut into k parts, the first n mod k one larger."""
    size, longer = divmod(n, k)
    edge = longer * (size + 1)
    tail = F.lit(longer) + F.floor((position - edge) / F.lit(max(size, 1)))
    if longer == 0:
        return tail.cast("int")
    return F.when(position < edge, F.floor(position / F.lit(size + 1))).otherwise(tail).cast("int")


def serpentine(position: Column, k: int) -> Column:
    """0..k-1, then back from k-1 to 0, and so on: neighbours in size end up in different chunks."""
    phase = position % (2 * k)
    return F.when(phase < k, phase).otherwise(2 * k - 1 - phase).cast("int")


def holdout_quotas(counts: dict[str, int], size: float) -> dict[str, int]:
    """Rows of each class for the holdout: floors first, then the largest remainders (ties by label)."""
    total = sum(counts.values())
    quotas = {c: math.floor(size * n) for c, n in counts.items()}
    spare = math.ceil(size * total) - sum(quotas.values())
    by_remainder = sorted(counts, key=lambda c: (-(size * counts[c] - quotas[c]), c))
    for c in by_remainder[:spare]:
        quotas[c] += 1
    return quotas


def _literal_map(values: dict[str, int]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def group_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(fixed.NULL_GROUP))


def assign(
    df: DataFrame,
    spec: TaskSpec,
    protocol: Protocol,
    *,
    keep: tuple[str, ...] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """row_id, part, chunk (NULL in the holdout) and the ``keep`` columns for every usable row.

    Columns in ``keep`` travel along, which spares a later join of the whole table by row id.
    """
    rows = usable(df, spec.target)
    carried = [F.col(c) for c in dict.fromkeys(keep) if c != spec.row_id]
    base = rows.select(F.col(spec.row_id).alias("row_id"), *carried)
    label = label_text(spec.target, dtype_of(df, spec.target))
    k = protocol.n_splits

    if protocol.holdout == "group" or protocol.splitter in ("group_k_fold", "stratified_group_k_fold"):
        return _by_group(rows, spec, protocol, carried, label, rows_per_bucket)

    n = rows.count()
    if n < k + 1:
        raise RefusedError("too_few_rows", f"{n} rows for {k} folds")

    if protocol.holdout == "temporal" or protocol.forward:
        if not spec.time:
            raise RefusedError("time_column_missing")
        timed = rows.select(
            F.col(spec.row_id).alias("row_id"), *carried,
            moment_micros(spec.time, dtype_of(df, spec.time)).cast("double").alias("__ts"),
        )
        ranked = value_rank(timed, "__ts", "row_id", n_rows=n, out="__rank", rows_per_bucket=rows_per_bucket).drop("__ts")
        held = max(1, round(n * protocol.holdout_size))
        held_out = F.col("__rank") > n - held
        pool_rows = n - held
        if protocol.forward:
            chunk = equal_chunk(F.col("__rank") - 1, pool_rows, k + 1)
            return _finish(ranked, held_out, chunk)
        # too few periods for forward chaining: the tail is held out, the pool is cut at random
        pool = ranked.filter(~held_out).drop("__rank").withColumn(
            "__h", seeded_hash(protocol.seed, "order", F.col("row_id"))
        )
        pool = hash_rank(pool, "__h", "row_id", n_rows=pool_rows, out="__rank", rows_per_bucket=rows_per_bucket).drop("__h")
        cut = _finish(pool, F.lit(False), equal_chunk(F.col("__rank") - 1, pool_rows, k))
        late = _finish(ranked.filter(held_out), F.lit(True), F.lit(None).cast("int"))
        return cut.unionByName(late)

    hashed = base.withColumn("__h", seeded_hash(protocol.seed, "order", F.col("row_id")))
    if protocol.holdout == "stratified" or protocol.splitter == "stratified_k_fold":
        counted = rows.groupBy(label.alias("c")).agg(F.count(F.lit(1)).alias("n")).limit(fixed.MAX_CLASSES_ALLOWED + 1)
        counts = {r["c"]: r["n"] for r in counted.collect()}
        if len(counts) > fixed.MAX_CLASSES_ALLOWED:
            raise RefusedError("too_many_classes", spec.target)
        quotas = holdout_quotas(counts, protocol.holdout_size)
        starts, before = {}, 0
        for c in sorted(counts):
            starts[c] = before % k
            before += counts[c] - quotas[c]
        hashed = rows.select(
            F.col(spec.row_id).alias("row_id"), *carried, label.alias("__c"),
            seeded_hash(protocol.seed, "order", F.col(spec.row_id)).alias("__h"),
        )
        ranked = hash_rank(
            hashed, "__h", "row_id", n_rows=n, within=("__c",), n_groups=len(counts), out="__rank",
            rows_per_bucket=rows_per_bucket,
        )
        quota = F.element_at(_literal_map(quotas), F.col("__c"))
        start = F.element_at(_literal_map(starts), F.col("__c"))
        # one random order per class serves both cuts: its head is held out, the rest is dealt to folds
        chunk = ((F.col("__rank") - quota - 1 + start) % k).cast("int")
        return _finish(ranked, F.col("__rank") <= quota, chunk).drop("__c", "__h")

    held = math.ceil(protocol.holdout_size * n)
    ranked = hash_rank(hashed, "__h", "row_id", n_rows=n, out="__rank", rows_per_bucket=rows_per_bucket).drop("__h")
    chunk = equal_chunk(F.col("__rank") - held - 1, n - held, k)
    return _finish(ranked, F.col("__rank") <= held, chunk)


def _finish(ranked: DataFrame, held_out: Column, chunk: Column) -> DataFrame:
    return (
        ranked.withColumn("part", F.when(held_out, "holdout").otherwise("pool"))
        .withColumn("chunk", F.when(~held_out, chunk).cast("int"))
        .drop("__rank")
    )


def group_plan(
    rows: DataFrame, spec: TaskSpec, protocol: Protocol, label: Column, rows_per_bucket: int = ROWS_PER_BUCKET
) -> tuple[DataFrame, int, int]:
    """One row per entity: ``g, n, part, chunk``; entities stay whole."""
    g = group_text(spec.group)
    stratified = protocol.splitter == "stratified_group_k_fold"
    if stratified:
        cells = rows.groupBy(g.alias("g"), label.alias("c")).agg(F.count(F.lit(1)).alias("m"))
        groups = cells.groupBy("g").agg(
            F.sum("m").alias("n"), F.min_by("c", F.struct(-F.col("m"), F.col("c"))).alias("c")
        )
    else:
        groups = rows.groupBy(g.alias("g")).agg(F.count(F.lit(1)).alias("n")).withColumn("c", F.lit(""))
    # one slim row per entity, ranked twice below: worth one scan of the table instead of several
    ensure_checkpoint_dir(rows.sparkSession)
    groups = groups.checkpoint()
    facts = groups.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows")).first()
    n_groups, n_rows = facts["groups"], facts["rows"] or 0
    if n_rows < protocol.n_splits + 1:
        raise RefusedError("too_few_rows", f"{n_rows} rows for {protocol.n_splits} folds")
    groups = groups.withColumn("h", seeded_hash(protocol.seed, "group", F.col("g")))
    held = math.ceil(protocol.holdout_size * n_groups)
    groups = hash_rank(groups, "h", "g", n_rows=n_groups, out="hr", rows_per_bucket=rows_per_bucket)
    pool = groups.filter(F.col("hr") > held)
    # strata in label order, larger entities first, equal sizes in hash order
    stratum = F.lit(0.0)
    if stratified:
        for i, c in enumerate(spec.labels):
            stratum = F.when(F.col("c") == c, float(i) * 2.0**40).otherwise(stratum)
    pool = value_rank(
        pool.withColumn("size_order", stratum - F.col("n")), "size_order", "h", n_rows=n_groups - held,
        hex_tie=True, rows_per_bucket=rows_per_bucket,
    )
    plan = pool.select("g", "n", F.lit("pool").alias("part"), serpentine(F.col("rank") - 1, protocol.n_splits).alias("chunk"))
    out = groups.filter(F.col("hr") <= held).select(
        "g", "n", F.lit("holdout").alias("part"), F.lit(None).cast("int").alias("chunk")
    )
    return plan.unionByName(out), n_groups, n_rows


def _by_group(rows, spec, protocol, carried, label, rows_per_bucket) -> DataFrame:
    if not spec.group:
        raise RefusedError("group_column_missing")
    plan, n_groups, n_rows = group_plan(rows, spec, protocol, label, rows_per_bucket)
    plan = plan.withColumnsRenamed({"g": "__g", "n": "__n"})
    slim = rows.select(F.col(spec.row_id).alias("row_id"), *carried, group_text(spec.group).alias("__g"))
    if n_groups <= 1_000_000:
        joined = slim.join(bounded_broadcast(plan, n_groups), "__g")
    else:
        joined = attach_by_group(slim, plan, n_rows)
    return joined.select("row_id", *[c for c in slim.columns if c not in ("row_id", "__g")], "part", "chunk")


def attach_by_group(rows: DataFrame, plan: DataFrame, n_rows: int) -> DataFrame:
    """Join rows with their entity's plan without sending a hot entity to one task.

    Entities above one thousandth of all rows number at most a thousand, so they are broadcast; the
    remaining ones are small by definition and are joined by shuffling.
    """
    hot = F.broadcast(plan.filter(F.col("__n") * HOT_SHARE > n_rows))
    hot_rows = rows.join(hot, "__g")
    cold = plan.filter(F.col("__n") * HOT_SHARE <= n_rows)
    cold_rows = rows.join(hot.select("__g"), "__g", "left_anti").join(cold, "__g")
    return hot_rows.unionByName(cold_rows)


# --- who trains whom -------------------------------------------------------------------------------


def train_of(fold: int, protocol: Protocol) -> Column:
    pool = F.col("part") == "pool"
    return pool & (F.col("chunk") <= fold if protocol.forward else F.col("chunk") != fold)


def validation_of(fold: int, protocol: Protocol) -> Column:
    return (F.col("part") == "pool") & (F.col("chunk") == (fold + 1 if protocol.forward else fold))


def validation_fold(protocol: Protocol) -> Column:
    """Fold a pool row is validated in; NULL for the first period under forward chaining."""
    chunk = F.col("chunk")
    return F.when(chunk > 0, chunk - 1) if protocol.forward else chunk


def training_folds(protocol: Protocol) -> Column:
    """Folds a pool row trains in, as an array."""
    every = F.sequence(F.lit(0), F.lit(protocol.n_splits - 1))
    chunk = F.col("chunk")
    return F.filter(every, lambda f: f >= chunk if protocol.forward else f != chunk)


def fold_sizes(assignments: DataFrame, protocol: Protocol) -> DataFrame:
    """fold, train_rows, validation_rows and the holdout size, from one count per chunk."""
    counts = assignments.groupBy("part", "chunk").agg(F.count(F.lit(1)).alias("n"))
    exploded = counts.filter("part = 'pool'").select(
        "n", F.explode(F.concat(
            F.transform(training_folds(protocol), lambda f: F.struct(f.alias("fold"), F.lit("train").alias("role"))),
            F.filter(
                F.array(F.struct(validation_fold(protocol).alias("fold"), F.lit("validation").alias("role"))),
                lambda x: x["fold"].isNotNull(),
            ),
        )).alias("x"),
    )
    return exploded.groupBy("x.fold").agg(
        F.sum(F.when(F.col("x.role") == "train", F.col("n")).otherwise(0)).alias("train_rows"),
        F.sum(F.when(F.col("x.role") == "validation", F.col("n")).otherwise(0)).alias("validation_rows"),
    )


def overlap(assignments: DataFrame, protocol: Protocol) -> DataFrame:
    """Rows on both sides of some fold; the predicates above make this zero, and this proves it."""
    both = F.array_contains(training_folds(protocol), validation_fold(protocol))
    repeated = assignments.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.coalesce(both, F.lit(False))).alias("both")
    )
    return repeated.agg(
        F.count_if("both").alias("overlapping_rows"), F.count_if(F.col("n") > 1).alias("repeated_rows")
    )


PROBE_EXCESS = 4  # so many times the rows wanted are ranked


# --- samples inside the training side ----------------------------------------------------------------


def train_probe(assignments: DataFrame, protocol: Protocol, rows: int = fixed.PROBE_ROWS_PER_FOLD) -> DataFrame:
    """fold, row_id: the first ``rows`` training rows of each fold in a seeded order.

    Only rows below a cut of the hash are ranked, a few times ``rows`` per fold whatever its size: hashes are
    uniform, so the cut follows from the fold's size.  A count says whether it leaves enough; where it does
    not, it is raised, so the result never depends on it.
    """
    members = assignments.filter("part = 'pool'").select("row_id", training_folds(protocol).alias("folds"))
    hashed = members.withColumn("__h", seeded_hash(protocol.seed, "probe", F.col("row_id")))
    sizes = {r["fold"]: r["train_rows"] for r in fold_sizes(assignments, protocol).collect()}  # one row a fold
    share = {fold: PROBE_EXCESS * rows / max(1, n) for fold, n in sizes.items()}
    while True:
        below = _below(hashed, share)
        held = {r["fold"]: r["n"] for r in below.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
        short = [fold for fold, n in sizes.items() if share[fold] < 1 and held.get(fold, 0) < min(rows, n)]
        if not short:
            break
        share |= {fold: share[fold] * PROBE_EXCESS for fold in short}
    order = Window.partitionBy("fold").orderBy("__h", "row_id")
    return below.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= rows).select("fold", "row_id")


def _below(hashed: DataFrame, share: dict[int, float]) -> DataFrame:
    """``fold, row_id, __h`` of (row_id, folds, __h) whose hash is among the fold's lowest ``share``."""
    if not share:
        return hashed.select(F.explode("folds").alias("fold"), "row_id", "__h")
    # hex digits compare as text; "g" is above all of them
    cut = {fold: f"{int(s * 16**12):012x}" if s < 1 else "g" for fold, s in share.items()}
    cuts = F.create_map(*[x for fold, c in cut.items() for x in (F.lit(fold).cast("int"), F.lit(c))])
    rows = hashed.filter(F.col("__h") < max(cut.values())).select(F.explode("folds").alias("fold"), "row_id", "__h")
    return rows.filter(F.col("__h") < F.coalesce(F.try_element_at(cuts, F.col("fold").cast("int")), F.lit("g")))


def subset_size(train_rows: int, fraction: float) -> int:
    return min(max(fixed.MIN_SUBSET_ROWS, round(train_rows * fraction)), train_rows)


def subset_hash(protocol: Protocol) -> Column:
    """Order in which training rows enter growing subsets; ties end in the row id."""
    return F.struct(seeded_hash(protocol.seed, "subset", F.col("row_id")).alias("h"), F.col("row_id").alias("i"))


def growing_subsets(
    assignments: DataFrame, protocol: Protocol, fractions: tuple[float, ...] = fixed.CURVE_FRACTIONS,
    *, rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """fraction, fold, row_id, order: nested training subsets; validation rows are never touched."""
    sizes = {r["fold"]: r["train_rows"] for r in fold_sizes(assignments, protocol).collect()}
    # hashed before a row is given to its folds
    members = assignments.filter("part = 'pool'").select("row_id", "chunk", subset_hash(protocol).alias("order"))
    hashed = members.select("row_id", "order", F.explode(training_folds(protocol)).alias("fold")).withColumn("__h", F.col("order.h"))
    ranked = hash_rank(
        hashed, "__h", "row_id", n_rows=sum(sizes.values()), within=("fold",), n_groups=len(sizes),
        rows_per_bucket=rows_per_bucket,
    )
    limits = F.array(*[
        F.struct(
            F.lit(float(f)).alias("fraction"),
            F.element_at(
                F.create_map(*[x for fold, n in sizes.items() for x in (F.lit(fold), F.lit(subset_size(n, f)))]),
                F.col("fold"),
            ).alias("limit"),
        )
        for f in fractions
    ])
    return (
        ranked.select("fold", "row_id", "order", F.col("rank"), F.explode(limits).alias("x"))
        .filter(F.col("rank") <= F.col("x.limit"))
        .select("x.fraction", "fold", "row_id", "order")
    )


def subset_cuts(
    assignments: DataFrame, protocol: Protocol, fractions: tuple[float, ...] = fixed.CURVE_FRACTIONS
) -> dict[tuple[float, int], tuple[int, tuple[str, int]]]:
    """(fraction, fold) -> (rows, last row in subset order).

    With these few values membership is a comparison on the row itself, so no fit needs a join.
    """
    ends = growing_subsets(assignments, protocol, fractions).groupBy("fraction", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.max("order").alias("last")
    )
    return {(r["fraction"], r["fold"]): (r["n"], (r["last"]["h"], r["last"]["i"])) for r in ends.collect()}


def in_subset(order: Column, last: tuple[str, int]) -> Column:
    """Whether a row whose ``subset_hash`` is ``order`` is in the subset that ends with ``last``."""
    return order <= F.struct(F.lit(last[0]).alias("h"), F.lit(last[1]).cast("long").alias("i"))


def permutation_pairs(
    rows: DataFrame, repeats: int, seed: int, *, n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """repeat, row_id, donor_id: in every repeat each row receives the values of one other row.

    The row with rank r by id is paired with the row with rank r by a seeded hash: a bijection.
    """
    by_id = value_rank(rows.select("row_id"), "row_id", "row_id", n_rows=n_rows, rows_per_bucket=rows_per_bucket)
    every = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    hashed = rows.select(F.col("row_id").alias("donor_id"), every).withColumn(
        "__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("permute"), F.col("repeat"), F.col("donor_id")))
    )
    donors = hash_rank(
        hashed, "__h", "donor_id", n_rows=n_rows * repeats, within=("repeat",), n_groups=repeats,
        rows_per_bucket=rows_per_bucket,
    )
    return donors.select("repeat", "donor_id", "rank").join(by_id.select("row_id", "rank"), "rank").drop("rank")
