"""Order statistics over groups of any size.

A plain ``Window.partitionBy(group).orderBy(value)`` sorts a whole group in one
task. Here a numeric value is cut into monotone prefixes (two levels, then the
value itself). Rows are first folded to distinct values, then each window runs
inside one prefix, whose number of possible successors is bounded (at most
2**21 below the first level), and the totals of the prefixes supply the
offsets. One hot group therefore spreads over as many tasks as it has prefixes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlake.functions.hashing import digest
from donorlake.session import durable

_LEVELS = ("_l1", "_l2")


def _prefixes(value: str) -> dict[str, Column]:
    """Two monotone integer prefixes of a number (NaN sorts like Spark does: last)."""
    x = F.col(value).cast("double")
    a = F.abs(x)
    exponent = F.floor(F.log2(a))
    mantissa = a / F.pow(F.lit(2.0), exponent.cast("double"))
    ok = (a > 0) & (a < float("inf"))
    coarse = (exponent + 1100) * 1024 + F.floor(mantissa * 1024)
    fine = F.floor(mantissa * float(2**31))
    sign = F.signum(x).cast("bigint")
    edge = F.when(F.isnan(x), 2**40).when(a == float("inf"), sign * (2**39)).otherwise(0)
    # Never NULL, so joins on the prefixes add no filters and all branches share one shuffle of the folded rows.
    return {
        "_l1": F.coalesce(F.when(ok, sign * coarse).otherwise(edge).cast("bigint"), F.lit(0).cast("bigint")),
        "_l2": F.coalesce(F.when(ok, sign * fine).otherwise(0).cast("bigint"), F.lit(0).cast("bigint")),
    }


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows of ``df``; a NULL in one of the columns fails instead of vanishing or being ranked."""
    kinds = dict(df.dtypes)
    message = lambda c: F.raise_error(F.lit(f"NULL in {c}, which must be known here")).cast(kinds[c])
    return df.withColumns({c: F.coalesce(F.col(c), message(c)) for c in columns if df.schema[c].nullable})


def tally(df: DataFrame, value: str, measures: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Fold rows to one per (group, distinct value) with additive measures. A NULL value has no rank, so it fails."""
    return required(df, [value]).groupBy(*by, value).agg(*[m.alias(name) for name, m in measures.items()])


def running_totals(
    df: DataFrame, value: str, measures: Mapping[str, Column], by: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """Per distinct value: the measures, ``cum_<measure>`` up to and including it, and the group's ``total_<measure>``."""
    by = list(by)
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    cells = tally(df, value, measures, by).withColumns(_prefixes(value))
    blocks = cells.groupBy(*by, *_LEVELS).agg(*[F.sum(m).alias(m) for m in measures])
    tops = blocks.groupBy(*by, "_l1").agg(*[F.sum(m).alias(m) for m in measures])

    def shifted(frame: DataFrame, keys: list[str], along: str, suffix: str, keep: str | None = None) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(order(along)).rowsBetween(Window.unboundedPreceding, -1)
        kept = [keep + m for m in measures] if keep else []
        return frame.select(
            *keys, along, *kept, *[F.coalesce(F.sum(m).over(w), F.lit(0)).alias(m + suffix) for m in measures]
        )

    whole = Window.partitionBy(*by)
    top = shifted(tops.withColumns({f"total_{m}": F.sum(m).over(whole) for m in measures}), by, "_l1", "_top", "total_")
    mid = shifted(blocks, by + ["_l1"], "_l2", "_mid")
    w = Window.partitionBy(*by, *_LEVELS).orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    local = cells.withColumns({f"{m}_own": F.sum(m).over(w) for m in measures})
    offsets = mid.join(top, by + ["_l1"])
    return local.join(offsets, by + list(_LEVELS)).select(
        *by,
        value,
        *measures,
        *[(F.col(f"{m}_own") + F.col(f"{m}_mid") + F.col(f"{m}_top")).alias(f"cum_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )


def dominance(df: DataFrame, value: str, upper: Column, lower: Column, by: Sequence[str] = ()) -> DataFrame:
    """Per group: Σ upper, Σ lower and Σ upper·(lower strictly below + half of the tied lower).

    The additive form needs no offset joins: each level adds the pairs that
    differ first at that level and folds into its parent.
    """
    by = list(by)
    cells = tally(df, value, {"up": upper, "low": lower}, by).withColumns(_prefixes(value))
    cells = cells.withColumn("won", F.col("up").cast("double") * F.col("low") / 2.0)
    levels = [*_LEVELS, value]
    for depth in range(len(levels) - 1, -1, -1):
        keys = by + levels[:depth]
        w = Window.partitionBy(*keys).orderBy(levels[depth]).rowsBetween(Window.unboundedPreceding, -1)
        cells = (
            cells.withColumn("below", F.coalesce(F.sum("low").over(w), F.lit(0)))
            .groupBy(*keys)
            .agg(
                F.sum("up").alias("up"),
                F.sum("low").alias("low"),
                F.sum(F.col("won") + F.col("up").cast("double") * F.col("below")).alias("won"),
            )
        )
    return cells


def mid_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct value: how many rows hold it (``n``) and their shared average rank."""
    totals = running_totals(df, value, {"n": F.count(F.lit(1))}, by)
    return totals.select(*by, value, "n", (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias("mid_rank"))


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one column ``q0``, ``q1``… per probability."""
    by = list(by)
    rows = df.where(F.col(value).isNotNull())
    steps = running_totals(rows, value, {"n": F.count(F.lit(1))}, by).withColumnRenamed("total_n", "_size")
    picks = []
    for i, p in enumerate(probs):
        position = (F.col("_size") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (F.col("cum_n") - F.col("n") <= at) & (at < F.col("cum_n"))
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{side}{i}"))
    picked = steps.groupBy(*by, "_size").agg(*picks)

    def blend(i: int, p: float) -> Column:
        position = (F.col("_size") - 1) * F.lit(float(p))
        share = position - F.floor(position)
        return (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share).alias(f"q{i}")

    return picked.select(*by, *[blend(i, p) for i, p in enumerate(probs)])


def with_group_totals(df: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach one row of totals per group (the single global row when ``by`` is empty)."""
    if by:
        return df.join(totals, list(by))
    return df.withColumns({c: totals.select(c).scalar() for c in totals.columns})


ONE_WINDOW = 1 << 20  # rows of a group that one window may order


def hash_rank(df: DataFrame, key: str, seed: int, by: Sequence[str] = (), name: str = "hash_rank", largest: int | None = None) -> DataFrame:
    """1-based position of every row in a seeded shuffle of its group.

    Hex digits of the digest cut a group into 256 even slices, each of those into 4,096 and each of those into 4,096
    again: the windows run over slice sizes and over single slices (a group of 10^13 rows has some 2,300 in each). A
    NULL key or group fails. Where no group has more than ``largest`` rows and these are few, a group is one window: many
    small groups, such as replicates, need no slices, and rows that lie together by group already are not shuffled again.
    """
    by = list(by)
    rows = required(df, [*by, key]).withColumn("_digest", digest(seed, *by, key))
    if by and largest is not None and largest <= ONE_WINDOW:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy("_digest", key)).cast("bigint")).drop("_digest")
    rows = rows.withColumns({"_a": F.substring("_digest", 1, 2), "_b": F.substring("_digest", 3, 3), "_slice": F.substring("_digest", 6, 3)})
    levels, offsets = ["_a", "_b", "_slice"], None
    sizes = rows.groupBy(*by, *levels).agg(F.count(F.lit(1)).alias("_n"))
    for depth in range(3):
        keys = by + levels[:depth]
        here = sizes.groupBy(*keys, levels[depth]).agg(F.sum("_n").alias("_n")) if depth < 2 else sizes
        before = Window.partitionBy(*keys).orderBy(levels[depth]).rowsBetween(Window.unboundedPreceding, -1)
        step = here.select(*keys, levels[depth], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(f"_before{depth}"))
        offsets = step if offsets is None else step.join(offsets.hint("merge"), keys)
    inside = Window.partitionBy(*by, *levels).orderBy("_digest", key)
    # Groups are often exploded replicates, which Spark's size estimates leave out: without the hint it would broadcast offsets
    # of as many slices as there are rows. The window has sorted the rows for this join.
    ranked = rows.withColumn("_own", F.row_number().over(inside)).join(offsets.hint("merge"), by + levels)
    total = F.col("_own") + F.col("_before0") + F.col("_before1") + F.col("_before2")
    return ranked.withColumn(name, total.cast("bigint")).drop("_digest", *levels, "_own", "_before0", "_before1", "_before2")


def hash_draw_sums(
    df: DataFrame, key: str, seed: int, quota: str, measures: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Sums over the first ``quota`` rows of each group's seeded shuffle (the order of ``hash_rank``).

    A group has 256 slices here. Whole slices are added as partial aggregates. Only the slice in which a
    group's quota ends is looked at row by row, so the rows themselves are not
    ranked. A NULL key or group fails.
    """
    by = list(by)
    rows = required(df, [*by, key]).withColumn("_digest", digest(seed, *by, key)).withColumn("_slice", F.substring("_digest", 1, 2))
    slices = rows.groupBy(*by, "_slice").agg(
        F.count(F.lit(1)).alias("_n"), F.max(quota).alias("_quota"), *[F.sum(m).alias(m) for m in measures]
    )
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    end = F.col("_before") + F.col("_n")
    whole = slices.where(end <= F.col("_quota")).select(*by, *measures)
    cut = slices.where((F.col("_before") < F.col("_quota")) & (end > F.col("_quota"))).select(
        *by, "_slice", (F.col("_quota") - F.col("_before")).alias("_take")
    )
    inside = Window.partitionBy(*by, "_slice").orderBy("_digest", key)
    edge = rows.join(cut.hint("shuffle_hash"), by + ["_slice"]).withColumn("_own", F.row_number().over(inside))
    taken = whole.unionByName(edge.where(F.col("_own") <= F.col("_take")).select(*by, *measures))
    return taken.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures])


def replicated(rows: DataFrame, replicates: DataFrame, by: Sequence[str], key: str, seed: int) -> DataFrame:
    """Every row once per entry of ``replicates``, with the digest of its place in the entry's shuffle and the digest's slice.

    ``replicates`` holds ``by…, _each``, one row per ``by`` group (or one at all): an array of structs, whose fields become
    columns that the digest covers up to the last one that doesn't begin with ``_``. The array goes to the rows before they
    multiply, so no join sees the product, whose size Spark's estimates leave out.
    """
    fields = replicates.schema["_each"].dataType.elementType.names
    beside = rows.join(replicates.hint("merge"), list(by)) if by else with_group_totals(rows, replicates, by)
    each = beside.withColumn("_each", F.explode("_each")).select(*rows.columns, "_each.*")
    out = each.withColumn("_digest", digest(seed, *by, *[c for c in fields if not c.startswith("_")], key))
    return out.withColumn("_place", F.substring("_digest", 1, 2))


def quota_slices(rows: DataFrame, quota: str, group: Sequence[str], measures: Sequence[str] = ()) -> DataFrame:
    """Per group and slice of ``replicated`` rows ``_n, _before`` and sums of measures, for slices that begin inside the quota. Written once."""
    slices = rows.groupBy(*group, "_place").agg(F.count(F.lit(1)).alias("_n"), F.max(quota).alias("_quota"), *[F.sum(m).alias(m) for m in measures])
    before = Window.partitionBy(*group).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return durable(slices.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < F.col("_quota")))


def replicate_draw_sums(df: DataFrame, n: int, key: str, seed: int, quota: str, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by…, replicate`` and sums over the first ``quota`` rows of each of ``n`` seeded shuffles of every group (the order
    of ``hash_rank`` by ``by…, replicate``).

    Counts and sums of 256 slices tell where each shuffle's quota ends; a second walk over the rows keeps only those of that
    slice, one in 256, so the product of rows and replicates is never shuffled, joined or broadcast.
    """
    by = list(by)
    group = [*by, "replicate"]
    rows = required(df, [*by, key])
    all_of = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.struct(r.alias("replicate")))
    everyone = rows.groupBy(*by).agg(F.first(F.lit(1))).select(*by, all_of.alias("_each"))
    slices = quota_slices(replicated(rows, everyone, by, key, seed), quota, group, measures)
    end = F.col("_before") + F.col("_n")
    whole = slices.where(end <= F.col("_quota")).select(*group, *measures)
    ends = slices.where(end > F.col("_quota"))
    entry = F.struct("replicate", F.col("_place").alias("_last"), (F.col("_quota") - F.col("_before")).alias("_take"))
    cuts = ends.groupBy(*by).agg(F.collect_list(entry).alias("_each"))
    edge = replicated(rows, cuts, by, key, seed).where("_place = _last")
    inside = Window.partitionBy(*group).orderBy("_digest", key)
    edge = edge.withColumn("_own", F.row_number().over(inside)).where(F.col("_own") <= F.col("_take"))
    return whole.unionByName(edge.select(*group, *measures)).groupBy(*group).agg(*[F.sum(m).alias(m) for m in measures])


def global_rank(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """1-based row number in total order, or within ``by`` groups, without a one-task sort.

    The rows are range-partitioned and written once; partition sizes give the
    offsets, and a group's first position gives the start of its own numbering.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in (*by, *order)]
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    )
    placed = durable(placed)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = placed.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_pos") + 1)
    ranked = ranked.drop("_part", "_pos", "_before")
    if not by:
        return ranked
    starts = ranked.groupBy(*by).agg((F.min(name) - 1).alias("_start"))
    return ranked.join(starts, list(by)).withColumn(name, F.col(name) - F.col("_start")).drop("_start")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
