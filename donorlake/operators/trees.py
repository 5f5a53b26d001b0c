"""Classification trees grown level by level from Spark histograms, with exact gains.

All trees of a forest are keys and take their next level in the same pass. Features are cut into equal bins between their
least and greatest value. A pass sends counts per (tree, node, feature, bin), summed in the tasks first; of these the split
with the largest decrease of Gini impurity is taken for every node (ties: the smaller feature, then the smaller bin). Only
the features a node may use are counted. What tasks get of a level are its splits, at most trees × 2^level rows.

Bootstrap weights are Poisson(1) draws and feature subsets the smallest draws, both from hashes of keys: they don't depend on
partitioning, and any engine can repeat them. Labels are 0 or 1; NULL labels, NULL or non-finite features and feature arrays
of different sizes fail. Equal rows are split alike; an empty table, or one with a single class, has no splits.
"""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlake.functions.hashing import draw
from donorlake.session import durable

BINS = 32
LEAST_GAIN = 1e-9  # what is below is rounding of a gain of zero
SMALL = 32_000_000  # bytes of splits or feature lists that are sent to every task


def poisson_steps() -> list[int]:
    """A draw out of 2³² has weight k if it reaches k of these: the distribution function of Poisson(1)."""
    total, steps = 0.0, []
    for k in range(10):
        total += exp(-1) / factorial(k)
        steps.append(int(total * 2**32))
    return steps


def _weight(seed: int, key: str) -> Column:
    u = draw(seed, F.lit("w"), "tree", key)
    return sum((F.when(u >= s, 1).otherwise(0) for s in poisson_steps()), F.lit(0)).cast("bigint")


def _sent(rows: DataFrame, count: int, width: int) -> DataFrame:
    """A hint only where the number of rows is known to be small."""
    return F.broadcast(rows) if count * width <= SMALL else rows


def feature_bounds(donors: DataFrame, features: str = "features") -> DataFrame:
    """``feature, low, high`` of every position of the feature arrays."""
    each = donors.select(F.posexplode(features).alias("feature", "x")).select("feature", F.col("x").cast("double").alias("x"))
    x = F.col("x")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    each = each.withColumn("x", F.when(bad, F.raise_error(F.lit("a feature is NULL or not finite")).cast("double")).otherwise(x))
    return each.groupBy("feature").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def binned(donors: DataFrame, bounds: DataFrame, key: str, label: str, features: str, bins: int) -> DataFrame:
    """``key, y, bins`` of every donor."""
    ends = bounds.agg(F.array_sort(F.collect_list(F.struct("feature", "low", "high"))).alias("ends"))  # one row, one entry per feature
    y = F.col(label).cast("int")
    y = F.when(y.isin(0, 1), y).otherwise(F.raise_error(F.lit("a label is neither 0 nor 1")).cast("int"))
    rows = donors.select(key, y.alias("y"), F.col(features).cast("array<double>").alias("x")).withColumn("e", ends.scalar())
    same = F.size("x") == F.size("e")
    rows = rows.withColumn("x", F.when(same, F.col("x")).otherwise(F.raise_error(F.lit("feature arrays differ in size")).cast("array<double>")))

    def place(pair: Column) -> Column:
        low, high = pair["e"]["low"], pair["e"]["high"]
        at = F.floor((pair["x"] - low) / (high - low) * float(bins)).cast("int")
        return F.when(high > low, F.least(at, F.lit(bins - 1))).otherwise(0)

    return rows.select(key, "y", F.transform(F.arrays_zip("x", "e"), place).alias("bins"))


def _open_features(nodes: DataFrame, size: int, subset: int, seed: int) -> DataFrame:
    """``tree, node, allowed``: the features every open node may use."""
    every = nodes.withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    if subset < size:
        order = Window.partitionBy("tree", "node").orderBy(draw(seed, F.lit("f"), "tree", "node", "feature"), "feature")
        every = every.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= subset)
    return every.groupBy("tree", "node").agg(F.array_sort(F.collect_list("feature")).alias("allowed"))


def best_splits(histogram: DataFrame) -> DataFrame:
    """The best split of every node from ``tree, node, feature, bin, n, p`` (rows and positives)."""
    whole = Window.partitionBy("tree", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most one row per bin
    sums = histogram.select(
        "tree", "node", "feature", "bin", F.sum("n").over(upto).alias("nl"), F.sum("p").over(upto).alias("pl"),
        F.sum("n").over(whole).alias("n"), F.sum("p").over(whole).alias("p"),
    ).where("nl < n")
    part = lambda p, n: p.cast("double") * p.cast("double") / n.cast("double")
    nl, pl, n, p = (F.col(c) for c in ("nl", "pl", "n", "p"))
    # The impurity n · (1 − Σ share²) falls by twice this number.
    gain = part(pl, nl) + part(p - pl, n - nl) - part(p, n)
    best = F.max(F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "n", "p")).alias("s")
    found = sums.groupBy("tree", "node").agg(best).where(F.col("s.gain") > LEAST_GAIN)
    return found.select("tree", "node", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), "s.gain", "s.n", F.col("s.p").alias("positives"))


def grow(
    donors: DataFrame, trees: int = 1, depth: int = 3, bins: int = BINS, subset: int | None = None, bootstrap: bool = False,
    seed: int = 0, key: str = "donor_id", label: str = "label", features: str = "features",
) -> DataFrame:
    """Splits of all trees: ``tree, node, feature, bin, threshold, gain, n, positives``.

    The root is node 1, and the children of a node are 2 · node (values below the threshold) and 2 · node + 1. ``subset`` features
    are open to each node (all by default); with ``bootstrap`` rows weigh what their draw says, and n counts weights.
    """
    bounds = durable(feature_bounds(donors, features))
    size = bounds.count()
    if not size:
        bounds = donors.sparkSession.createDataFrame([], bounds.schema)
    base = durable(binned(donors, bounds, key, label, features, bins))
    subset = min(subset or size, size)
    rows = base.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    rows = rows.withColumn("w", _weight(seed, key) if bootstrap else F.lit(1).cast("bigint")).where("w > 0").withColumn("node", F.lit(1).cast("bigint"))
    nodes = donors.sparkSession.range(trees).select(F.col("id").cast("int").alias("tree"), F.lit(1).cast("bigint").alias("node"))
    levels = []
    for level in range(depth if size else 0):
        count = trees * 2**level
        allowed = _sent(_open_features(nodes, size, subset, seed), count, 4 * subset + 64)
        counted = rows.join(allowed, ["tree", "node"]).select("tree", "node", "y", "w", F.explode(F.transform("allowed", lambda f: F.struct(f.alias("feature"), F.get("bins", f).alias("bin")))).alias("c"))
        histogram = counted.groupBy("tree", "node", "c.feature", "c.bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("p"))
        splits = durable(best_splits(histogram))
        levels.append(splits)
        side = F.when(F.get("bins", F.col("feature")) > F.col("bin"), 1).otherwise(0)
        taken = _sent(splits.select("tree", "node", "feature", "bin"), count, 64)
        rows = rows.join(taken, ["tree", "node"]).select(key, "y", "bins", "tree", "w", (2 * F.col("node") + side).alias("node"))
        nodes = splits.select("tree", F.explode(F.array(2 * F.col("node"), 2 * F.col("node") + 1)).alias("node"))
    if not levels:
        none = "tree int, node bigint, feature int, bin int, threshold double, gain double, n bigint, positives bigint"
        return donors.sparkSession.createDataFrame([], none)
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    threshold = F.col("low") + (F.col("bin") + 1).cast("double") * (F.col("high") - F.col("low")) / float(bins)
    found = found.join(bounds, "feature").withColumn("threshold", threshold)
    return found.select("tree", "node", "feature", "bin", "threshold", "gain", "n", "positives")


def importances(splits: DataFrame) -> DataFrame:
    """``feature, importance``: each feature's share of a tree's gains, averaged over the trees that have splits."""
    per = splits.groupBy("tree", "feature").agg(F.sum("gain").alias("g"))
    whole = splits.groupBy("tree").agg(F.sum("gain").alias("all"))
    count = whole.agg(F.count(F.lit(1)).alias("n")).scalar()
    shares = per.join(whole, "tree").select("feature", (F.col("g") / F.col("all")).alias("share"))
    return shares.groupBy("feature").agg((F.sum("share") / count).alias("importance"))
