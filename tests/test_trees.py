"""Trees from histograms beside a plain recursive search."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from donorlake.operators import trees

SCHEMA = "donor_id int, label int, features array<double>"


def frame(spark, x, y):
    return spark.createDataFrame([(i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))], SCHEMA).repartition(3)


def brute(x, y, depth, bins):
    """``{node: (feature, bin, n, positives)}`` and gains, one node after the other."""
    low, high = x.min(axis=0), x.max(axis=0)
    placed = np.zeros(x.shape, int)
    wide = high > low
    placed[:, wide] = np.minimum(np.floor((x[:, wide] - low[wide]) / (high - low)[wide] * bins), bins - 1)
    found, gains = {}, {}

    def search(node, rows, left):
        n, p = len(rows), int(y[rows].sum())
        best = None
        for f in range(x.shape[1]):
            for b in range(bins - 1):
                below = rows[placed[rows, f] <= b]
                if 0 < len(below) < n and (placed[below, f] == b).any():
                    pl = int(y[below].sum())
                    gain = pl * pl / len(below) + (p - pl) ** 2 / (n - len(below)) - p * p / n
                    if best is None or gain > best[0]:
                        best = (gain, f, b)
        if left and best and best[0] > trees.LEAST_GAIN:
            gain, f, b = best
            found[node], gains[node] = (f, b, n, p), gain
            search(2 * node, rows[placed[rows, f] <= b], left - 1)
            search(2 * node + 1, rows[placed[rows, f] > b], left - 1)

    search(1, np.arange(len(x)), depth)
    return found, gains


@pytest.mark.parametrize("kind", ["smooth", "ties", "copies"])
def test_splits_equal_a_plain_search(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 5))
    if kind == "ties":
        x = np.round(x)
        x[:, 3], x[:, 4] = x[:, 0], 2.0  # a repeated and a constant feature
    if kind == "copies":
        x[:80] = x[0]
    y = (x[:, 1] + 0.5 * rng.normal(size=120) > 0).astype(int)
    found = trees.grow(frame(spark, x, y), depth=3, bins=8).collect()
    want, gains = brute(x, y, 3, 8)
    assert {r["node"]: (r["feature"], r["bin"], r["n"], r["positives"]) for r in found} == want
    for r in found:
        assert r["gain"] == pytest.approx(gains[r["node"]])
        low, high = x[:, r["feature"]].min(), x[:, r["feature"]].max()
        assert r["threshold"] == pytest.approx(low + (r["bin"] + 1) * (high - low) / 8)
    shares = {r["feature"]: r["importance"] for r in trees.importances(trees.grow(frame(spark, x, y), depth=3, bins=8)).collect()}
    assert sum(shares.values()) == pytest.approx(1.0)
    assert shares[1] == pytest.approx(sum(gains[k] for k, v in want.items() if v[0] == 1) / sum(gains.values()))


def test_forest_finds_the_feature_that_decides_and_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 6))
    rows = frame(spark, x, x[:, 2] > 0.3)
    grown = trees.grow(rows, trees=5, depth=2, bins=16, subset=3, bootstrap=True, seed=8)
    again = trees.grow(rows.repartition(7), trees=5, depth=2, bins=16, subset=3, bootstrap=True, seed=8)
    assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, again.collect()))
    roots = grown.where("node = 1").collect()
    assert len(roots) == 5 and len({r["n"] for r in roots}) > 1  # every tree has weights of its own
    shares = {r["feature"]: r["importance"] for r in trees.importances(grown).collect()}
    assert max(shares, key=shares.get) == 2


def test_tables_without_a_split(spark):
    assert trees.grow(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trees.grow(frame(spark, np.eye(4), np.ones(4))).count() == 0
    assert trees.grow(frame(spark, np.ones((4, 2)), [0, 1, 0, 1])).count() == 0
    assert trees.importances(trees.grow(frame(spark, np.ones((4, 2)), [0, 1, 0, 1]))).count() == 0


@pytest.mark.parametrize("row", [(9, None, [1.0, 2.0]), (9, 2, [1.0, 2.0]), (9, 1, [1.0, None]), (9, 1, [1.0, float("nan")]), (9, 1, [1.0])])
def test_rows_that_cannot_be_read_fail(spark, row):
    rows = frame(spark, np.eye(2), [0, 1]).union(spark.createDataFrame([row], SCHEMA))
    with pytest.raises(PySparkException):
        trees.grow(rows).count()
