"""Bootstrap weights by halving ranks: exact counts, one result on any number of leaves, any partitioning."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from donorlake.operators import multinomial as mn
from donorlake.operators import resample as rs


def test_binomial_quantiles():
    rng = np.random.default_rng(1)
    u = rng.random(3000)
    for m, p in ((1, 0.3), (2, 0.5), (7, 0.9), (60, 0.01), (500, 0.5)):
        pmf = [math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(m + 1)]
        want = np.minimum(m, np.searchsorted(np.cumsum(pmf), u, side="right"))
        assert (mn.binomial(np.full(3000, m), np.full(3000, p), u) == want).all()
    k = mn.binomial(np.full(1000, 10**6), np.full(1000, 0.25), (np.arange(1000) + 0.5) / 1000)
    assert abs((k - 2.5e5).mean()) < 1 and abs((k - 2.5e5).std() / np.sqrt(10**6 * 3 / 16) - 1) < 0.01


def test_log_gamma():
    x = np.array([1, 2, 3, 50, 199, 200, 201, 10**4, 10**9])
    assert np.allclose(mn.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-14)


def test_uniform_values():
    u = mn.uniform(3, 7, np.arange(100_000), 0, 64)
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.005 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.02
    assert len(np.unique(u)) == 100_000
    assert (mn.uniform(3, 7, np.arange(5), 2**40, 2**41) != mn.uniform(3, 7, np.arange(5), 0, 0)).all()


def test_leaves_and_wholes_agree():
    """Weights of a stratum in one leaf, in many leaves, and of coarser cells."""
    r = np.arange(40)
    every = mn.cell_weights(100, 0, 100, np.arange(1, 101), 5, 9, r)
    assert (every.sum(axis=0) == 100).all()
    assert abs(every.var() - 0.99) < 0.1 and np.corrcoef(every[3], every[90])[0, 1] < 0.4
    parts = [mn.cell_weights(100, lo, hi, np.arange(lo + 1, hi + 1), 5, 9, r) for lo, hi in mn.leaves(100, 10)]
    assert (np.concatenate(parts) == every).all() and len(parts) == 16
    ends = np.array([1, 40, 41, 100])
    assert (mn.cell_weights(100, 0, 100, ends, 5, 9, r) == np.add.reduceat(every, np.concatenate([[0], ends[:-1]]), axis=0)).all()


@pytest.fixture(scope="module")
def tied(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], int(rng.random() < 0.3), 0.5 if i % 3 == 0 else float(np.round(rng.normal(), 1)), float(rng.integers(0, 4))) for i in range(300)]
    return spark.createDataFrame(rows, "donor_id int, part string, label int, score double, other double").repartition(4)


@pytest.mark.parametrize("by", [(), ("part",)])
def test_several_leaves_change_nothing(tied, monkeypatch, by):
    """A third of all rows share one score, which lies over several leaves."""
    run = lambda df: sorted(map(tuple, rs.bootstrap_auroc(df, ["score", "other"], n=130, seed=4, by=list(by)).select(*by, "arm", "replicate", "n_pos", "n_neg", F.round("auroc", 9)).collect()))
    want = run(tied)
    assert len(want) == 2 * 130 * (2 if by else 1)
    monkeypatch.setattr(mn, "LEAF", 20)
    assert run(tied) == want
    assert run(tied.repartition(1)) == want


def test_intervals_agree_with_drawn_rows(tied):
    pdf = tied.toPandas()
    rng, y, s = np.random.default_rng(0), pdf["label"].to_numpy(), pdf["score"].to_numpy()

    def auc(at):
        a, b = s[at][y[at] == 1], s[at][y[at] == 0]
        return (np.sign(a[:, None] - b[None, :]) / 2 + 0.5).mean()

    drawn = np.array([auc(rng.integers(0, 300, 300)) for _ in range(2000)])
    ci = rs.bootstrap_interval(rs.bootstrap_auroc(tied, n=2000, seed=8)).head()
    assert abs(ci["boot_mean"] - drawn.mean()) < 0.004
    assert abs(ci["ci_lower"] - np.quantile(drawn, 0.025)) < 0.01 and abs(ci["ci_upper"] - np.quantile(drawn, 0.975)) < 0.01


def test_nulls_and_nothing(spark, tied):
    with pytest.raises(PySparkException, match="score is NULL"):
        rs.bootstrap_auroc(tied.withColumn("score", F.when(F.col("donor_id") > 3, F.col("score"))), n=5).collect()
    assert rs.bootstrap_auroc(tied.where("false"), n=5).count() == 0
    no_label = tied.withColumn("label", F.when(F.col("donor_id") < 200, F.col("label")))
    got = rs.bootstrap_auroc(no_label, n=50).agg(F.avg(F.col("n_pos") + F.col("n_neg"))).first()[0]
    assert 180 < got < 220


def test_equal_draws_share_one_table(monkeypatch):
    """50,000 draws of a few (m, p) compute a few distributions, with the values that each one's own has."""
    rng = np.random.default_rng(3)
    m, p, u = rng.integers(1, 40, 50_000), rng.choice([0.5, 0.25, 2 / 3], 50_000), rng.random(50_000)
    asked, gamma = [], mn.log_gamma
    monkeypatch.setattr(mn, "log_gamma", lambda x: (asked.append(np.size(x)), gamma(x))[1])
    got = mn.binomial(m, p, u)
    assert sum(asked) < 50_000
    some = rng.integers(0, 50_000, 300)
    assert got[some].tolist() == [int(mn.binomial(m[[i]], p[[i]], u[[i]])[0]) for i in some]
