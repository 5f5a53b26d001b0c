"""Fits with many features: the matrix-free solver beside Newton's method, and the blocked donor matrix."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from donorlake.operators import models as md
from donorlake.operators import pseudobulk as pb
from donorlake.operators import quasi_newton as qn


def people(spark, n=60, p=8, seed=1, gap=0.8, nan=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, p)) * np.linspace(0.1, 30, p) + np.linspace(-5, 500, p)
    y = (rng.random(n) < 0.4).astype(int)
    x[:, 0] += gap * y
    x[:, -1] = 7.0  # constant
    if nan:
        x[::7, 1] = np.nan
    return spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(n)], "donor_id long, label int, features array<double>").repartition(3)


def model_rows(df):
    return md._place(df.withColumns({"rep": F.lit(0), "folds": F.array((F.col("donor_id") % 3).cast("int"))}), "donor_id")


@pytest.mark.parametrize("balanced", [False, True])
def test_both_solvers_reach_one_optimum(spark, balanced):
    rows = model_rows(people(spark, nan=True))
    fits = [md.Fit(0, ((0, o),), c) for o in (-1, 0) for c in (0.01, 1.0)]
    fill = np.full((len(fits), 8), 0.25)
    a = md.fit_logistic(rows, fits, 8, balanced, fill=fill, solver="newton")
    b = md.fit_logistic(rows, fits, 8, balanced, fill=fill, solver="matrix-free")
    assert np.abs(a.weights - b.weights).max() < 1e-5
    assert a.kkt.max() < 1e-6 and b.kkt.max() < 1e-5 and b.converged.all()
    assert (a.n_train == b.n_train).all() and (a.n_cases == b.n_cases).all()


@pytest.mark.parametrize("balanced, block", [(False, 500), (True, 200)])
def test_fewer_rows_than_features_take_few_passes(spark, monkeypatch, balanced, block):
    """The solver goes on among the rows: it reaches Newton's optimum in the features without a pass over them per step."""
    monkeypatch.setattr(md, "BLOCK_FEATURES", block)
    rows, scaled = model_rows(people(spark, 30, 70, 6)), [i != 2 for i in range(70)]
    fits = [md.Fit(0, ((0, o),), c) for o in (-1, 0, 1) for c in (0.01, 1.0)]
    a = md.fit_logistic(rows, fits, 70, balanced, scaled, solver="newton")
    with monkeypatch.context() as m:
        m.setattr(md, "_ladder", None)
        b = md.fit_logistic(rows, fits, 70, balanced, scaled, solver="matrix-free")
    assert np.abs(a.weights - b.weights).max() < 1e-6 and b.kkt.max() < 1e-7 and b.converged.all()
    assert (a.n_train == b.n_train).all() and (a.n_cases == b.n_cases).all()
    assert np.allclose(a.mean, b.mean) and np.allclose(a.scale, b.scale) and np.isinf(b.scale[:, -1]).all()
    alone = model_rows(people(spark, 30, 70, 6).withColumn("label", F.when(F.col("donor_id") % 3 == 0, F.col("label")).otherwise(0)))
    kept = md.fit_logistic(alone, [md.Fit(0, ((0, 0),), 1.0), md.Fit(0, ((0, 1),), 1.0)], 70, solver="matrix-free")
    assert np.isnan(kept.weights[0]).all() and np.isfinite(kept.weights[1]).all() and np.isnan(kept.kkt[0]) and kept.kkt[1] < 1e-7


def test_one_class_and_no_convergence(spark):
    rows = model_rows(people(spark).withColumn("label", F.when(F.col("donor_id") % 3 == 0, F.col("label")).otherwise(0)))
    kept = md.fit_logistic(rows, [md.Fit(0, ((0, 0),), 1.0), md.Fit(0, ((0, 1),), 1.0)], 8, solver="matrix-free")
    assert np.isnan(kept.weights[0]).all() and np.isfinite(kept.weights[1]).all()
    assert np.isnan(kept.kkt[0]) and kept.kkt[1] < 1e-5


def test_more_features_than_a_task_may_square(spark, monkeypatch):
    """Beyond the bound of features² the solver changes, fits go in passes, and results stay."""
    df = people(spark, 40, 30, 3)
    few = dict(outer=2, inner=2)
    plain = md.nested_cv(df, 5, c_grid=(0.01, 1.0), **few)
    refits = md.permutation_refit(df, 2, 1, fixed_c=0.1, **few)
    want = [sorted(map(tuple, x.select(*[F.round(c, 5) if t == "double" else c for c, t in x.dtypes]).collect())) for x in (*plain, refits)]
    monkeypatch.setattr(md, "MAX_STATE", 490)  # doubles: 30² / 2 is more
    wide = md.nested_cv(df, 5, c_grid=(0.01, 1.0), **few)
    more = md.permutation_refit(df, 2, 1, fixed_c=0.1, **few)
    got = [sorted(map(tuple, x.select(*[F.round(c, 5) if t == "double" else c for c, t in x.dtypes]).collect())) for x in (*wide, more)]
    assert got[:2] == want[:2]  # refits of other stages have other seeds
    assert len(got[2]) == 2 and all(0 <= v <= 1 for _, v in got[2])
    assert qn.per_group(61_497, 16_000_000) >= 8 and qn.per_group(10**9, 16_000_000) == 1


def test_thousands_of_features_few_donors(spark):
    p = 6000  # 18 million pairs of features, over the bound
    rng = np.random.default_rng(0)
    x, y = rng.normal(0, 1, (24, p)), np.arange(24) % 2
    x[:, :20] += y[:, None]
    rows = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(24)], "donor_id long, label int, features array<double>")
    fitted = md.fit_logistic(model_rows(rows), [md.Fit(0, ((0, 0),), 0.1), md.Fit(0, ((0, -1),), 0.1)], p)
    assert fitted.converged.all() and fitted.kkt.max() < 1e-5
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(24)])
    w = fitted.weights[1]
    prob = 1 / (1 + np.exp(-z @ w))
    assert np.abs(0.1 * z.T @ (prob - y) + np.append(w[:-1], 0)).max() < 1e-5


def test_blocks_of_the_donor_matrix(spark):
    rows = [("A", f"g{k:03d}", float(k)) for k in range(1, 40, 3)] + [("B", "g004", 2.0), ("B", "g100", 5.0), ("C", "g001", 0.0)]
    long = spark.createDataFrame(rows, "donor_id string, feature_id string, value double").repartition(4)
    pos = pb.feature_positions(long)
    order = sorted({r[1] for r in rows})
    assert {r["feature_id"]: r["position"] for r in pos.collect()} == {f: i for i, f in enumerate(order)}
    blocks = pb.blocked_arrays(long, pos, block=4)
    assert {(r["donor_id"], r["first"]): len(r["values"]) for r in blocks.collect()}[("B", 12)] == 4
    assert sorted(map(tuple, pb.long_rows(blocks, pos).collect())) == sorted(r for r in rows if r[2])
    wide = {r["donor_id"]: r["features"] for r in pb.model_rows(blocks, len(order), block=4).collect()}
    for d in "ABC":
        assert wide[d] == [sum(v for n, f, v in rows if n == d and f == g) for g in order]
    cpm = {r[0:2]: r[2] for r in map(tuple, pb.long_rows(pb.blocked_cpm(blocks), pos).collect())}
    assert cpm["B", "g100"] == pytest.approx(np.log1p(5 / 7 * 1e6))
    assert pb.blocked_arrays(long.where("false"), pos).count() == 0
    for bad in ([("A", "g001", None)], [("A", "g001", 1.0)]):
        more = long.unionByName(spark.createDataFrame(bad, long.schema))
        with pytest.raises(PySparkException, match="NULL or repeated"):
            pb.blocked_arrays(more, pos).collect()


def test_more_than_100_000_features(spark):
    ids = spark.range(0, 250_000, 1, 4)
    long = ids.select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("donor_id"), F.col("id").alias("feature_id"), (F.col("id") + 1.0).alias("value"))
    blocks = pb.blocked_arrays(long, ids.select(F.col("id").alias("feature_id"), F.col("id").alias("position")))
    assert blocks.agg(F.max(F.size("values")), F.count("*")).first()[:] == (pb.BLOCK, 2 * -(-250_000 // pb.BLOCK))
    back = pb.long_rows(blocks, ids.select(F.col("id").alias("feature_id"), F.col("id").alias("position")))
    assert back.where("value = feature_id + 1").count() == 250_000
