"""Principal components by block Krylov passes beside numpy."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from donorlake.operators import subspace


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id int, embedding array<double>").repartition(3)


@pytest.mark.parametrize("name", ["fast", "flat", "low rank", "copies"])
def test_components_equal_the_decomposition(spark, name, monkeypatch):
    monkeypatch.setattr(subspace, "PIECE", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 40)) + 100
    if name == "fast":
        x = (x - 100) * 0.5 ** np.arange(40) + 3
    if name == "low rank":
        x = rng.normal(size=(80, 3)) @ rng.normal(size=(3, 40))
    if name == "copies":
        x = np.repeat(x[:4], 20, axis=0)
    found = subspace.fit(frame(spark, x), 3, extra=2, blocks=3)
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(found.variances, s[:3] ** 2 / 79, rtol=1e-9)
    assert np.allclose(found.directions.T @ found.directions, np.eye(3), atol=1e-10)
    assert np.allclose(np.abs((found.directions * vt[:3].T).sum(axis=0)), 1, atol=1e-6)
    assert (found.directions[np.abs(found.directions).argmax(axis=0), range(3)] > 0).all()
    got = np.stack(subspace.scores(frame(spark, x), found).orderBy("cell_id").toPandas()["components"])
    assert np.allclose(got, c @ found.directions)


def test_more_dimensions_than_a_square_could_hold(spark):
    """100,000 dimensions: a matrix of pairs would take 80 GB."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 100_000)) * 0.01
    x[:, :50] += np.outer(np.arange(12), np.ones(50))
    found = subspace.fit(frame(spark, x), 1, extra=3, blocks=4, tolerance=1e-7)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.isclose(found.variances[0], s[0] ** 2 / 11) and found.directions.shape == (100_000, 1)


def test_unusable_vectors(spark):
    with pytest.raises(ValueError, match="no 2 components"):
        subspace.fit(frame(spark, np.ones((1, 3))), 2)
    with pytest.raises(ValueError, match="no 4 components"):
        subspace.fit(frame(spark, np.ones((5, 3))), 4)
    uneven = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "cell_id int, embedding array<double>")
    with pytest.raises(PySparkException, match="different lengths"):
        subspace.fit(uneven, 1)
