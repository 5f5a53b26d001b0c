"""Principal components of any number of dimensions: a block Krylov subspace, one pass over the rows per block.

The covariance matrix is never formed. A pass multiplies it with a thin block of
directions: every task adds up Xᵀ(X Q) of its centred rows, in pieces of ``PIECE``
dimensions that Spark sums. The driver holds a basis of at most ``blocks`` such blocks,
takes the best directions in it (Rayleigh-Ritz) and goes on along their residuals, until
these vanish. A full basis is cut to its best directions and grown again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 4096  # dimensions of a block that are summed as one row


@dataclass
class Components:
    mean: np.ndarray
    directions: np.ndarray  # dimension by component, orthonormal; the largest entry of each is positive
    variances: np.ndarray  # sample variance along each, falling
    residuals: np.ndarray  # length of covariance times direction minus variance times direction
    passes: int


def _sums(vectors: DataFrame, kernel, width: int) -> dict[int, np.ndarray]:
    """``kernel(matrix)`` gives a (width by something) sum of a batch of rows; the sums of all rows, in pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            rows = [np.asarray(v, np.float64) for v in pdf["v"]]
            if any(len(r) != width for r in rows):
                raise ValueError("vectors have different lengths")
            if rows:
                part = kernel(np.stack(rows))
                total = part if total is None else total + part
        if total is not None:
            pieces = [total[at : at + PIECE].ravel() for at in range(0, width, PIECE)]
            yield pd.DataFrame({"piece": range(len(pieces)), "stats": pieces})

    parts = vectors.mapInPandas(run, "piece int, stats array<double>")
    summed = parts.groupBy("piece").agg(vector_to_array(Summarizer.sum(array_to_vector("stats"))).alias("stats"))
    return {r["piece"]: np.asarray(r["stats"]) for r in summed.toLocalIterator()}


def _joined(pieces: dict[int, np.ndarray], width: int) -> np.ndarray:
    columns = pieces[0].size // min(width, PIECE)
    return np.concatenate([pieces[i].reshape(-1, columns) for i in sorted(pieces)])


def _apart(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what of ``block`` lies outside ``basis``; directions that are next to nothing go."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 1e-12] / size[size > 1e-12]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8 * s[0]]
    return block


def fit(vectors: DataFrame, k: int, vector: str = "embedding", tolerance: float = 1e-9, extra: int = 8, blocks: int = 8, max_passes: int = 300) -> Components:
    """The first ``k`` principal components of the rows' vectors, centred. Fails if they haven't converged after ``max_passes``,
    and where there are fewer than two rows or than ``k`` dimensions."""
    rows = vectors.select(F.col(vector).cast("array<double>").alias("v"))
    n, width = rows.agg(F.count("v"), F.max(F.size("v"))).first()
    if n < 2 or (width or 0) < k:
        raise ValueError(f"{n} vectors of {width} dimensions have no {k} components")
    spark = vectors.sparkSession
    mean = _joined(_sums(rows, lambda x: x.sum(axis=0)[:, None], width), width)[:, 0] / n
    size = min(width, k + extra)
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(width, size)))[0]
    basis, image, passes = np.empty((width, 0)), np.empty((width, 0)), 0
    while True:
        passes += 1
        shared = spark.sparkContext.broadcast((mean, block))

        def times(x: np.ndarray) -> np.ndarray:
            centre, q = shared.value
            x = x - centre
            return x.T @ (x @ q)

        product = _joined(_sums(rows, times, width), width) / (n - 1)
        shared.unpersist()
        basis, image = np.concatenate([basis, block], axis=1), np.concatenate([image, product], axis=1)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(-values)[:size]
        values, turn = values[best], turn[:, best]
        rest = image @ turn - (basis @ turn) * values
        length = np.linalg.norm(rest, axis=0)
        block = _apart(rest, basis)
        if (length[:k] <= tolerance * max(values[0], 1e-300)).all() or not block.shape[1]:
            break
        if passes == max_passes:
            raise RuntimeError(f"components have not converged after {max_passes} passes")
        if basis.shape[1] + block.shape[1] > max(blocks * size, 2 * size):
            basis, image = basis @ turn, image @ turn
    directions = (basis @ turn)[:, :k]
    top = directions[np.abs(directions).argmax(axis=0), np.arange(k)]
    return Components(mean, directions * np.where(top < 0, -1.0, 1.0), np.maximum(values[:k], 0.0), length[:k], passes)


def scores(vectors: DataFrame, found: Components, vector: str = "embedding", out: str = "components") -> DataFrame:
    """The rows with their centred vectors' coordinates along the components."""
    shared = vectors.sparkSession.sparkContext.broadcast((found.mean, found.directions))

    @F.pandas_udf("array<double>")
    def along(v: pd.Series) -> pd.Series:
        mean, directions = shared.value
        return pd.Series(list((np.stack(v.to_numpy()).astype(np.float64) - mean) @ directions)) if len(v) else pd.Series([], dtype=object)

    return vectors.withColumn(out, along(F.col(vector).cast("array<double>")))
