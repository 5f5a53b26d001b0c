"""Regularised logistic regression for many small fits at once, and nearest centroids.

A fit is a key: (replicate, excluded folds, C). All fits of a stage advance
together. In one Newton step every task walks its own rows once, adds up each
fit's gradient and curvature, and sends one vector per fit; Spark sums the
vectors by fit and the solve runs on the summed rows. No group of rows is
ever gathered, so rows may grow without limit. A pass takes as many fits as
keep fits × features² within a task's bound; the rest follow in further passes.
Where one fit's features² alone are over that bound, ``quasi_newton`` reaches the
same optimum with a few vectors per fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlake.functions.scalars import euclidean, inverse_distance
from donorlake.operators.donors import mean_pool
from donorlake.operators import quasi_newton as qn
from donorlake.operators.metrics import auroc
from donorlake.operators.ordering import ONE_WINDOW, hash_rank, union_all, with_group_totals
from donorlake.session import dropped, durable, task_slots, written

# The searched inverse penalties and the fold counts.
C_GRID = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
OUTER_FOLDS, INNER_FOLDS = 5, 5
TASK_ROWS = 2_000  # rows worth a task of their own
MAX_STATE = 16_000_000  # doubles a task may hold for the fits of one pass (128 MB)


@dataclass(frozen=True)
class Fit:
    """Train on rows of ``rep`` outside every (scheme, fold) in ``out``; score the rows inside the last one."""

    rep: int
    out: tuple[tuple[int, int], ...]
    c: float


@dataclass
class Fitted:
    """Coefficients of a stage, in the scaled space of each fit's own training rows."""

    fits: list[Fit]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # last entry is the intercept
    n_train: np.ndarray
    n_cases: np.ndarray
    iterations: int = 0
    converged: np.ndarray | None = None  # per fit; a fit whose training rows have one class has no weights and counts as done
    fill: np.ndarray | None = field(default=None)
    kkt: np.ndarray | None = None  # greatest entry of each fit's gradient


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype("float64")


def _filled(x: np.ndarray, fill: np.ndarray | None) -> np.ndarray:
    return x if fill is None else np.where(np.isnan(x), fill, x)


def _inside(folds: np.ndarray, out) -> tuple[np.ndarray, np.ndarray]:
    """Masks of training rows and of the rows a fit scores."""
    train = np.ones(len(folds), dtype=bool)
    score = np.ones(len(folds), dtype=bool)
    for i, (scheme, fold) in enumerate(out):
        here = folds[:, scheme] == fold
        train &= ~here
        score &= here if i == len(out) - 1 else ~here
    return train, score


def _replicates(pdf: pd.DataFrame) -> Iterator[tuple]:
    """``rep, rows of the batch, features, folds, labels`` of every replicate in a batch.

    Rows come either once per replicate (``rep, label, folds``) or once at all, with the labels and folds of all
    replicates beside the features (``reps, labels, all_folds``).
    """
    x = _matrix(pdf["features"])
    if "reps" in pdf:
        labels = np.stack(pdf["labels"].to_numpy())
        folds = np.stack(pdf["all_folds"].to_numpy()).reshape(*labels.shape, -1)
        everyone = np.arange(len(pdf))
        for j, rep in enumerate(pdf["reps"].iloc[0]):
            yield int(rep), everyone, x, folds[:, j], labels[:, j]
        return
    reps, folds, labels = pdf["rep"].to_numpy(), np.stack(pdf["folds"].to_numpy()), pdf["label"].to_numpy()
    for rep in np.unique(reps):
        at = np.flatnonzero(reps == rep)
        yield int(rep), at, x[at], folds[at], labels[at]


def _sum_by_fit(rows: DataFrame, kernel, width: int) -> DataFrame:
    """Run ``kernel`` over each task's batches, then add the vectors of equal fits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            for fit, stats in kernel(pdf):
                acc[fit] = acc[fit] + stats if fit in acc else stats
        if acc:
            yield pd.DataFrame({"fit": list(acc), "stats": list(acc.values())})

    parts = rows.mapInPandas(run, "fit int, stats array<double>")
    return parts.groupBy("fit").agg(vector_to_array(Summarizer.sum(array_to_vector("stats"))).alias("stats"))


def _by_rep(keys: Sequence[tuple[int, tuple]]) -> dict[int, list[tuple[int, tuple]]]:
    out: dict[int, list] = {}
    for i, (rep, excluded) in enumerate(keys):
        out.setdefault(rep, []).append((i, excluded))
    return out


def _curvature(state, balanced: bool):
    """Per fit: loss, gradient and Hessian of the data term over one batch of rows."""

    def kernel(pdf: pd.DataFrame):
        by_rep, fills, mu, sd, now, n_side, case_side, side = state.value
        for rep, _at, xr, fr, yr in _replicates(pdf):
            seen: dict[int, tuple] = {}
            for _, (i, out) in by_rep.get(rep, ()):
                s = side[i]
                if s not in seen:
                    train, _scored = _inside(fr, out)
                    z = (_filled(xr[train], None if fills is None else fills[s]) - mu[s]) / sd[s]
                    yt = yr[train].astype("float64")
                    weight = np.ones(len(yt))
                    if balanced:
                        weight = np.where(yt == 1, n_side[s] / (2 * case_side[s]), n_side[s] / (2 * (n_side[s] - case_side[s])))
                    seen = {s: (np.column_stack([z, np.ones(len(z))]), yt, weight)}
                z, yt, weight = seen[s]
                m = z @ now[i]
                prob = 1.0 / (1.0 + np.exp(-np.clip(m, -500, 500)))
                loss = (weight * (np.logaddexp(0.0, m) - yt * m)).sum()
                grad = z.T @ (weight * (prob - yt))
                hess = (z * (weight * prob * (1 - prob))[:, None]).T @ z
                yield i, np.concatenate([[loss], grad, hess[np.triu_indices(len(grad))]])

    return kernel


def _newton_step(state, penalty: np.ndarray):
    """Add the penalty to the summed statistics of each fit and solve for its step."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = state.value[4]
        p = now.shape[1] - 1
        for pdf in batches:
            rows = []
            for fit, stats in zip(pdf["fit"], pdf["stats"]):
                s, c, at = np.asarray(stats), penalty[fit], now[fit]
                ridge = np.append(at[:-1], 0.0)
                grad = c * s[1 : p + 2] + ridge
                hess = np.zeros((p + 1, p + 1))
                hess[np.triu_indices(p + 1)] = s[p + 2 :]
                hess = c * (np.triu(hess) + np.triu(hess, 1).T) + np.diag(np.append(np.ones(p), 1e-12))
                rows.append((int(fit), float(c * s[0] + 0.5 * ridge @ ridge), float(np.abs(grad).max()), -np.linalg.solve(hess, grad)))
            yield pd.DataFrame(rows, columns=["fit", "loss", "kkt", "step"])

    return solve


def _ladder(fits, rows, balanced, fills, mean, scale, n, cases, fit_side):
    """The pass of ``quasi_newton``: only what the fits of the pass need is broadcast, and freed again."""
    spark = rows.sparkSession

    def evaluate(live, w, steps, lengths):
        sides = sorted({int(fit_side[i]) for i in live})
        at = {s: k for k, s in enumerate(sides)}
        keys = [(fits[i].rep, (k, at[int(fit_side[i])], fits[i].out)) for k, i in enumerate(live)]
        plan: dict[int, list] = {}
        for rep, entry in keys:
            plan.setdefault(rep, []).append(entry)
        part = lambda x: None if x is None else x[sides]
        state = spark.sparkContext.broadcast((plan, part(fills), mean[sides], scale[sides], n[sides], cases[sides], w, steps, lengths))

        def kernel(pdf: pd.DataFrame):
            plan, fill, mu, sd, n_side, case_side, w, steps, lengths = state.value
            for rep, _at, xr, fr, yr in _replicates(pdf):
                last, z, yt, weight = None, None, None, None
                for k, s, out in sorted(plan.get(rep, ()), key=lambda e: e[1]):
                    if s != last:  # one side's rows are scaled at a time
                        train, _scored = _inside(fr, out)
                        z = (_filled(xr[train], None if fill is None else fill[s]) - mu[s]) / sd[s]
                        z, yt, weight, last = np.column_stack([z, np.ones(len(z))]), yr[train].astype("float64"), np.ones(train.sum()), s
                        if balanced:
                            weight = np.where(yt == 1, n_side[s] / (2 * case_side[s]), n_side[s] / (2 * (n_side[s] - case_side[s])))
                    yield k, qn.ladder_sums(z, yt, weight, w[k], steps[k], lengths[k])

        yield from _collected(_sum_by_fit(rows, kernel, w.shape[1] + len(qn.LADDER)))
        state.destroy()  # the driver's copy goes too

    return evaluate


def _plan_arrays(fits: Sequence[Fit]) -> tuple[np.ndarray, np.ndarray]:
    """Replicates of the fits, and ``fit × depth × (scheme, fold)`` of what they leave out."""
    return np.array([f.rep for f in fits]), np.array([f.out for f in fits]).reshape(len(fits), -1, 2)


def _fit_blocks(pdf: pd.DataFrame, rep: np.ndarray, out: np.ndarray, held: bool = False) -> Iterator[tuple]:
    """``which fits, rows × fits: training (or, if held, scored) rows, labels`` over packed rows, some fits at a time."""
    labels = np.stack(pdf["labels"].to_numpy())
    folds = np.stack(pdf["all_folds"].to_numpy()).reshape(*labels.shape, -1)
    at, step = np.searchsorted(pdf["reps"].iloc[0], rep), max(1, 1_000_000 // len(pdf))
    for start in range(0, len(rep), step):
        s = slice(start, min(len(rep), start + step))
        mask = np.ones((len(pdf), s.stop - start), bool)
        for depth in range(out.shape[1]):
            here = folds[:, at[s], out[s, depth, 0]] == out[s, depth, 1]
            mask &= here if held and depth == out.shape[1] - 1 else ~here
        yield s, mask, labels[:, at[s]]


def _fit_together(rows: DataFrame, fits: Sequence[Fit], p: int, tolerance: float) -> Fitted | None:
    """``shared`` of ``fit_logistic`` over packed rows; None where a fit needs one of the other solvers."""
    if len({len(f.out) for f in fits}) != 1:
        return None
    spark, (rep, out) = rows.sparkSession, _plan_arrays(fits)
    centre = rows.agg(vector_to_array(Summarizer.mean(array_to_vector("features"))).alias("m")).head()["m"]
    centre = np.asarray(centre, dtype="float64")
    if not np.isfinite(centre).all():
        return None
    plan = spark.sparkContext.broadcast((rep, out, centre))

    def moments(pdf: pd.DataFrame):
        rep, out, centre = plan.value
        x = _matrix(pdf["features"]) - centre
        yield -1, np.concatenate([[len(x)], (x.T @ x).ravel()])
        for s, train, y in _fit_blocks(pdf, rep, out):
            part = train.astype("float64")
            sums = np.column_stack([part.sum(axis=0), (part * y).sum(axis=0), part.T @ x, part.T @ (x * x)])
            yield from zip(range(s.start, s.stop), sums)

    n, cases, near, square = np.zeros(len(fits)), np.zeros(len(fits)), np.zeros((len(fits), p)), np.zeros((len(fits), p))
    for fit, s in _collected(_sum_by_fit(rows, moments, 2 + 2 * p)):
        if fit < 0:
            everyone, products = s[0], s[1:].reshape(p, p)
        else:
            n[fit], cases[fit], near[fit], square[fit] = s[0], s[1], s[2 : 2 + p], s[2 + p :]
    if not n.all():
        return None
    near, square = near / n[:, None], square / n[:, None]
    mean, variance = centre + near, square - near * near
    flat = square <= (1e-12 * np.abs(centre)) ** 2
    if (variance[~flat] < 1e-6 * square[~flat]).any():
        return None  # a feature that hardly varies in training: its spread needs sums around its own mean
    scale = np.where(flat, np.inf, np.sqrt(np.where(flat, 1.0, variance)))
    live = np.flatnonzero((cases > 0) & (cases < n))
    penalty = np.array([f.c for f in fits])
    spread = np.sqrt(np.diag(products) / everyone)
    unit = np.where(spread > 0, spread, np.inf)
    shape, turn = np.linalg.eigh(products / everyone / unit[:, None] / unit[None, :])
    share = cases[live] / n[live]
    strength = penalty[live] * n[live] * share * (1 - share)

    def curved(which: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The inverse of the null model's curvature, times a vector of each fit."""
        by = 1.0 + strength[which, None] * np.maximum(shape, 0.0)
        return np.column_stack([(g[:, :-1] @ turn / by) @ turn.T, g[:, -1] / strength[which]])

    def evaluate(which: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = live[which]
        state = spark.sparkContext.broadcast((rep[mine], out[mine], centre, near[mine], scale[mine], w))

        def kernel(pdf: pd.DataFrame):
            rep, out, centre, near, scale, w = state.value
            x = _matrix(pdf["features"]) - centre
            for s, train, y in _fit_blocks(pdf, rep, out):
                v = w[s, :-1] / scale[s]
                m = x @ v.T + (w[s, -1] - (near[s] * v).sum(axis=1))
                e = np.exp(-np.abs(m))
                loss = (train * (np.maximum(m, 0.0) + np.log1p(e) - y * m)).sum(axis=0)
                off = train * (np.where(m >= 0, 1.0, e) / (1.0 + e) - y)
                side = off.sum(axis=0)
                grad = (off.T @ x - near[s] * side[:, None]) / scale[s]
                yield from zip(range(s.start, s.stop), np.column_stack([loss, grad, side]))

        sums = np.zeros((len(mine), p + 2))
        for fit, s in _collected(_sum_by_fit(rows, kernel, p + 2)):
            sums[fit] = s
        state.destroy()
        return sums[:, 0], sums[:, 1:]

    w, kkt, reached, passes = qn.minimise_together(penalty[live], p, evaluate, curved, tolerance)
    plan.destroy()
    if not reached.all():
        return None
    weights, norms = np.full((len(fits), p + 1), np.nan), np.full(len(fits), np.nan)
    weights[live], norms[live] = w, kkt
    return Fitted(list(fits), mean, scale, weights, n.astype(int), cases.astype(int), passes, np.ones(len(fits), bool), None, norms)


BLOCK_FEATURES = 4096  # features of a block of ``_fit_by_rows``


def _fit_by_rows(rows: DataFrame, fits: Sequence[Fit], p: int, balanced: bool, scaled: Sequence[bool] | None, tolerance: float, max_passes: int) -> Fitted | None:
    """The matrix-free fit of fewer rows than features, in coordinates of the rows; None where it doesn't apply.

    The steps never leave the span of the training rows. So the rows are cut into blocks of features once, a pass over the
    blocks adds up each side's inner products of scaled rows, the same quasi-Newton steps go on among those (Newton's
    method ends them), and a second pass gives the weights and the gradient of every feature at them.
    """
    n_rows, sides = rows.count(), list(dict.fromkeys((f.rep, f.out) for f in fits))
    if "reps" in rows.columns or n_rows >= p or n_rows * len(sides) > BLOCK_FEATURES:
        return None
    spark, width = rows.sparkSession, BLOCK_FEATURES
    cut = F.transform(F.sequence(F.lit(0), F.lit(-(-p // width) - 1)), lambda i: F.slice("features", i * width + 1, F.lit(width)))
    blocks = rows.select(F.monotonically_increasing_id().alias("_ix"), "rep", "label", "folds", F.posexplode(cut).alias("block", "x"))
    blocks = written(blocks, "fit-blocks")
    table = blocks.where("block = 0").select("_ix", "rep", "label", "folds").toPandas().sort_values("_ix")
    rep, folds, y = table["rep"].to_numpy(), np.stack(table["folds"].to_numpy()), table["label"].to_numpy().astype("float64")
    masks = [(rep == r) & _inside(folds, out)[0] for r, out in sides]
    n, cases = np.array([m.sum() for m in masks]), np.array([y[m].sum() for m in masks])
    if not n.all():
        return None
    fixed = None if scaled is None else ~np.asarray(scaled, dtype=bool)

    def scaled_rows(pdf: pd.DataFrame) -> Iterator[tuple]:
        """``mean, scale, scaled training rows`` of every side, over one block."""
        pdf = pdf.sort_values("_ix")
        x, at = _matrix(pdf["x"]), int(pdf["block"].iloc[0]) * width
        for mask in masks:
            mean = x[mask].mean(axis=0)
            sd = np.sqrt(((x[mask] - mean) ** 2).mean(axis=0))
            sd = np.where(sd <= 1e-12 * np.maximum(np.abs(mean), 1e-300), np.inf, sd)
            if fixed is not None:
                off = fixed[at : at + len(mean)]
                mean, sd = np.where(off, 0.0, mean), np.where(off, 1.0, sd)
            yield mean, sd, (x[mask] - mean) / sd

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(s, (z @ z.T).ravel()) for s, (_, _, z) in enumerate(scaled_rows(pdf))], columns=["fit", "stats"])

    sums = blocks.groupBy("block").applyInPandas(products, "fit int, stats array<double>")
    sums = sums.groupBy("fit").agg(vector_to_array(Summarizer.sum(array_to_vector("stats"))).alias("stats"))
    inner = {s: k.reshape(n[s], n[s]) for s, k in _collected(sums, few=False)}
    if not all(np.isfinite(k).all() for k in inner.values()):
        dropped(blocks)
        return None
    at_side, live, passes = [sides.index((f.rep, f.out)) for f in fits], [], 0
    shares, slopes, starts = [np.zeros(0)] * len(fits), [np.zeros(0)] * len(fits), [np.zeros(0)] * len(fits)
    intercepts = np.full(len(fits), np.nan)
    for i, (f, s) in enumerate(zip(fits, at_side)):
        if cases[s] in (0, n[s]):
            continue
        live.append(i)
        ys, weight = y[masks[s]], np.ones(n[s])
        if balanced:
            weight = np.where(ys == 1, n[s] / (2 * cases[s]), n[s] / (2 * (n[s] - cases[s])))
        values, turn = np.linalg.eigh(inner[s])
        z = np.column_stack([turn * np.sqrt(np.maximum(values, 0.0)), np.ones(n[s])])
        evaluate = lambda _, w, steps, lengths: [(0, qn.ladder_sums(z, ys, weight, w[0], steps[0], lengths[0]))]
        w, _, _, made = qn.minimise([f], n[s], np.array([f.c]), evaluate, MAX_STATE, max(tolerance, 1e-9), max_passes)
        passes, margin, b = passes + made, z @ w[0], w[0][-1]
        pull = lambda m: f.c * weight * (1.0 / (1.0 + np.exp(-np.clip(m, -500, 500))) - ys)
        a = -pull(margin)  # the weights are the rows' sum with these shares, at the optimum
        for _ in range(8):
            margin = inner[s] @ a + b
            prob = 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))
            bend = f.c * weight * prob * (1 - prob)
            system = np.block([[np.eye(n[s]) + bend[:, None] * inner[s], bend[:, None]], [np.ones((1, n[s])), np.zeros((1, 1))]])
            step = np.linalg.lstsq(system, -np.append(a + pull(margin), a.sum()), rcond=None)[0]
            a, b = a + step[:-1], b + step[-1]
        shares[i], slopes[i], starts[i], intercepts[i] = a, pull(inner[s] @ a + b), pull(np.zeros(n[s])), b
    plan = spark.sparkContext.broadcast((at_side, live, shares, slopes, starts))

    def finished(pdf: pd.DataFrame) -> pd.DataFrame:
        at_side, live, shares, slopes, starts = plan.value
        sides = list(scaled_rows(pdf))
        w, top = np.full((len(at_side), len(sides[0][0])), np.nan), np.full((2, len(at_side)), np.nan)
        for i in live:
            z = sides[at_side[i]][2]
            w[i] = shares[i] @ z
            top[:, i] = np.abs(slopes[i] @ z + w[i]).max(), np.abs(starts[i] @ z).max()
        packed = [np.stack([e[j] for e in sides]).tobytes() for j in (0, 1)]
        return pd.DataFrame([(int(pdf["block"].iloc[0]), *packed, w.tobytes(), top.tobytes())], columns=["block", "mean", "scale", "w", "top"])

    mean, scale = np.empty((len(fits), p)), np.empty((len(fits), p))
    weights, kkt, start = np.full((len(fits), p + 1), np.nan), np.full(len(fits), np.nan), np.full(len(fits), np.nan)
    few = blocks.repartition(-(-p // (16 * width)), "block")  # a partition comes to the driver at a time
    done = written(few.groupBy("block").applyInPandas(finished, "block int, mean binary, scale binary, w binary, top binary"), "fit-weights")
    for row in done.toLocalIterator():
        where, part = slice(row["block"] * width, min(p, (row["block"] + 1) * width)), lambda c, k: np.frombuffer(row[c]).reshape(k, -1)
        mean[:, where], scale[:, where] = part("mean", len(sides))[at_side], part("scale", len(sides))[at_side]
        weights[:, :-1][:, where] = part("w", len(fits))
        kkt, start = (np.fmax(a, b) for a, b in zip((kkt, start), part("top", 2)))
    plan.destroy()
    dropped(blocks, done)
    weights[:, -1] = intercepts
    reached = np.ones(len(fits), bool)
    for i in live:
        edge = abs(slopes[i].sum())  # the intercept's part of the gradient
        kkt[i], reached[i] = max(kkt[i], edge), max(kkt[i], edge) <= max(tolerance, 1e-9) * max(1.0, start[i], abs(starts[i].sum()))
    if not reached.all():
        return None
    return Fitted(list(fits), mean, scale, weights, n[at_side].astype(int), cases[at_side].astype(int), passes, reached, None, kkt)


def _collected(sums: DataFrame, few: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of ``_sum_by_fit`` on the driver: ``few`` as plain doubles in one job, others a partition at a time."""
    if not few:
        for row in sums.toLocalIterator():
            yield row["fit"], np.asarray(row["stats"])
        return
    for batch in sums.toArrow().to_batches():
        ends = batch.column(1).offsets.to_numpy()
        flat = batch.column(1).values.to_numpy()
        for i, fit in enumerate(batch.column(0).to_pylist()):
            yield fit, flat[ends[i] : ends[i + 1]]


def fit_logistic(
    rows: DataFrame,
    fits: Sequence[Fit],
    size: int,
    balanced: bool = False,
    scaled: Sequence[bool] | None = None,
    fill: np.ndarray | None = None,
    tolerance: float = 1e-10,
    max_iter: int = 60,
    on_unconverged: str = "fail",
    solver: str | None = None,
) -> Fitted:
    """Minimise ½‖w‖² + C·Σ loss with a free intercept for every fit.

    ``rows`` holds ``rep, label, features array<double>, folds array<int>``, or is the result of ``pack_replicates``.
    Features are standardised with each fit's training mean and population sd; a
    feature that is constant in training gets scale infinity, so its weight and
    its contribution are exactly 0. ``scaled`` switches that off per column. NaN features
    take the fit's ``fill`` values. ``balanced`` weighs classes by n / (2·n_class).
    Fits that haven't converged after ``max_iter`` steps fail, or are told apart by ``converged`` with ``keep``.
    ``solver`` is ``newton`` (features² doubles per fit), ``matrix-free`` (a few vectors per fit), or the first wherever
    one fit fits a task. ``shared`` is for many fits of packed rows that are near the null model, such as permuted labels:
    all fits of a task are two matrix products, and their steps share one curvature; where that isn't enough the others
    take over. The greatest entry of every fit's gradient is in ``kkt``.
    """
    fits = list(fits)
    p = size
    width = 1 + (p + 1) + (p + 1) * (p + 2) // 2
    per_pass = max(1, MAX_STATE // width)
    spark = rows.sparkSession
    if solver == "shared":
        together = "reps" in rows.columns and width <= MAX_STATE and not balanced and scaled is None and fill is None
        fitted = _fit_together(rows, fits, p, tolerance) if together else None
        if fitted is not None:
            return fitted
        solver = None
    if fill is None and not (width <= MAX_STATE if solver is None else solver == "newton"):
        fitted = _fit_by_rows(rows, fits, p, balanced, scaled, tolerance, 20 * max_iter)
        if fitted is not None:
            return fitted
    # Fits that differ in C only share their training rows and thus their moments.
    sides = list(dict.fromkeys((f.rep, f.out) for f in fits))
    side_of = {s: i for i, s in enumerate(sides)}
    fit_side = np.array([side_of[(f.rep, f.out)] for f in fits])
    side_fill = None
    if fill is not None:
        side_fill = np.zeros((len(sides), p))
        side_fill[fit_side] = fill

    plan = spark.sparkContext.broadcast((_by_rep(sides), side_fill))

    def moments(pdf: pd.DataFrame):
        by_rep, fills = plan.value
        for rep, _at, xr, fr, yr in _replicates(pdf):
            for i, out in by_rep.get(rep, ()):
                train, _ = _inside(fr, out)
                x = _filled(xr[train], None if fills is None else fills[i])
                yield i, np.concatenate([[train.sum(), yr[train].sum()], x.sum(axis=0), (x * x).sum(axis=0)])

    mean, scale = np.zeros((len(sides), p)), np.ones((len(sides), p))
    n, cases = np.zeros(len(sides)), np.zeros(len(sides))
    few = 2 * len(sides) * (p + 1) <= MAX_STATE // 4
    for fit, s in _collected(_sum_by_fit(rows, moments, 2 + 2 * p), few):
        n[fit], cases[fit] = s[0], s[1]
        mean[fit] = s[2 : 2 + p] / s[0]
    plan.destroy()
    # A second pass over centred values keeps the variance exact for large means.
    centre = spark.sparkContext.broadcast((_by_rep(sides), side_fill, mean))

    def spread(pdf: pd.DataFrame):
        by_rep, fills, mu = centre.value
        for rep, _at, xr, fr, _y in _replicates(pdf):
            for i, out in by_rep.get(rep, ()):
                train, _ = _inside(fr, out)
                d = _filled(xr[train], None if fills is None else fills[i]) - mu[i]
                yield i, (d * d).sum(axis=0)

    for fit, s in _collected(_sum_by_fit(rows, spread, p), few):
        sd = np.sqrt(s / n[fit])
        flat = sd <= 1e-12 * np.maximum(np.abs(mean[fit]), 1e-300)
        scale[fit] = np.where(flat, np.inf, sd)
    centre.destroy()
    if scaled is not None:
        off = ~np.asarray(scaled, dtype=bool)
        mean[:, off], scale[:, off] = 0.0, 1.0
    one_class = (cases[fit_side] == 0) | (cases[fit_side] == n[fit_side])

    # Damped Newton. ``w`` is the point being tried, ``good`` the last accepted one.
    w = np.zeros((len(fits), p + 1))
    good, good_loss = w.copy(), np.full(len(fits), np.inf)
    active, kkt = ~one_class, np.full(len(fits), np.nan)
    penalty = np.array([f.c for f in fits])
    rounds = 0
    matrices = width <= MAX_STATE if solver is None else solver == "newton"
    if not matrices:
        left = np.flatnonzero(active)
        evaluate = _ladder([fits[i] for i in left], rows, balanced, side_fill, mean, scale, n, cases, fit_side[left])
        good[left], kkt[left], reached, rounds = qn.minimise(
            [fits[i] for i in left], p, penalty[left], evaluate, MAX_STATE, max(tolerance, 1e-9), 20 * max_iter
        )
        active[left] = ~reached
    while matrices and active.any() and rounds < max_iter:
        rounds += 1
        live = np.flatnonzero(active)
        for start in range(0, len(live), per_pass):
            chunk = live[start : start + per_pass]
            state = spark.sparkContext.broadcast(
                (_by_rep([(fits[i].rep, (i, fits[i].out)) for i in chunk]), side_fill, mean, scale, w, n, cases, fit_side)
            )
            stepped = _sum_by_fit(rows, _curvature(state, balanced), width).mapInPandas(
                _newton_step(state, penalty), "fit int, loss double, kkt double, step array<double>"
            )
            # At most MAX_STATE doubles in all. One job: an iterator would sum and solve the partitions one after the other.
            for row in (r for batch in stepped.toArrow().to_batches() for r in batch.to_pylist()):
                i, loss, step = row["fit"], row["loss"], np.asarray(row["step"])
                if loss > good_loss[i] + 1e-9 * max(1.0, abs(good_loss[i])):
                    w[i] = (w[i] + good[i]) / 2.0
                    continue
                good[i], good_loss[i], kkt[i] = w[i].copy(), loss, row["kkt"]
                if np.abs(step).max() <= tolerance * max(1.0, np.abs(w[i]).max()):
                    active[i] = False
                else:
                    w[i] = w[i] + step
            state.destroy()
    if active.any() and on_unconverged == "fail":
        raise RuntimeError(f"{int(active.sum())} of {len(fits)} fits have not converged after {max_iter} steps")
    good[one_class] = np.nan
    return Fitted(fits, mean[fit_side], scale[fit_side], good, n[fit_side].astype(int), cases[fit_side].astype(int), rounds, ~active, fill, kkt)


def _passes(n: int, p: int) -> list[range]:
    """Fits in groups whose coefficients a driver and a task can hold."""
    size = max(1, MAX_STATE // (p + 1))
    return [range(start, min(n, start + size)) for start in range(0, n, size)]


def score_fits(rows: DataFrame, fitted: Fitted, keep: Sequence[str] = ("donor_id",), everyone: bool = False) -> DataFrame:
    """Probability of class 1 for the rows each fit left out last (or for all rows): ``fit, rep, keep…, label, score``."""
    passes = _passes(len(fitted.fits), 3 * fitted.weights.shape[1])
    if len(passes) > 1:  # the weights of one pass are broadcast at a time
        part = lambda a, at: None if a is None else a[at.start : at.stop]
        done = [
            score_fits(rows, Fitted(fitted.fits[at.start : at.stop], *(part(a, at) for a in (fitted.mean, fitted.scale, fitted.weights, fitted.n_train, fitted.n_cases)), fill=part(fitted.fill, at)), keep, everyone)
            .withColumn("fit", F.col("fit") + at.start)
            for at in passes
        ]
        return union_all(done)
    schema = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = ", ".join(f"`{c}` {schema[c]}" for c in keep)
    state = (_by_rep([(f.rep, (i, f.out)) for i, f in enumerate(fitted.fits)]), fitted.mean, fitted.scale, fitted.weights, fitted.fill)
    bc = rows.sparkSession.sparkContext.broadcast(state)
    if "reps" in rows.columns and fitted.fill is None and not everyone and len({len(f.out) for f in fitted.fits}) == 1:
        return rows.mapInPandas(_score_packed(bc, *_plan_arrays(fitted.fits), list(keep)), f"fit int, rep int, {head}, label int, score double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_rep, mean, scale, weights, fill = bc.value
        for pdf in batches:
            for rep, at, xr, fr, yr in _replicates(pdf):
                for _, (i, out) in by_rep.get(rep, ()):
                    inside = np.ones(len(at), bool) if everyone else _inside(fr, out)[1]
                    if not inside.any():
                        continue
                    x = _filled(xr[inside], None if fill is None else fill[i])
                    m = ((x - mean[i]) / scale[i]) @ weights[i][:-1] + weights[i][-1]
                    part = pdf.iloc[at[inside]][[*keep]].copy()
                    part["fit"], part["rep"], part["label"] = i, rep, yr[inside]
                    part["score"] = 1.0 / (1.0 + np.exp(-np.clip(m, -500, 500)))
                    yield part[["fit", "rep", *keep, "label", "score"]]

    return rows.mapInPandas(run, f"fit int, rep int, {head}, label int, score double")


def _score_packed(bc, rep: np.ndarray, out: np.ndarray, keep: list[str]):
    """``score_fits`` over packed rows: the margins of many fits are one matrix product."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, mean, scale, weights, _ = bc.value
        for pdf in batches:
            x = _matrix(pdf["features"])
            centre = x.mean(axis=0)
            for s, held, y in _fit_blocks(pdf, rep, out, held=True):
                v = weights[s, :-1] / scale[s]
                m = (x - centre) @ v.T + (weights[s, -1] + ((centre - mean[s]) * v).sum(axis=1))
                at, fit = np.nonzero(held)
                part = pdf.iloc[at][keep].reset_index(drop=True)
                part["fit"], part["rep"], part["label"] = fit + s.start, rep[s][fit], y[at, fit]
                part["score"] = 1.0 / (1.0 + np.exp(-np.clip(m[at, fit], -500, 500)))
                yield part[["fit", "rep", *keep, "label", "score"]]

    return run


# --- cross-validation -----------------------------------------------------------


def fold_rows(
    donors: DataFrame, seed: int, outer: int = OUTER_FOLDS, inner: int = INNER_FOLDS, key: str = "donor_id", label: str = "label",
    largest: int | None = None,
) -> DataFrame:
    """Attach ``folds``: the outer fold, then for each outer fold the inner fold inside its training side (−1 for its
    test rows). Input may hold several replicates in ``rep``; each is stratified on its own labels."""
    from donorlake.operators.splits import shuffled_kfold

    base = donors if "rep" in donors.columns else donors.withColumn("rep", F.lit(0))
    base = base.withColumn("label", F.col(label).cast("int"))
    out = shuffled_kfold(base, outer, "label", seed, key, by=["rep"], largest=largest).withColumnRenamed("fold", "_outer")
    if not inner:
        return out.withColumn("folds", F.array("_outer")).drop("_outer")
    spread = out.select("rep", key, "label", "_outer", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))).alias("_o"))
    nested = shuffled_kfold(spread.where(F.col("_o") != F.col("_outer")), inner, "label", seed + 1, key, by=["rep", "_o"], largest=largest)
    pick = lambda o: F.coalesce(F.max(F.when(F.col("_o") == o, F.col("fold"))), F.lit(-1))
    arrays = nested.groupBy("rep", key).agg(F.array(*[pick(o) for o in range(outer)]).alias("_inner"))
    joined = out.join(arrays, ["rep", key])
    return joined.withColumn("folds", F.concat(F.array("_outer"), F.col("_inner"))).drop("_outer", "_inner")


def _gathered(placed: DataFrame) -> DataFrame:
    """Written rows in as many partitions as their number is worth: all cores, and more from ``TASK_ROWS`` rows a task on.

    Every task of a step sends one vector per fit, so tasks of few rows would send far more than they read.
    """
    cores = placed.sparkSession.sparkContext.defaultParallelism
    return placed.coalesce(max(cores, -(-placed.count() // TASK_ROWS)))


def _place(rows: DataFrame, key: str) -> DataFrame:
    """Write the model rows once, spread over all tasks, before iterating on them."""
    slots = task_slots(rows.sparkSession)
    slim = rows.select("rep", key, "label", "features", "folds")
    return _gathered(durable(slim.repartition(slots, "rep", key)))


def pack_replicates(folded: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Every donor once, with the labels and folds of all replicates as arrays beside its features. Written once."""
    slots = task_slots(folded.sparkSession)
    each = F.array_sort(F.collect_list(F.struct("rep", "label", "folds")))  # one entry per replicate
    packed = folded.groupBy(key).agg(each.alias("_r"))
    part = lambda field: F.transform("_r", lambda r: r[field])
    slim = packed.select(key, part("rep").alias("reps"), part("label").alias("labels"), F.flatten(part("folds")).alias("all_folds"))
    return _gathered(durable(slim.join(features.select(key, "features"), key).repartition(slots, key)))


def nested_cv(
    donors: DataFrame,
    seed: int,
    c_grid: Sequence[float] = C_GRID,
    outer: int = OUTER_FOLDS,
    inner: int = INNER_FOLDS,
    fixed_c: float | None = None,
    key: str = "donor_id",
    label: str = "label",
    balanced: bool = False,
    reps: Sequence[int] = (0,),
    features: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold scores (every row scored once) and the C of every outer fold.

    With ``fixed_c`` the inner search is skipped. Scalers and fits see training rows only. With ``features``, donors
    holds just ``rep`` and label of every replicate, and features are kept once for all of them.
    """
    largest = (donors if features is None else features).count()  # rows that a replicate has at most
    folded = fold_rows(donors, seed, outer, 0 if fixed_c is not None else inner, key, label, largest)
    rows = _place(folded, key) if features is None else pack_replicates(folded, features, key)
    size = rows.select(F.max(F.size("features"))).head()[0]
    spark = rows.sparkSession
    if fixed_c is not None:
        chosen = {(r, o): float(fixed_c) for r in reps for o in range(outer)}
    else:
        search = [Fit(r, ((0, o), (1 + o, i)), c) for r in reps for o in range(outer) for i in range(inner) for c in c_grid]
        per_fit: dict[int, float] = {}
        for held in _passes(len(search), 3 * size):  # weights of a pass are dropped when it is scored
            fitted = fit_logistic(rows, search[held.start : held.stop], size, balanced)
            scored = score_fits(rows, fitted, [key]).where("score IS NOT NULL")  # a fold with one class has no fit
            for row in auroc(scored, by=["fit"]).select("fit", "auroc").collect():
                per_fit[held.start + row["fit"]] = row["auroc"]
        table = pd.DataFrame([(f.rep, f.out[0][1], f.c) for f in search], columns=["rep", "fold", "c"])
        table["auroc"] = [per_fit.get(i) for i in range(len(search))]
        means = table.groupby(["rep", "fold", "c"], as_index=False)["auroc"].mean()
        means["auroc"] = means["auroc"].round(12)
        best = means.sort_values(["rep", "fold", "auroc", "c"], ascending=[True, True, False, True]).groupby(["rep", "fold"]).head(1)
        chosen = {(int(r), int(o)): float(c) for r, o, c in best[["rep", "fold", "c"]].itertuples(index=False)}
    final = [Fit(r, ((0, o),), chosen[(r, o)]) for r in reps for o in range(outer)]
    fitted = fit_logistic(rows, final, size, balanced, solver="shared" if fixed_c is not None and features is not None else None)
    oof = score_fits(rows, fitted, [key]).select("rep", key, "label", (F.col("fit") % outer).alias("fold"), "score")
    picks = [(r, o, c) for (r, o), c in chosen.items()]
    return oof, spark.createDataFrame(picks, "rep int, fold int, c double")


def frozen_c(selected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median of the C values the outer folds picked."""
    return selected.groupBy(*by).agg(F.percentile("c", F.lit(0.5)).alias("c_frozen"))


def best_c(scores: DataFrame, by: Sequence[str], c: str = "c", score: str = "score") -> DataFrame:
    """Highest mean score per group; ties go to the smaller C."""
    means = scores.groupBy(*by, c).agg(F.avg(score).alias("_m"))
    return means.groupBy(*by).agg(F.max_by(c, F.struct(F.col("_m"), -F.col(c))).alias(c), F.max("_m").alias(score))


def repeated_cv(donors: DataFrame, n: int, seed: int, **options) -> DataFrame:
    """AUROC of nested CV for each of ``n`` fold assignments, ``repeat, auroc``.

    The repeat is part of the key of folds and fits, so all repeats advance in the same jobs.
    """
    key, label = options.get("key", "donor_id"), options.get("label", "label")
    rows = donors.select(key, label).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    oof, _ = nested_cv(rows, seed, reps=range(n), features=donors, **options)
    return auroc(oof, by=["rep"]).withColumnRenamed("rep", "repeat").select("repeat", "auroc")


def repeated_summary(aurocs: DataFrame, by: Sequence[str] = ("arm",)) -> DataFrame:
    return aurocs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_repeats"), F.avg("auroc").alias("mean"), F.stddev_samp("auroc").alias("sd"),
        F.min("auroc").alias("min"), F.max("auroc").alias("max"),
    )


def loocv(
    donors: DataFrame, c: float = 0.1, key: str = "donor_id", label: str = "label", balanced: bool = True,
    scaled: Sequence[bool] | None = None, fills: DataFrame | None = None,
) -> DataFrame:
    """Leave-one-out scores with a refit per donor.

    Refitting every donor is quadratic by definition. The refits run in passes
    over the held-out donors whose coefficients fit in memory; the scores of a
    pass are written before the next one starts. ``fills`` gives each held-out donor the
    training imputation vector (``fill array<double>``) of its own fold.
    """
    from donorlake.operators.splits import leave_one_out

    n = donors.count()
    if n < 3:
        raise ValueError("leave-one-out needs at least three donors")
    ranked = leave_one_out(donors.withColumn("label", F.col(label).cast("int")), key)
    fold = F.substring(F.col("fold_id"), 7, 20).cast("int") - 1
    rows = ranked.withColumns({"rep": F.lit(0), "folds": F.array(fold)})
    placed = _place(rows, key)
    size = placed.select(F.max(F.size("features"))).head()[0]
    per_fold = None if fills is None else placed.join(fills, key).select(F.col("folds")[0].alias("f"), "fill")
    spark, parts = donors.sparkSession, []
    for held in _passes(n, size):
        fill = None
        if per_fold is not None:
            fill = np.zeros((len(held), size))
            for row in per_fold.where(F.col("f").between(held.start, held.stop - 1)).toLocalIterator():
                fill[row["f"] - held.start] = row["fill"]
        fitted = fit_logistic(placed, [Fit(0, ((0, i),), c) for i in held], size, balanced, scaled, fill)
        if np.isnan(fitted.weights).any():
            raise ValueError("a fold has only one class in training")
        sizes = spark.createDataFrame(
            [(i, held[i], int(t), int(k), int(t - k)) for i, (t, k) in enumerate(zip(fitted.n_train, fitted.n_cases))],
            "fit int, _fold int, n_train int, n_train_cases int, n_train_controls int",
        )
        part = score_fits(placed, fitted, [key]).join(sizes, "fit").drop("fit").withColumnRenamed("_fold", "fit")
        parts.append(durable(part) if held.stop < n else part)
    scored = union_all(parts)
    number = (F.col("fit") + 1).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return scored.select(
        F.concat(F.lit("loocv_"), padded).alias("fold_id"), key, "label", "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_train", "n_train_cases", "n_train_controls",
    )


def shuffled_labels(donors: DataFrame, n: int, seed: int, key: str = "donor_id", label: str = "label") -> DataFrame:
    """Rows once per replicate with permuted labels of the same class sizes (``rep`` 0…n−1)."""
    slots = task_slots(donors.sparkSession)
    positives, largest = donors.agg(F.sum(label).alias("_p")), donors.count()
    spread = donors.repartition(slots, key).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if largest <= ONE_WINDOW:
        spread = spread.repartition(slots, "rep")  # labels, and folds within labels, are drawn where a replicate's rows lie
    ranked = with_group_totals(hash_rank(spread, key, seed, by=["rep"], name="_pos", largest=largest), positives, [])
    return ranked.withColumn(label, (F.col("_pos") <= F.col("_p")).cast("int")).drop("_pos", "_p")


def permutation_refit(donors: DataFrame, n: int, seed: int, key: str = "donor_id", label: str = "label", stage: int | None = None, **options) -> DataFrame:
    """AUROC of the whole cross-validation refitted on permuted labels, per replicate.

    ``fixed_c`` in ``options`` skips the inner search. Replicates run in stages (``stage`` at a time, or as many as
    have bounded weights) so that the state of one stage stays bounded; the scores of a stage are written.
    """
    frames = []
    if stage is None:
        size = donors.select(F.max(F.size("features"))).head()[0]
        stage = min(500, max(1, MAX_STATE // (3 * (size + 1) * options.get("outer", OUTER_FOLDS))))
    for start in range(0, n, stage):
        count = min(stage, n - start)
        rows = shuffled_labels(donors.select(key, label), count, seed + 7919 * start, key, label)
        oof, _ = nested_cv(rows, seed, key=key, label=label, reps=range(count), features=donors, **options)
        part = auroc(oof, by=["rep"]).select((F.col("rep") + start).alias("replicate"), "auroc")
        frames.append(durable(part) if n > stage else part)
    return union_all(frames)


def permutation_loocv(
    donors: DataFrame, n: int, seed: int, c: float = 0.1, key: str = "donor_id", label: str = "label",
    scaled: Sequence[bool] | None = None, fills: DataFrame | None = None,
) -> DataFrame:
    """Permutation control with a full leave-one-out refit per replicate; a replicate in which a training side has one
    class is reported as skipped instead of scored. ``fills`` holds each held-out donor's imputation vector, as in
    ``loocv``; it doesn't depend on labels, so all replicates share it."""
    size_n = donors.count()
    from donorlake.operators.splits import leave_one_out

    ranked = leave_one_out(donors, key)
    fold = F.substring(F.col("fold_id"), 7, 20).cast("int") - 1
    rows = shuffled_labels(ranked.withColumn("folds", F.array(fold)).drop("fold_id"), n, seed, key, label)
    placed = _place(rows.withColumn("label", F.col(label).cast("int")), key)
    size = placed.select(F.max(F.size("features"))).head()[0]
    per_fold = None
    if fills is not None:
        per_fold = placed.where("rep = 0").join(fills, key).select(F.col("folds")[0].alias("f"), "fill")
    bad, parts = set(), []
    for part in _passes(n * size_n, size):
        fits = [Fit(k // size_n, ((0, k % size_n),), c) for k in part]
        fill = None
        if per_fold is not None:
            held = sorted({k % size_n for k in part})
            by_fold = {r["f"]: r["fill"] for r in per_fold.where(F.col("f").between(held[0], held[-1])).toLocalIterator()}
            fill = np.array([by_fold[k % size_n] for k in part])
        fitted = fit_logistic(placed, fits, size, True, scaled, fill)
        bad |= {f.rep for f, w in zip(fits, fitted.weights) if np.isnan(w).any()}
        scored = score_fits(placed, fitted, [key]).where("score IS NOT NULL")
        parts.append(durable(scored) if part.stop < n * size_n else scored)
    skipped = F.col("rep").isin(*bad) if bad else F.lit(False)
    found = auroc(union_all(parts), by=["rep"]).select("rep", F.when(~skipped, F.col("auroc")).alias("auroc"))
    everyone = placed.select("rep").distinct()  # a replicate without a single fit is reported too
    out = everyone.join(found, "rep", "left").withColumnRenamed("rep", "replicate")
    return out.withColumn("status", F.when(F.col("auroc").isNull(), "skipped_one_class_fold").otherwise("valid"))


def fit_final(donors: DataFrame, c: float, key: str = "donor_id", label: str = "label", balanced: bool = False) -> Fitted:
    """One fit on all rows at a frozen C."""
    rows = donors.withColumns({"rep": F.lit(0), "label": F.col(label).cast("int"), "folds": F.array(F.lit(0))})
    placed = _place(rows, key)
    size = placed.select(F.max(F.size("features"))).head()[0]
    return fit_logistic(placed, [Fit(0, ((0, -1),), c)], size, balanced)


def score_external(fitted: Fitted, donors: DataFrame, key: str = "donor_id", label: str = "label") -> DataFrame:
    """Score another cohort with a fitted model; nothing is refitted."""
    rows = donors.withColumns({"rep": F.lit(0), "label": F.col(label).cast("int"), "folds": F.array(F.lit(0))})
    return score_fits(rows, fitted, [key], everyone=True).select(key, "label", "score")


def coefficients(fitted: Fitted, names: Sequence[str], spark) -> DataFrame:
    """Coefficients of a single fit ranked by size, with direction."""
    w = fitted.weights[0][:-1]
    df = spark.createDataFrame([(n, float(v)) for n, v in zip(names, w)], "feature_id string, coefficient double")
    return rank_coefficients(df)


def rank_coefficients(df: DataFrame, coefficient: str = "coefficient", name: str = "feature_id", by: Sequence[str] = ()) -> DataFrame:
    """Rank by absolute size (ties share the smaller rank) and direction of the effect."""
    from donorlake.operators.ordering import running_totals

    rows = df.withColumn("_size", F.abs(F.col(coefficient)))
    steps = running_totals(rows, "_size", {"n": F.count(F.lit(1))}, by, descending=True)
    ranks = steps.select(*by, "_size", (F.col("cum_n") - F.col("n") + 1).alias("coefficient_rank"))
    way = F.when(F.col(coefficient) > 0, "increases").when(F.col(coefficient) < 0, "decreases").otherwise("none")
    return rows.join(ranks, [*by, "_size"]).withColumn("direction", way).drop("_size")


def tree_importances(donors: DataFrame, names: Sequence[str], label: str = "label", features: str = "features", seed: int = 0, trees: int = 50) -> DataFrame:
    """Feature importances of a random forest and of boosted trees."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

    rows = donors.select(F.col(label).cast("double").alias("label"), array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("features"))
    models = {
        "random_forest": RandomForestClassifier(numTrees=trees, maxDepth=5, seed=seed),
        "gradient_boosting": GBTClassifier(maxIter=20, maxDepth=3, seed=seed),
    }
    out = []
    for family, model in models.items():
        weights = model.fit(rows).featureImportances.toArray()
        out += [(family, n, float(v)) for n, v in zip(names, weights)]
    return donors.sparkSession.createDataFrame(out, "model_family string, feature_id string, importance double")


# --- more features than donors --------------------------------------------------


def gram_rows(
    features: DataFrame, donors: DataFrame, folds: Sequence[tuple[tuple[int, int], ...]], key: str = "donor_id",
    feature: str = "feature_id", value: str = "value", max_donors: int = 2_000,
) -> DataFrame:
    """Replace very many features by at most n coordinates with the same inner products, per training side.

    ``donors`` carries ``label`` and ``folds``. Each gene row (one value per
    donor, absent values 0) is standardised with the training donors of every
    side and adds its outer product to that side's n×n matrix, task by task;
    the matrices are summed by Spark. An L2 fit on the coordinates equals the
    fit on the features. Result: rows with ``rep`` = index of the side.
    """
    from donorlake.operators.ordering import global_rank

    ranked = durable(global_rank(donors.select(key, "label", "folds"), [key], name="_ix").withColumn("_ix", (F.col("_ix") - 1).cast("int")))
    n = ranked.count()
    if n > max_donors:
        raise ValueError(f"{n} donors exceed max_donors={max_donors}; an n×n matrix must stay small")
    table = ranked.select("_ix", "folds").toPandas().sort_values("_ix")
    masks = np.stack([_inside(np.stack(table["folds"].to_numpy()), out)[0] for out in folds])
    bc = features.sparkSession.sparkContext.broadcast(masks)
    wide = features.join(ranked.select(key, "_ix"), key).groupBy(feature).agg(
        F.collect_list("_ix").alias("ix"), F.collect_list(F.col(value).cast("double")).alias("v")
    )

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            x = np.zeros((len(pdf), n))
            for i, (ix, v) in enumerate(zip(pdf["ix"], pdf["v"])):
                x[i, np.asarray(ix)] = v
            part = []
            for mask in bc.value:
                mu = x[:, mask].mean(axis=1, keepdims=True)
                sd = x[:, mask].std(axis=1, keepdims=True)
                sd[sd <= 1e-12 * np.maximum(np.abs(mu), 1e-300)] = np.inf
                z = (x - mu) / sd
                part.append(z.T @ z)
            total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            yield pd.DataFrame({"rep": range(len(total)), "stats": [k.ravel() for k in total]})

    sums = wide.select("ix", "v").mapInPandas(outer, "rep int, stats array<double>")
    sums = sums.groupBy("rep").agg(vector_to_array(Summarizer.sum(array_to_vector("stats"))).alias("stats"))

    def coordinates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rep, stats in zip(pdf["rep"], pdf["stats"]):
                values, vectors = np.linalg.eigh(np.asarray(stats).reshape(n, n))
                x = vectors * np.sqrt(np.maximum(values, 0.0))
                yield pd.DataFrame({"rep": int(rep), "_ix": range(n), "features": list(x)})

    coords = sums.mapInPandas(coordinates, "rep int, _ix int, features array<double>")
    return coords.join(ranked, "_ix").select("rep", key, "label", "features", "folds")


def cv_wide(
    features: DataFrame, donors: DataFrame, seed: int, c: float, outer: int = OUTER_FOLDS, key: str = "donor_id", label: str = "label",
    feature: str = "feature_id", value: str = "value",
) -> DataFrame:
    """Out-of-fold scores at a fixed C when features far outnumber donors."""
    folded = fold_rows(donors.select(key, F.col(label).cast("int").alias("label")), seed, outer, 0, key)
    sides = [((0, o),) for o in range(outer)]
    rows = _place(gram_rows(features, folded, sides, key, feature, value), key)
    size = rows.select(F.max(F.size("features"))).head()[0]
    fits = [Fit(o, ((0, o),), c) for o in range(outer)]
    fitted = fit_logistic(rows, fits, size, scaled=[False] * size)
    return score_fits(rows, fitted, [key]).select(key, "label", F.col("rep").alias("fold"), "score")


# --- fold-local preparation -------------------------------------------------------


def standardize(features: DataFrame, train: Column, feature: str = "feature_id", value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """z-scores with the training rows' mean and population sd, per feature (and fold in ``by``)."""
    keys = [*by, feature]
    v = F.when(train, F.col(value).cast("double"))
    stats = features.groupBy(*keys).agg(F.avg(v).alias("train_mean"), F.stddev_pop(v).alias("_sd"))
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
    return features.join(stats.select(*keys, "train_mean", sd.alias("train_sd")), keys).withColumn(
        "z", (F.col(value) - F.col("train_mean")) / F.col("train_sd")
    )


def fold_imputers(roles: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Training median and most frequent category per k-fold, one row per (fold, column): the fold's debug record."""
    from donorlake.operators.ordering import quantiles

    train = roles.where(F.col("role") == "train")
    frames = []
    for c in numeric:
        q = quantiles(train, c, [0.5], by=["fold_id"])
        frames.append(q.select("fold_id", F.lit(c).alias("column"), F.col("q0").alias("median"), F.lit(None).cast("string").alias("mode")))
    for c in categorical:
        counts = train.where(F.col(c).isNotNull()).groupBy("fold_id", c).agg(F.count(F.lit(1)).alias("_n"))
        best = counts.groupBy("fold_id").agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(c).cast("string").alias("cat"))).alias("_b"))
        frames.append(best.select("fold_id", F.lit(c).alias("column"), F.lit(None).cast("double").alias("median"), F.col("_b.cat").alias("mode")))
    return union_all(frames)


def one_hot(roles: DataFrame, field: str) -> DataFrame:
    """Indicator rows (fold, donor, category) against training categories only; an unknown category has no row (all zeros)."""
    train = roles.where((F.col("role") == "train") & F.col(field).isNotNull()).select("fold_id", field).distinct()
    return roles.join(train, ["fold_id", field]).withColumn("indicator", F.lit(1.0))


# --- nearest centroid -------------------------------------------------------------


def fit_centroids(train: DataFrame, label: str = "label", vector: str = "features", key: str = "donor_id") -> DataFrame:
    """Mean training vector per label."""
    return mean_pool(train, label, vector, cell=key).select(F.col(label), F.col("n_cells").alias("n_train"), F.col(vector).alias("centroid"))


def predict_centroids(model: DataFrame, rows: DataFrame, positive, label: str = "label", vector: str = "features") -> DataFrame:
    """Nearest centroid per row (ties to the smaller label) and the positive label's share of inverse distances.

    The model has one row per label; it enters every task as one array value.
    """
    table = model.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("lab"), F.col("centroid")))).alias("_model"))
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    with_model = with_group_totals(rows.withColumn("_x", v), table, [])
    scored = with_model.withColumn(
        "_d", F.transform("_model", lambda m: F.struct(euclidean(F.col("_x"), m["centroid"]).alias("d"), m["lab"].alias("lab")))
    )
    inverse = F.transform("_d", lambda e: F.struct(inverse_distance(e["d"]).alias("w"), e["lab"].alias("lab")))
    scored = scored.withColumn("_w", inverse)
    total = F.aggregate("_w", F.lit(0.0), lambda a, e: a + e["w"])
    mine = F.aggregate(F.filter("_w", lambda e: e["lab"] == F.lit(positive)), F.lit(0.0), lambda a, e: a + e["w"])
    return scored.withColumns({"predicted_label": F.array_min("_d")["lab"], "score": mine / total}).drop("_x", "_model", "_d", "_w")
