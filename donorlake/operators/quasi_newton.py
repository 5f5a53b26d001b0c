"""Logistic fits with any number of features: limited-memory quasi-Newton steps on sums that Spark adds up.

A fit's state is a few vectors of its length (weights, direction, gradient and the
last ``MEMORY`` pairs of steps and gradient changes), never a matrix of feature pairs.
In one pass every task walks its rows once for all fits of a group and sends one
vector per fit: the loss at a ladder of step lengths and the gradient at the first.
The driver takes the longest step that lowers the loss enough and forms the next
direction. Groups are sized so that their state stays within ``budget`` doubles, in
the driver as in a task, whatever the number of fits or features.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MEMORY = 12
LADDER = (1.0, 0.5, 0.2, 0.05, 0.01, 1e-3, 1e-5)
_ENOUGH = 1e-4  # of the decrease that the slope promises


class Path:
    """One fit on its way: where it is, where it goes next, and its last steps."""

    def __init__(self, size: int):
        self.w, self.step, self.length = np.zeros(size), np.zeros(size), 1.0
        self.loss, self.grad, self.pairs = np.inf, None, []
        self.start, self.done, self.fresh = None, False, True

    def norm(self) -> float:
        return float(np.abs(self.grad).max()) if self.grad is not None else np.nan

    def _direction(self) -> np.ndarray:
        q, kept = self.grad.copy(), []
        for s, y, inverse in reversed(self.pairs):
            a = inverse * (s @ q)
            kept.append(a)
            q -= a * y
        if self.pairs:
            s, y, _ = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(self.grad))
        for (s, y, inverse), a in zip(self.pairs, reversed(kept)):
            q += (a - inverse * (y @ q)) * s
        return -q

    def advance(self, losses: np.ndarray, grad: np.ndarray, tolerance: float) -> None:
        """Take in the losses along the ladder and the gradient at its first rung."""
        if self.fresh:  # the first pass is at the start itself
            self.fresh, self.loss, self.grad, self.start = False, losses[0], grad, float(np.abs(grad).max())
        else:
            slope = float(self.grad @ self.step)
            rungs = self.length * np.array(LADDER)
            slack = 1e-12 * max(1.0, abs(self.loss))
            good = np.flatnonzero(losses <= self.loss + _ENOUGH * rungs * slope + slack)
            if not len(good):
                if not self.pairs and self.length < 1e-12:
                    self.done = True
                    return
                # Forget the curvature and start again along the gradient, ever shorter.
                self.pairs, self.length = [], self.length * 0.1
                self.step = self._direction()
                return
            if good[0]:
                self.length = float(rungs[good[0]])  # the next pass brings the gradient there
                return
            s = self.length * self.step
            y = grad - self.grad
            self.w, self.loss, self.grad = self.w + s, losses[0], grad
            if s @ y > 1e-14 * np.linalg.norm(s) * np.linalg.norm(y):
                self.pairs = (self.pairs + [(s, y, 1.0 / (s @ y))])[-MEMORY:]
        if self.norm() <= tolerance * max(1.0, self.start):
            self.done = True
            return
        self.step, self.length = self._direction(), 1.0


def per_group(size: int, budget: int) -> int:
    """Fits whose paths, moments and sums stay within ``budget`` doubles."""
    return max(1, budget // ((size + 1) * (2 * MEMORY + 8)))


def minimise(
    fits: Sequence, size: int, penalty: np.ndarray, evaluate: Callable, budget: int, tolerance: float = 1e-8, max_passes: int = 1000,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Weights (last entry: intercept), gradient norms, whether converged, and passes made, for every fit.

    ``evaluate(chunk, w, steps, lengths)`` yields ``fit, sums`` over all rows: the data losses along ``LADDER`` times the
    fit's length, then the gradient at the first. The ridge ½‖w‖² is added here; ``penalty`` is each fit's C.
    """
    weights, norms, converged, passes = np.zeros((len(fits), size + 1)), np.full(len(fits), np.nan), np.zeros(len(fits), bool), 0
    for start in range(0, len(fits), per_group(size, budget)):
        group = list(range(start, min(len(fits), start + per_group(size, budget))))
        paths = {i: Path(size + 1) for i in group}
        for _ in range(max_passes):
            live = [i for i in group if not paths[i].done]
            if not live:
                break
            passes += 1
            w, steps = np.stack([paths[i].w for i in live]), np.stack([paths[i].step for i in live])
            lengths = np.array([paths[i].length for i in live])
            seen = set()
            for at, sums in evaluate(live, w, steps, lengths):
                path, c = paths[live[at]], penalty[live[at]]
                rungs = path.w[None, :-1] + (path.length * np.array(LADDER))[:, None] * path.step[None, :-1]
                losses = c * sums[: len(LADDER)] + 0.5 * (rungs * rungs).sum(axis=1)
                path.advance(losses, c * sums[len(LADDER) :] + np.append(rungs[0], 0.0), tolerance)
                seen.add(at)
            if len(seen) < len(live):
                raise ValueError("a fit has no training rows")
        for i in group:
            weights[i], norms[i], converged[i] = paths[i].w, paths[i].norm(), paths[i].done
    return weights, norms, converged, passes


TOGETHER_MEMORY, TOGETHER_PASSES = 4, 40


def minimise_together(penalty: np.ndarray, size: int, evaluate: Callable, curved: Callable, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``minimise`` for many fits whose curvature is about known: arrays of all fits instead of paths, no ladder.

    ``evaluate(which, w)`` gives the data losses and gradients of some fits, ``curved(which, g)`` the inverse of their
    approximate curvature times a vector each. A fit is done when that is within ``tolerance`` of nothing.
    """
    n = len(penalty)
    w, good, loss = np.zeros((n, size + 1)), np.zeros((n, size + 1)), np.full(n, np.inf)
    grad, step, length = np.zeros((n, size + 1)), np.zeros((n, size + 1)), np.ones(n)
    (s, y), inverse = np.zeros((2, TOGETHER_MEMORY, n, size + 1)), np.zeros((TOGETHER_MEMORY, n))
    dot, left, passes = lambda a, b: np.einsum("ij,ij->i", a, b), np.arange(n), 0
    while len(left) and passes < TOGETHER_PASSES:
        data, slope = evaluate(left, w[left])
        passes += 1
        now = penalty[left] * data + 0.5 * dot(w[left, :-1], w[left, :-1])
        slope = penalty[left, None] * slope
        slope[:, :-1] += w[left, :-1]
        ok = now <= loss[left] + _ENOUGH * length[left] * dot(grad[left], step[left]) + 1e-10 * np.maximum(1.0, np.abs(now))
        short, at = left[~ok], left[ok]
        length[short] *= 0.3
        w[short] = good[short] + length[short, None] * step[short]
        if passes > 1:
            ds, dy = w[at] - good[at], slope[ok] - grad[at]
            along = dot(ds, dy)
            s[:, at], y[:, at], inverse[:, at] = np.roll(s[:, at], -1, axis=0), np.roll(y[:, at], -1, axis=0), np.roll(inverse[:, at], -1, axis=0)
            use = along > 1e-14 * np.sqrt(dot(ds, ds) * dot(dy, dy))
            s[-1, at], y[-1, at], inverse[-1, at] = ds, dy, np.where(use, 1.0 / np.where(use, along, 1.0), 0.0)
        good[at], loss[at], grad[at] = w[at], now[ok], slope[ok]
        q, kept = grad[at].copy(), []
        for k in reversed(range(TOGETHER_MEMORY)):  # an empty place has inverse 0 and changes nothing
            a = inverse[k, at] * dot(s[k, at], q)
            kept.append(a)
            q -= a[:, None] * y[k, at]
        q = curved(at, q)
        for k, a in zip(range(TOGETHER_MEMORY), reversed(kept)):
            q += (a - inverse[k, at] * dot(y[k, at], q))[:, None] * s[k, at]
        step[at], length[at] = -q, 1.0
        done = np.abs(q).max(axis=1) <= tolerance * np.maximum(1.0, np.abs(good[at]).max(axis=1))
        w[at] = good[at] + step[at]
        left = np.sort(np.concatenate([short, at[~done]]))
    reached = np.ones(n, bool)
    reached[left] = False
    return good, np.abs(grad).max(axis=1), reached, passes


def ladder_sums(z: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray, step: np.ndarray, length: float) -> np.ndarray:
    """Losses along the ladder, then the gradient at its first rung, over some rows (the last column of ``z`` is one)."""
    here, ahead = z @ w, z @ step
    margin = here[:, None] + ahead[:, None] * (length * np.array(LADDER))[None, :]
    losses = (weight[:, None] * (np.logaddexp(0.0, margin) - y[:, None] * margin)).sum(axis=0)
    prob = 1.0 / (1.0 + np.exp(-np.clip(margin[:, 0], -500, 500)))
    return np.concatenate([losses, z.T @ (weight * (prob - y))])


def residuals(fits: Sequence, norms: np.ndarray, n_train: np.ndarray, n_cases: np.ndarray, converged: np.ndarray, spark) -> DataFrame:
    """``fit, rep, c, n_train, n_cases, converged, kkt``: the greatest entry of each fit's gradient at its weights."""
    table = pd.DataFrame(
        {
            "fit": np.arange(len(fits), dtype=np.int32), "rep": [f.rep for f in fits], "c": [float(f.c) for f in fits],
            "n_train": n_train.astype(np.int64), "n_cases": n_cases.astype(np.int64), "converged": converged, "kkt": norms,
        }
    )
    return spark.createDataFrame(table, "fit int, rep int, c double, n_train bigint, n_cases bigint, converged boolean, kkt double")
