"""Bootstrap weights: exact multinomial counts by halving row ranks, without drawing rows.

Rows are folded to cells (equal in all that counts) and laid out in order, so a cell
is a range of ranks. The ranks of a stratum are halved again and again: of the m draws
that a range got, a binomial number goes to its lower half. A range that lies within
one cell needs no further halving, so a cell of any size costs one number per
replicate. The number is the quantile of a uniform value that depends on (seed,
stratum, replicate, range) only: not on partitioning, retries, or how ranges are dealt
to tasks. Ranges above ``LEAF`` ranks are dealt to tasks, each of which walks down
from the whole stratum; no task holds more than a leaf's cells for a chunk of replicates.
The walk takes about a tenth of a leaf's own time at 1e8 ranks, and as much as that at 1e10.
"""

from __future__ import annotations

import numpy as np

# The multipliers and shifts of a published 32-bit finaliser, and the start of the second lane.
_FIRST, _SECOND, _LANE = 0x85EBCA6B, 0xC2B2AE35, 0x9747B28C
_LOW = np.uint64(0xFFFFFFFF)
LEAF = 1 << 16
_TABLE = np.concatenate([[0.0, 0.0], np.cumsum(np.log(np.arange(1.0, 256.0)))])  # log gamma of 1, 1, 2, 3 …; entry 0 is unused


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(_FIRST)) & _LOW
    x = x ^ (x >> np.uint64(13))
    x = (x * np.uint64(_SECOND)) & _LOW
    return x ^ (x >> np.uint64(16))


def uniform(seed: int, *keys) -> np.ndarray:
    """Uniform values in [0, 1) with 52 bits for whole-number keys (arrays that broadcast)."""
    lanes = []
    for lane in (0, _LANE):
        h = _mixed(np.uint64(lane) ^ np.asarray(seed % 2**32, np.uint64))
        for key in keys:
            k = np.asarray(key).astype(np.uint64)
            h = _mixed(h ^ (k & _LOW) ^ _mixed(k >> np.uint64(32)))
        lanes.append(h)
    return ((lanes[0] << np.uint64(20)) | (lanes[1] >> np.uint64(12))).astype(np.float64) / 2.0**52


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For whole numbers from 1 on."""
    x = np.asarray(x, np.float64)
    if x.max(initial=1) < 200:
        return _TABLE[x.astype(np.int64)]
    far = np.maximum(x, 200.0)
    series = (far - 0.5) * np.log(far) - far + 0.5 * np.log(2 * np.pi) + 1 / (12 * far) - 1 / (360 * far**3) + 1 / (1260 * far**5)
    return np.where(x < 200, _TABLE[np.minimum(x, 200).astype(np.int64)], series)


def binomial(m: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Smallest k with P(X <= k) > u for X binomial (m, p), 0 < p < 1. What lies nine deviations off is left out of the sums."""
    m, p, u = (np.asarray(a) for a in np.broadcast_arrays(m, p, u))
    kinds, which = np.unique(p, return_inverse=True)
    return _binomial(m.ravel(), kinds, which.ravel(), u.ravel()).reshape(m.shape)


def _distribution(m: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    """P(X <= k) of ``size`` values of k from ``low`` on; above ``high`` infinite."""
    n, q = m[:, None].astype(np.float64), p[:, None]
    k = low[:, None] + np.arange(size)
    inside = k <= high[:, None]
    at = np.minimum(k, m[:, None])
    log = log_gamma(n + 1) - log_gamma(at + 1) - log_gamma(n - at + 1) + at * np.log(q) + (n - at) * np.log1p(-q)
    return np.where(inside, np.cumsum(np.where(inside, np.exp(log), 0.0), axis=1), np.inf)


def _binomial(m: np.ndarray, kinds: np.ndarray, which: np.ndarray, u: np.ndarray) -> np.ndarray:
    """``binomial`` of p = ``kinds[which]``. Halves of ranges have few p and most m are small, so equal (m, p) share one table."""
    out = (u >= (1 - kinds)[which]).astype(np.int64)  # the answer for one draw
    more = np.flatnonzero(m != 1)
    if not len(more):
        return out
    m, which, u = m[more], which[more], u[more]
    top = int(m.max()) + 1
    if len(kinds) * top <= max(1 << 16, 4 * len(m)):
        code = which * top + m
        there = np.zeros(len(kinds) * top, bool)
        there[code] = True
        pairs = np.flatnonzero(there)
        at = (np.cumsum(there) - 1)[code]
        n, p = pairs % top, kinds[pairs // top]
    else:
        n, p, at = m, kinds[which], np.arange(len(m))
    sd = np.sqrt(n * p * (1 - p))
    low = np.maximum(0, np.floor(n * p - 9 * sd - 12)).astype(np.int64)
    high = np.minimum(n, np.ceil(n * p + 9 * sd + 12)).astype(np.int64)
    size = (1 << np.ceil(np.log2(np.maximum(high - low + 1, 2))).astype(np.int64))[at]
    for s in np.unique(size):
        rows = np.flatnonzero(size == s)
        for part in np.array_split(rows, max(1, len(rows) * s // 4_000_000)):
            mine = at[part]
            if len(part) > len(n):  # more draws than tables
                tables = np.flatnonzero(np.bincount(mine, minlength=len(n)))
                place = np.zeros(len(n), np.int64)
                place[tables] = np.arange(len(tables))
                cdf = _distribution(n[tables], p[tables], low[tables], high[tables], int(s))
                below = np.zeros(len(part), np.int64)
                if s <= 16:
                    for column in cdf.T:
                        below += column[place[mine]] <= u[part]
                else:
                    below += (cdf[place[mine]] <= u[part, None]).sum(axis=1)
            else:
                below = (_distribution(n[mine], p[mine], low[mine], high[mine], int(s)) <= u[part, None]).sum(axis=1)
            out[more[part]] = np.minimum(low[mine] + below, m[part])
    return out


def _lower(lo: np.ndarray, hi: np.ndarray, m: np.ndarray, seed: int, stratum: int, replicates: np.ndarray) -> np.ndarray:
    """Of the draws ``m`` (range by replicate) of the ranges, those that go to the lower halves.

    The same values as ``uniform(seed, stratum, replicate, lo, hi)``: keys are mixed once per replicate or range.
    """
    mid = (lo + hi) // 2
    r, c = np.nonzero(m)
    out = np.zeros_like(m)
    if len(r):
        folded = lambda key: (key.astype(np.uint64) & _LOW) ^ _mixed(key.astype(np.uint64) >> np.uint64(32))
        first, second, lanes = folded(lo)[r], folded(hi)[r], []
        for lane in (0, _LANE):
            h = _mixed(np.uint64(lane) ^ np.asarray([seed % 2**32], np.uint64))
            h = _mixed(_mixed(h ^ folded(np.asarray([stratum]))) ^ folded(np.asarray(replicates)))
            lanes.append(_mixed(_mixed(h[c] ^ first) ^ second))
        u = ((lanes[0] << np.uint64(20)) | (lanes[1] >> np.uint64(12))).astype(np.float64) / 2.0**52
        kinds, which = np.unique((mid - lo) / (hi - lo), return_inverse=True)
        out[r, c] = _binomial(m[r, c], kinds, which[r], u)
    return out


def leaves(n: int, leaf: int = LEAF) -> list[tuple[int, int]]:
    """The ranges of ``n`` ranks that are dealt to tasks, of ``leaf`` ranks at most."""
    ranges = [(0, n)]
    while max(hi - lo for lo, hi in ranges) > leaf:
        ranges = [half for lo, hi in ranges for half in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi))]
    return ranges


def cell_weights(n: int, first: int, last: int, ends: np.ndarray, seed: int, stratum: int, replicates: np.ndarray) -> np.ndarray:
    """Draws (cell by replicate) of the cells of the leaf [first, last) of a stratum of ``n`` ranks and n draws.

    ``ends`` are the ranks at which the leaf's cells end, the last one being ``last``.
    """
    lo, hi, m = 0, n, np.full((1, len(replicates)), n, np.int64)
    while (lo, hi) != (first, last):
        mid = (lo + hi) // 2
        left = _lower(np.array([lo]), np.array([hi]), m, seed, stratum, replicates)
        lo, hi, m = (lo, mid, left) if last <= mid else (mid, hi, m - left)
    out = np.zeros((len(ends), len(replicates)), np.int64)
    lo, hi = np.array([lo]), np.array([hi])
    while len(lo):
        cell = np.searchsorted(ends, lo, side="right")
        whole = cell == np.searchsorted(ends, hi - 1, side="right")
        np.add.at(out, cell[whole], m[whole])
        lo, hi, m = lo[~whole], hi[~whole], m[~whole]
        if len(lo):
            mid, left = (lo + hi) // 2, _lower(lo, hi, m, seed, stratum, replicates)
            lo, hi, m = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.concatenate([left, m - left])
    return out
