"""Edge weights of the random walker from models of noise: how likely two neighbourhoods are to show one value.

Each cell stands for the cells of a box around it, of which count, mean and variance are taken; an edge's weight compares
those of its two ends. All are 1 for like neighbourhoods and fall towards 0 with their difference:

* ``gaussian``: noise of one variance everywhere, the mean of all local variances. The overlap (Bhattacharyya
  coefficient) of the normal distributions of both means.
* ``gaussian_local``: the same with the variance of each neighbourhood.
* ``poisson``: counts; the overlap of the gamma distributions of both rates, of shape sum + 1 and rate count.
* ``ttest``: the two-sided p-value of Welch's t-test that both means are equal.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .combine import CELL
from .graph import EDGES
from .stencil import brick_apply, neighbours, shifted

METHODS = ("gaussian", "gaussian_local", "poisson", "ttest")
#: Weights below this count as this: every edge keeps a link.
LEAST = 1e-6


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after raising arguments above 8."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift = shift + np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift


def incomplete_beta(a: np.ndarray, b: float, x: np.ndarray, terms: int = 200) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction."""
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < tiny, tiny, 1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, terms):
        for up in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + up * d
            c = 1 + up / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    with np.errstate(divide="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(y) + q * np.log1p(-y))
    part = np.where(y <= 0, 0.0, front * h / p)
    return np.where(turn, 1 - part, part)


def overlap_of_normals(difference: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Of two normal distributions with variances s and t; two of no variance overlap only if they are equal."""
    total = s + t
    safe = np.where(total > 0, total, 1.0)
    curve = np.sqrt(2 * np.sqrt(s * t) / safe) * np.exp(-(difference**2) / (4 * safe))
    return np.where(total > 0, curve, (difference == 0).astype(float))


def overlap_of_gammas(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of two gamma distributions with shapes a, b and rates n, m."""
    half = (a + b) / 2
    return np.exp(log_gamma(half) - (log_gamma(a) + log_gamma(b)) / 2 + (a * np.log(n) + b * np.log(m)) / 2 - half * np.log((n + m) / 2))


def welch(difference: np.ndarray, s: np.ndarray, t: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Two-sided p-value for means of variances s, t from n and m cells; without any variance 1 if they are equal, else 0."""
    total = s + t
    safe = np.where(total > 0, total, 1.0)
    freedom = safe**2 / np.maximum(s**2 / np.maximum(n - 1, 1) + t**2 / np.maximum(m - 1, 1), 1e-300)
    freedom = np.minimum(freedom, 1e6)
    return np.where(total > 0, incomplete_beta(freedom / 2, 0.5, freedom / (freedom + difference**2 / safe)), (difference == 0).astype(float))


def _moments(block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and unbiased variance (0 for a single cell) of the box around each cell but the outer layers."""
    near = neighbours(block, (radius,) * 3)
    n = (~np.isnan(near)).sum(axis=0).astype(float)
    mean = np.nansum(near, axis=0) / np.maximum(n, 1)
    return n, mean, np.nansum((near - mean) ** 2, axis=0) / np.maximum(n - 1, 1)


def edge_weights(field: DataFrame, value: str, method: str, radius: int = 1, least: float = LEAST) -> DataFrame:
    """(x, y, z, w0, w1, w2): the weights of each cell's edges to the next cell along x, y and z, null without one.

    Values of ``poisson`` are counts, 0 or more. One pass over the bricks, two for ``gaussian``, whose variance comes first.
    """
    if method not in METHODS:
        raise ValueError(f"{method} is none of {METHODS}")
    variance = 0.0
    if method == "gaussian":
        inner = (radius,) * 3
        spread = brick_apply(field, [value], inner, lambda p: [np.where(np.isnan(shifted(p[0], inner, (0, 0, 0))), np.nan, _moments(p[0], radius)[2])], ["s"])
        variance = spread.where(~F.isnan("s")).agg(F.avg("s")).first()[0] or 0.0
    halo = (radius + 1,) * 3

    def kernel(p):
        n, mean, spread = _moments(p[0], radius)
        there = ~np.isnan(p[0][radius:-radius, radius:-radius, radius:-radius])
        core, out = (slice(1, -1),) * 3, []
        for axis in range(3):
            ahead = tuple(slice(2, None) if i == axis else slice(1, -1) for i in range(3))
            a, b = (n[core], mean[core], spread[core]), (n[ahead], mean[ahead], spread[ahead])
            sizes = np.maximum(a[0], 1), np.maximum(b[0], 1)
            difference = a[1] - b[1]
            if method == "gaussian":
                weight = overlap_of_normals(difference, variance / sizes[0], variance / sizes[1])
            elif method == "gaussian_local":
                weight = overlap_of_normals(difference, a[2] / sizes[0], b[2] / sizes[1])
            elif method == "poisson":
                weight = overlap_of_gammas(a[0] * a[1] + 1, sizes[0], b[0] * b[1] + 1, sizes[1])
            else:
                weight = welch(difference, a[2] / sizes[0], b[2] / sizes[1], *sizes)
            out.append(np.where(there[core] & there[ahead], np.maximum(weight, least), np.nan))
        return out

    found = brick_apply(field, [value], halo, kernel, list(EDGES))
    return found.select(*CELL, *[F.nanvl(w, F.lit(None).cast("double")).alias(w) for w in EDGES])
