"""Splines, regressions and particle kernels against numpy and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import fits, particles


def basis(x, low, high, pieces):
    """Rows of B-spline values by de Boor's recursion on uniform knots."""
    step = (high - low) / pieces
    knots = low + step * np.arange(-3, pieces + 4)
    out = ((x[:, None] >= knots[:-1]) & (x[:, None] < knots[1:])).astype(float)
    out[x >= high] = 0
    out[x >= high, pieces + 2] = 1
    for k in range(1, 4):
        left = (x[:, None] - knots[: -1 - k]) / (knots[k:-1] - knots[: -1 - k])
        right = (knots[k + 1 :] - x[:, None]) / (knots[k + 1 :] - knots[1:-k])
        out = left * out[:, :-1] + right * out[:, 1:]
    return out


def test_splines_equal_dense_least_squares(spark):
    rng = np.random.default_rng(1)
    rows = []
    for group, n in (("a", 300), (None, 200), ("flat", 5)):
        x = rng.uniform(-2, 5, n) if group != "flat" else np.full(n, 3.0)
        rows += [(group, float(p), float(np.sin(p) * 4 + rng.normal(0, 0.2))) for p in x]
    data = spark.createDataFrame([*rows, ("a", None, 1.0), ("a", 2.0, None)], "g string, x double, y double").repartition(4)
    fit = fits.spline_fit(data, "x", "y", 6, ["g"])
    found = {r.g: r for r in fit.collect()}
    assert found.keys() == {"a", None, "flat"} and found["flat"].low == found["flat"].high == 3.0
    values = {(r.g, r.x): r.fitted for r in fits.spline_values(data.where("x is not null and y is not null"), "x", fit, ["g"]).collect()}
    for g in ("a", None):
        x, y = np.array([(p, q) for h, p, q in rows if h == g]).T
        design = basis(x, x.min(), x.max(), 6)
        want = np.linalg.lstsq(design, y, rcond=None)[0]
        np.testing.assert_allclose(found[g].coefficients, want, rtol=1e-7, atol=1e-8)
        np.testing.assert_allclose([values[g, p] for p in x], design @ want, rtol=1e-9, atol=1e-9)
        whole = fits.spline_fit(data.where(F.col("g").eqNullSafe(F.lit(g))), "x", "y", 6, smooth=0.1).first().coefficients
        second = np.diff(np.eye(9), 2, axis=0)
        gram = design.T @ design
        np.testing.assert_allclose(whole, np.linalg.solve(gram + 0.1 * np.diag(gram).mean() * second.T @ second, design.T @ y), rtol=1e-8)
    outside = spark.createDataFrame([("a", 99.0), ("none", 0.0), ("a", None)], "g string, x double")
    assert [r.fitted for r in fits.spline_values(outside, "x", fit, ["g"]).collect()] == [None] * 3
    assert fits.spline_fit(data.limit(0), "x", "y", 6, ["g"]).count() == 0


def test_banded_solve():
    rng = np.random.default_rng(2)
    dense = np.zeros((12, 12))
    for i in range(30):
        row = np.zeros(12)
        at = i % 9
        row[at : at + 4] = rng.normal(size=4)
        dense += np.outer(row, row)
    right = rng.normal(size=12)
    band = np.array([[dense[i, i + k] if i + k < 12 else 0.0 for i in range(12)] for k in range(4)])
    np.testing.assert_allclose(fits.banded_solve(band, right), np.linalg.solve(dense, right), rtol=1e-8)
    assert fits.banded_solve(np.zeros((4, 5)), np.zeros(5)).tolist() == [0] * 5


def test_multiple_regression_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) + 1e4
    y = x @ [2.0, -1.0, 0.5] + 7 + rng.normal(0, 0.1, 200)
    rows = [("a" if i % 2 else None, *map(float, x[i]), float(y[i])) for i in range(200)] + [("a", None, 1.0, 1.0, 1.0), ("same", 1.0, 2.0, 3.0, 4.0)]
    data = spark.createDataFrame(rows, "g string, a double, b double, c double, y double").repartition(3)
    found = {r.g: r for r in fits.multiple_regression(data, ["a", "b", "c"], "y", ["g"]).collect()}
    assert found["same"].n == 1 and found["same"].slopes == [0, 0, 0] and found["same"].intercept == 4 and found["same"].r2 is None
    for g in ("a", None):
        own = np.array([i % 2 == (g == "a") for i in range(200)])
        want, left = np.linalg.lstsq(np.column_stack([x[own], np.ones(own.sum())]), y[own], rcond=None)[:2]
        np.testing.assert_allclose([*found[g].slopes, found[g].intercept], want, rtol=1e-5)
        assert found[g].n == own.sum() and found[g].r2 == pytest.approx(1 - left[0] / (own.sum() * y[own].var()), rel=1e-6)
    assert fits.multiple_regression(data, ["a"], "y").first().n == 201


def kernel(q):
    return 1 - 1.5 * q * q + 0.75 * q**3 if q <= 1 else 0.25 * (2 - q) ** 3 if q < 2 else 0.0


def shares(p, h, grid):
    found = {c: w for c in grid if (w := kernel(np.linalg.norm(np.subtract(p, c)) / h)) > 0} if h > 0 else {}
    near = tuple(int(np.floor(i + 0.5)) for i in p)
    if not found:
        found = {near: 1.0} if near in grid else {}
    return {c: w / sum(found.values()) for c, w in found.items()}


@pytest.mark.parametrize("shape", [(6, 5, 4), None])
def test_kernels_equal_brute_force(spark, shape):
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.uniform(0, (5, 4, 3))), float(h), float(rng.uniform(1, 3))) for i, h in enumerate(rng.choice([0.0, 0.05, 0.4, 0.8, 1.3], 60))]
    rows += [(100 + i, 2.25, 2.0, 1.5, 0.7, 1.0) for i in range(40)]
    grid = set(np.ndindex(*shape)) if shape else {(a - 5, b - 5, c - 5) for a, b, c in np.ndindex(16, 16, 16)}
    frame = spark.createDataFrame([*rows, (999, None, 1.0, 1.0, 1.0, 1.0)], "id int, x double, y double, z double, h double, mass double").repartition(3)
    want = {}
    for _, x, y, z, h, mass in rows:
        for c, w in shares((x, y, z), h, grid).items():
            n, total = want.get(c, (0, 0.0))
            want[c] = (n + 1, total + mass * w)
    got = {(r.x, r.y, r.z): (r.particles, r.mass) for r in particles.to_cells(frame, ["mass"], "h", shape).collect()}
    assert got.keys() == want.keys() and all(got[c][0] == want[c][0] and abs(got[c][1] - want[c][1]) < 1e-9 for c in want)
    assert sum(m for _, m in got.values()) == pytest.approx(sum(r[-1] for r in rows))
    if shape is None:
        values = {c: float(rng.normal()) for c in sorted(grid) if rng.random() < 0.6}
        field = spark.createDataFrame([(*map(int, c), v) for c, v in values.items()], "x int, y int, z int, v double")
        found = {r.id: r.v for r in particles.from_cells(frame, field, ["v"], "id", "h").collect()}
        for i, x, y, z, h, _ in rows:
            own = {c: w for c, w in shares((x, y, z), h, grid).items() if c in values}
            assert (i in found) == bool(own) and (not own or found[i] == pytest.approx(sum(w * values[c] for c, w in own.items()) / sum(own.values())))
