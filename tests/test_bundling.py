"""Bundles of lines against bundling them in order."""

import numpy as np
import pytest

from gridloom.operators import bundling


def made(seed, spread):
    """Lines about five curves far apart, some of them backwards; equal steps, so that resampling keeps their points."""
    rng = np.random.default_rng(seed)
    lines = []
    for n in range(60):
        k = n % 5
        t = np.linspace(0, 9, 12)[:, None]
        base = np.array([20.0 * k, 5.0 * k, 0]) + t * np.array([[1.0, 0.2, 0.1], [0, 1, 0], [1, -1, 0], [0.1, 0, 1], [1, 1, 1]][k])
        line = base + rng.normal(0, spread, 3)
        lines.append(line[::-1] if rng.random() < 0.4 else line)
    return lines


@pytest.mark.parametrize("together", [4096, 5])
def test_separated_bundles(spark, monkeypatch, together):
    monkeypatch.setattr(bundling, "TOGETHER", together)
    lines = made(1, 0.15)
    which, turned, sums, counts = bundling.bundle(np.array(lines), 2.0)
    rows = [(n, i, *map(float, p)) for n, line in enumerate(lines) for i, p in enumerate(line)]
    frame = spark.createDataFrame([*rows, (99, 0, 1.0, 1.0, 1.0), (99, 1, 1.0, 1.0, 1.0)], "id int, i int, x double, y double, z double").repartition(4)
    found, curves = bundling.bundles(frame, "id", "i", 2.0)
    got = {r.line: r for r in found.collect()}
    assert len(counts) == 5 and got.keys() == set(range(60))
    first = {p: which.index(p) for p in set(which)}
    assert {n: r.bundle for n, r in got.items()} == {n: first[p] for n, p in enumerate(which)}
    assert [got[n].turned for n in range(60)] == turned
    want = {first[p]: s / counts[p] for p, s in enumerate(sums)}
    for r in curves.collect():
        assert r.lines == counts[which[r.bundle]]
        np.testing.assert_allclose([r.x, r.y, r.z], want[r.bundle][r.i], atol=1e-6)


def test_distance_of_lines():
    a = np.array([[0.0, 0, 0], [1, 0, 0], [2, 0, 0]])
    away, turned = bundling.distances(a, np.array([a + [0, 1, 0], a[::-1] + [0, 2, 0]]))
    assert away.tolist() == [1, 2] and turned.tolist() == [False, True]


def test_no_lines(spark):
    found, curves = bundling.bundles(spark.createDataFrame([], "id int, i int, x double, y double, z double"), "id", "i", 1.0)
    assert found.count() == 0 == curves.count()
