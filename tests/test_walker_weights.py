"""Edge weights from noise models against their formulas, and walks with them against dense solves."""

import itertools
import math

import numpy as np
import pytest

from gridloom.operators import graph, walker_weights


def test_special_functions():
    for x in (0.3, 1.0, 2.5, 7.9, 30.0, 1e4):
        assert walker_weights.log_gamma(np.array(x)) == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)
    for freedom, t in itertools.product((1.0, 2.0, 4.0, 13.7, 300.0), (0.0, 0.1, 1.0, 2.5, 12.0)):
        grid = np.linspace(0, 1, 400_001)  # the density of Student's t over u = |t| ... infinity, by u = t + (1 - v) / v
        v = (grid[1:] + grid[:-1]) / 2
        u = t + (1 - v) / v
        density = np.exp(math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2)) / math.sqrt(freedom * math.pi) * (1 + u * u / freedom) ** (-(freedom + 1) / 2)
        tail = 2 * (density / v**2).sum() * (grid[1] - grid[0])
        got = walker_weights.incomplete_beta(np.array(freedom / 2), 0.5, np.array(freedom / (freedom + t * t)))
        assert got == pytest.approx(tail, rel=1e-4, abs=1e-9)


def weight_of(method, p, q, variance):
    n, m, a, b = len(p), len(q), np.mean(p), np.mean(q)
    s, t = (np.var(v, ddof=1) / len(v) if len(v) > 1 else 0.0 for v in (p, q))
    if method == "gaussian":
        s, t = variance / n, variance / m
    if method == "poisson":
        k, j = p.sum() + 1, q.sum() + 1
        x = np.linspace(1e-9, (max(a, b) + 3) * 3, 200_001)
        density = [np.exp(c * math.log(r) - math.lgamma(c) + (c - 1) * np.log(x) - r * x) for c, r in ((k, n), (j, m))]
        return np.sqrt(density[0] * density[1]).sum() * (x[1] - x[0])
    if s + t == 0:
        return float(a == b)
    if method == "ttest":
        freedom = (s + t) ** 2 / (s * s / (n - 1) + t * t / (m - 1))
        return float(walker_weights.incomplete_beta(np.array(freedom / 2), 0.5, np.array(freedom / (freedom + (a - b) ** 2 / (s + t)))))
    return math.sqrt(2 * math.sqrt(s * t) / (s + t)) * math.exp(-((a - b) ** 2) / (4 * (s + t)))


@pytest.mark.parametrize("method", walker_weights.METHODS)
def test_weights_and_walks(spark, method):
    values = np.random.default_rng(1).poisson(6, (5, 4, 3)).astype(float)
    values[2:] += 9
    near = {c: values[tuple(slice(max(i - 1, 0), i + 2) for i in c)].ravel() for c in np.ndindex(*values.shape)}
    variance = np.mean([np.var(v, ddof=1) for v in near.values()])
    field = spark.createDataFrame([(*map(int, c), float(values[c])) for c in np.ndindex(*values.shape)], "x int, y int, z int, v double")
    table = walker_weights.edge_weights(field, "v", method)
    found, links = {(r.x, r.y, r.z): (r.w0, r.w1, r.w2) for r in table.collect()}, {}
    for c in near:
        for axis in range(3):
            d = tuple(i + (k == axis) for k, i in enumerate(c))
            if d not in near:
                assert found[c][axis] is None
                continue
            links[c, d] = max(walker_weights.LEAST, weight_of(method, near[c], near[d], variance))
            assert found[c][axis] == pytest.approx(links[c, d], rel=1e-5, abs=1e-9)
    seeds = {(0, 0, 0): 0, (4, 3, 2): 1}
    number = {c: i for i, c in enumerate(near)}
    a, b = np.zeros((len(near),) * 2), np.zeros(len(near))
    for (c, d), w in links.items():
        for p, q in ((c, d), (d, c)):
            if p not in seeds:
                a[number[p], number[p]] += w
                a[number[p], number[q]] -= w
    for c, label in seeds.items():
        a[number[c], number[c]], b[number[c]] = 1, label
    want = dict(zip(near, np.linalg.solve(a, b), strict=True))
    marks = spark.createDataFrame([(*c, v) for c, v in seeds.items()], "x int, y int, z int, label int")
    got = {(r.x, r.y, r.z): r.probability for r in graph.random_walker(field, "v", marks, weights=table, brick=4 if method == "ttest" else 16).collect()}
    assert max(abs(got[c] - want[c]) for c in want) < 1e-4


def test_pyramid_solves_fewer_bricks(spark):
    """Two halves, seeds in each: near the full walk, and only bricks at the border between them are solved."""
    rng = np.random.default_rng(2)
    values = rng.normal(0, 1, (32, 16, 8))
    values[16:] += 40
    field = spark.createDataFrame([(*map(int, c), float(values[c])) for c in np.ndindex(*values.shape)], "x int, y int, z int, v double")
    seeds = spark.createDataFrame([(x, y, z, int(x >= 16)) for x in (2, 29) for y in range(2, 16, 4) for z in (2, 5)], "x int, y int, z int, label int")
    whole = {(r.x, r.y, r.z): r.probability for r in graph.random_walker(field, "v", seeds).collect()}
    walked, solved = graph.pyramid_walker(field, "v", seeds, levels=1, brick=4)
    got = {(r.x, r.y, r.z): r.probability for r in walked.collect()}
    assert got.keys() == whole.keys() and max(abs(got[c] - whole[c]) for c in whole) < 0.05
    assert solved[0][0] <= solved[0][1] // 2 and solved[0][1] == 64
