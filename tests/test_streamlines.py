"""Streamlines through a stored field against the same steps in numpy."""

import numpy as np

from gridloom.operators import graph


def sampled(u, p):
    low = np.floor(p).astype(int)
    total = np.zeros(3)
    for o in np.ndindex(2, 2, 2):
        w = np.prod([f if b else 1 - f for f, b in zip(p - low, o, strict=True)])
        if w > 0:
            at = low + o
            if (at < 0).any() or (at >= u.shape[:3]).any():
                return None
            total += w * u[tuple(at)]
    return total


def test_streamlines_follow_the_stored_field(spark):
    u = np.random.default_rng(2).normal(0.3, 1, (4, 4, 3, 3))
    field = spark.createDataFrame([(*map(int, c), *map(float, u[c])) for c in np.ndindex(4, 4, 3)], "x int, y int, z int, a double, b double, c double")
    seeds = [(1, 1.0, 1.0, 1.0), (2, 2.2, 0.7, 1.1), (3, 9.0, 0.0, 0.0)]
    want = {}
    for line, *start in seeds:
        p = np.array(start)
        want[line, 0] = p
        for i in range(1, 5):
            d = sampled(u, p)
            m = None if d is None else sampled(u, p + d / np.linalg.norm(d) * 0.2)
            p = None if m is None else p + m / np.linalg.norm(m) * 0.4
            if p is None or sampled(u, p) is None:
                break
            want[line, i] = p
    got = {(r.line_id, r.i): [r.x, r.y, r.z] for r in graph.streamlines(spark.createDataFrame(seeds, "line_id int, x double, y double, z double"), field, ["a", "b", "c"], 0.4, 4).collect()}
    assert got.keys() == want.keys() and len(got) > 4
    for key, p in want.items():
        np.testing.assert_allclose(got[key], p, rtol=1e-9)
