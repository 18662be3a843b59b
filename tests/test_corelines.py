"""Parallel vectors and their lines on analytic fields, and against a search triangle by triangle."""

import itertools

import numpy as np
import pytest

from gridloom.operators import corelines

FIELD = "x int, y int, z int, u0 double, u1 double, u2 double, w0 double, w1 double, w2 double"
NAMES = (("u0", "u1", "u2"), ("w0", "w1", "w2"))


def frame(spark, shape, u, w):
    rows = [(*map(int, c), *map(float, u(np.array(c, float))), *map(float, w(np.array(c, float)))) for c in np.ndindex(*shape)]
    return spark.createDataFrame(rows, FIELD).repartition(4)


@pytest.mark.parametrize("brick", [32, 4])
def test_axis_of_a_vortex(spark, brick):
    axis = np.array([1.0, 0.31, 0.17]) / np.linalg.norm([1.0, 0.31, 0.17])
    centre = np.array([0.0, 2.23, 1.37])
    found = corelines.corelines(frame(spark, (12, 8, 6), lambda p: np.cross(axis, p - centre) + 0.3 * axis, lambda p: axis), *NAMES, brick=brick).collect()
    assert len({r.line for r in found}) == 1 and not found[0].closed
    found.sort(key=lambda r: r.i)
    points = np.array([(r.x, r.y, r.z) for r in found])
    away = points - centre - np.outer((points - centre) @ axis, axis)
    assert np.abs(away).max() < 1e-6 and [r.i for r in found] == list(range(len(found)))
    along = (points - centre) @ axis
    assert (np.diff(along) > 0).all() or (np.diff(along) < 0).all()
    assert found[-1].length == pytest.approx(np.ptp(along)) and abs(np.ptp(along) - 11 / axis[0]) < 2


def test_a_ring_closes(spark):
    """Both fields are parallel where r = 3.3 around the middle and z = 2.4."""
    middle = np.array([5.05, 5.15])

    def u(p):
        return np.array([np.hypot(*(p[:2] - middle)) - 3.3, p[2] - 2.4, 1.0])

    found = corelines.corelines(frame(spark, (11, 11, 6), u, lambda p: np.array([0.0, 0.0, 1.0])), *NAMES, brick=4).collect()
    assert {r.closed for r in found} == {True} and len({r.line for r in found}) == 1
    found.sort(key=lambda r: r.i)
    points = np.array([(r.x, r.y, r.z) for r in found])
    assert np.abs(np.hypot(*(points[:, :2] - middle).T) - 3.3).max() < 0.2 and np.abs(points[:, 2] - 2.4).max() < 0.2
    steps = np.linalg.norm(np.diff(points, axis=0, append=points[:1]), axis=1)
    assert steps.max() < 2 and abs(steps.sum() - 2 * np.pi * 3.3) < 2
    assert corelines.corelines(frame(spark, (11, 11, 6), u, lambda p: np.array([0.0, 0.0, 1.0])), *NAMES, least=99.0).count() == 0


def searched(values, digits=4, exact=lambda corners, b: True):
    """Barycentric solutions of every triangle by the roots of det(V - l W)."""
    out = []
    for c in np.ndindex(*[n - 1 for n in values.shape[:3]]):
        for triangle in corelines.TRIANGLES:
            corners = [tuple(np.add(c, t)) for t in triangle]
            if not np.isfinite([values[k] for k in corners]).all():
                continue
            v, w = (np.array([values[k][s] for k in corners]).T for s in (slice(0, 3), slice(3, 6)))
            at = np.array([0.0, 1.0, -1.0, 2.0])
            for root in np.roots(np.polyfit(at, [np.linalg.det(v - t * w) for t in at], 3)):
                if abs(root.imag) < 1e-9:
                    b = np.linalg.svd(v - root.real * w)[2][-1]
                    b = b / b.sum()
                    if (b >= 0).all() and exact(corners, b):
                        out.append(tuple(np.round(b @ np.array(corners, float), digits)))
    return set(out)


def test_points_equal_a_search(spark):
    values = np.random.default_rng(3).normal(size=(4, 4, 3, 6))
    rows = [(*map(int, c), *map(float, values[c])) for c in np.ndindex(4, 4, 3)]
    for brick in (32, 2):
        points, links = corelines.parallel_vectors(spark.createDataFrame(rows, FIELD), *NAMES, brick=brick)
        got = {r.point: (r.x, r.y, r.z) for r in points.collect()}
        assert {tuple(np.round(p, 4)) for p in got.values()} == searched(values) and got
        pairs = [(r.src, r.dst) for r in links.collect()]
        assert {p for e in pairs for p in e} <= got.keys() and max(np.linalg.norm(np.subtract(got[a], got[b])) for a, b in pairs) < 1.8
        lines = corelines.polylines(links).collect()
        near = {frozenset(e) for e in pairs}
        by = {}
        for r in lines:
            by.setdefault(r.line, {})[r.i] = r
        assert sum(len(p) for p in by.values()) == len({p for e in pairs for p in e})
        for line, placed in by.items():
            order = [placed[i].point for i in range(len(placed))]
            assert min(order) == line and all(frozenset(e) in near for e in itertools.pairwise(order))
            assert placed[0].closed == (frozenset((order[0], order[-1])) in near and len(order) > 2)
            assert order[0] == line if placed[0].closed else order[0] < order[-1]


def test_no_lines(spark):
    flat = frame(spark, (3, 3, 3), lambda p: np.zeros(3), lambda p: np.zeros(3))
    assert corelines.corelines(flat, *NAMES).count() == 0 == corelines.corelines(flat.limit(0), *NAMES).count()
    with pytest.raises(ValueError):
        corelines.polylines(spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "src long, dst long"))
