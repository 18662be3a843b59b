"""Queries that SQL cannot express, each against plain Python or numpy on the smallest tables."""

import itertools
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_corelines import searched
from test_fits import basis
from test_spanning import flooded, unwrapped
from test_thinning import topology

from gridloom import catalog
from gridloom.operators import bundling, corelines, graph, stencil, tables, thinning, walker_weights
from gridloom.plans import fixtures as fx
from gridloom.plans.graphs import row_curves

DATA = "/root/testdata/sf0.001"
SIX = [o for o in itertools.product((-1, 0, 1), repeat=3) if sum(map(abs, o)) == 1]
NEAR = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]


def rows(sql):
    con = duckdb.connect()
    for name in ("lineitem", "orders", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con.execute(sql).fetchall()


@pytest.fixture(scope="module")
def grid():
    """The scalar field as a dictionary."""
    return {(x, y, z): float(v) for x, y, z, v, _ in rows(f"WITH {fx.GRID_SQL} SELECT x, y, z, v, n FROM grid")}


def collect(spark, name):
    return catalog.queries()[name](spark, DATA).collect()


def at(c, o, k=1):
    return tuple(a + k * b for a, b in zip(c, o, strict=True))


def axis(a):
    return tuple(int(i == a) for i in range(3))


def central(f, c, a):
    ahead, behind = f.get(at(c, axis(a))), f.get(at(c, axis(a), -1))
    return (ahead - behind) / 2 if ahead is not None and behind is not None else 0.0


def hessian(f, c):
    out = np.zeros((3, 3))
    for a in range(3):
        for b in range(3):
            if a == b:
                found = [f.get(at(c, axis(a))), f.get(at(c, axis(a), -1))]
                out[a, b] = sum(found) - 2 * f[c] if None not in found else 0.0
            else:
                found = [f.get(at(at(c, axis(a), i), axis(b), j)) for i, j in ((1, 1), (1, -1), (-1, 1), (-1, -1))]
                out[a, b] = (found[0] - found[1] - found[2] + found[3]) / 4 if None not in found else 0.0
    return out


def same(got, want, columns, tolerance=1e-6):
    assert len(got) == len(want) == len({(r.x, r.y, r.z) for r in got})
    for r in got:
        np.testing.assert_allclose([r[c] for c in columns], np.atleast_1d(want[r.x, r.y, r.z]), rtol=tolerance, atol=tolerance)


def n17_curvature(spark, grid):
    want = {}
    for c in grid:
        g, m = np.array([central(grid, c, a) for a in range(3)]), hessian(grid, c)
        size = g @ g
        adjoint = np.array([[np.linalg.det(np.delete(np.delete(m, i, 0), j, 1)) * (-1) ** (i + j) for j in range(3)] for i in range(3)])
        want[c] = ((g @ m @ g - size * np.trace(m)) / (2 * size**1.5), g @ adjoint @ g / size**2) if size else (0.0, 0.0)
    same(collect(spark, "n17_curvature"), want, ["mean_curvature", "gauss_curvature"])


def n28_anisotropic_diffusion(spark, grid):
    u = dict(grid)
    for _ in range(2):
        u = {c: v + 0.1 * sum((u[at(c, o)] - v) * math.exp(-(((u[at(c, o)] - v) / 10) ** 2)) for o in SIX if at(c, o) in u) for c, v in u.items()}
    same(collect(spark, "n28_anisotropic_diffusion"), u, ["diffused"])


def vector_flow(grid, steps=3, mu=0.1, dt=0.5):
    g = {c: np.array([central(grid, c, a) for a in range(3)]) for c in grid}
    u = dict(g)
    for _ in range(steps):
        u = {c: v + dt * (mu * sum((u[at(c, o)] - v for o in SIX if at(c, o) in u), np.zeros(3)) - (g[c] @ g[c]) / (1 + g[c] @ g[c]) * (v - g[c])) for c, v in u.items()}
    return u


def n29_gradient_vector_flow(spark, grid):
    want = vector_flow(grid)
    same(collect(spark, "n29_gradient_vector_flow"), want, ["fx", "fy", "fz"])
    halves = stencil.brick_apply
    stencil_brick = stencil.BRICK
    try:  # small bricks must not show
        stencil.brick_apply = lambda *args: halves(*args, brick=5)
        same(stencil.gradient_vector_flow(fx.grid(spark, DATA), "v").collect(), want, ["fx", "fy", "fz"])
    finally:
        stencil.brick_apply = halves
    assert stencil.BRICK == stencil_brick


def n34_advection_diffusion(spark, grid):
    u, speed = dict(grid), (0.5, -0.25, 0.0)
    for _ in range(2):
        new = {}
        for c, v in u.items():
            change = 0.0
            for a in range(3):
                ahead, behind = u.get(at(c, axis(a)), v), u.get(at(c, axis(a), -1), v)
                change += 0.1 * (ahead - 2 * v + behind) - max(speed[a], 0) * (v - behind) - min(speed[a], 0) * (ahead - v)
            new[c] = v + 0.1 * change
        u = new
    same(collect(spark, "n34_advection_diffusion"), u, ["transported"])


def n30_vesselness(spark, grid):
    near = [o for o in itertools.product(range(-2, 3), repeat=3)]

    def smooth(c):
        found = [(math.exp(-sum(i * i for i in o) / 2), grid[at(c, o)]) for o in near if at(c, o) in grid]
        return sum(w * v for w, v in found) / sum(w for w, _ in found)

    around = {at(c, o) for c in grid for o in [(0, 0, 0), *NEAR]}
    blurred = {c: smooth(c) for c in around if any(at(c, o) in grid for o in near)}
    want = {}
    for c in grid:
        strong, side, weak = np.linalg.eigvalsh(hessian(blurred, c))
        across = max(-side, 0.0)
        width = (0.5 if weak <= 0 else 2.0) * across
        want[c] = across * math.exp(-(weak**2) / (2 * width**2)) if across > 0 and strong < 0 else 0.0
    same(collect(spark, "n30_vesselness"), want, ["vesselness"], 1e-5)


def n21_medial_surface(spark, grid):
    outside = np.array([c for c, v in grid.items() if v < 96])
    distance = {c: math.sqrt(((outside - np.array(c)) ** 2).sum(axis=1).min()) for c in grid}
    inside = {c: d for c, d in distance.items() if d > 0}
    want, seen = set(), set()
    for c, d in inside.items():
        plateau = {c} if c not in seen else set()
        front = list(plateau)
        while front:
            near = {at(front[-1], o) for o in NEAR} & inside.keys()
            front.pop()
            new = {n for n in near if inside[n] == d} - plateau
            plateau |= new
            front.extend(new)
        seen |= plateau
        if all(inside.get(at(p, o), 0) <= d for p in plateau for o in NEAR):
            want |= plateau
    assert {(r.x, r.y, r.z) for r in collect(spark, "n21_medial_surface")} == want


def g13_bayesian_classifier(spark, grid):
    data = rows("SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice FROM lineitem")
    by = defaultdict(list)
    for *_, flag, price in data:
        by[flag].append(float(price))
    model = {f: (np.mean(v), np.std(v), len(v) / len(data)) for f, v in by.items()}
    want = {(o, n): max((math.log(prior) - math.log(sd) - (float(price) - mean) ** 2 / (2 * sd * sd), f) for f, (mean, sd, prior) in model.items())[1] for o, n, _, price in data}
    assert {(r.l_orderkey, r.l_linenumber): r.predicted for r in collect(spark, "g13_bayesian_classifier")} == want


def g29_vector_quantisation(spark, grid):
    vectors = {i: np.array(v, float) for i, v in rows("SELECT vec_id, embedding FROM embeddings")}
    code = {r.vec_id: r.code for r in collect(spark, "g29_vector_quantisation")}
    assert code.keys() == vectors.keys() and len(set(code.values())) == 8
    centre = {k: np.mean([vectors[i] for i, c in code.items() if c == k], axis=0) for k in set(code.values())}
    nearest = {i: min(centre, key=lambda k: ((centre[k] - v) ** 2).sum()) for i, v in vectors.items()}
    assert sum(nearest[i] == c for i, c in code.items()) >= 0.9 * len(code)
    spread, whole = sum(((vectors[i] - centre[c]) ** 2).sum() for i, c in code.items()), np.array(list(vectors.values()))
    assert spread < ((whole - whole.mean(axis=0)) ** 2).sum()


def _thinned(spark, grid, name, ends):
    there = np.zeros((16, 16, 7), bool)
    for c, v in grid.items():
        there[c] = v >= 104
    want = there
    while not (np.array_equal(new := thinning.thin_once(want, [0, 0, 0], ends), want)):
        want = new
    assert {(r.x, r.y, r.z) for r in collect(spark, name)} == set(map(tuple, np.argwhere(want).tolist()))
    assert topology(want) == topology(there)


def n21_medial_line(spark, grid):
    _thinned(spark, grid, "n21_medial_line", True)


def n21_medial_point(spark, grid):
    _thinned(spark, grid, "n21_medial_point", False)


def g12_watershed_level(spark, grid):
    values = np.full((16, 16, 7), np.inf)
    for c, v in grid.items():
        values[c] = v
    span = max(grid.values()) - min(grid.values())
    raised = np.maximum(values, min(grid.values()) + 0.1 * span)
    field = spark.createDataFrame([(*c, float(raised[c])) for c in grid], "x int, y int, z int, v double")
    basin = {(r.x, r.y, r.z): r.basin for r in graph.basins(field, "v").collect()}
    want = flooded(raised, basin, 0.2 * span)
    assert {(r.x, r.y, r.z): r.basin for r in collect(spark, "g12_watershed_level")} == want


def _moments(grid):
    near = {c: np.array([grid[n] for o in [(0, 0, 0), *NEAR] if (n := at(c, o)) in grid]) for c in grid}
    return {c: (len(v), v.mean(), v.var(ddof=1) if len(v) > 1 else 0.0) for c, v in near.items()}


def _noise_walker(method):
    def proof(spark, grid):
        counts = {(x, y, z): float(n) for x, y, z, _, n in rows(f"WITH {fx.GRID_SQL} SELECT x, y, z, v, n FROM grid")}
        of = _moments(counts if method == "poisson" else grid)
        noise = np.mean([s for _, _, s in of.values()])

        def weight(c, d):
            (n, a, s), (m, b, t) = of[c], of[d]
            if method == "poisson":
                k, j = n * a + 1, m * b + 1
                h = (k + j) / 2
                return math.exp(math.lgamma(h) - (math.lgamma(k) + math.lgamma(j)) / 2 + (k * math.log(n) + j * math.log(m)) / 2 - h * math.log((n + m) / 2))
            s, t = (noise / n, noise / m) if method == "gaussian" else (s / n, t / m)
            if s + t == 0:
                return float(a == b)
            if method == "ttest":
                freedom = (s + t) ** 2 / (s * s / (n - 1) + t * t / (m - 1))
                return float(walker_weights.incomplete_beta(np.array(freedom / 2), 0.5, np.array(freedom / (freedom + (a - b) ** 2 / (s + t)))))
            return math.sqrt(2 * math.sqrt(s * t) / (s + t)) * math.exp(-((a - b) ** 2) / (4 * (s + t)))

        want = _dense(grid, {c: float(v > 100) for c, v in grid.items() if v > 140 or v < 80}, lambda c, d: max(weight(c, d), walker_weights.LEAST))
        assert max(abs(r.probability - want[r.x, r.y, r.z]) for r in collect(spark, f"g14_walker_{method}")) < 1e-4

    proof.__name__ = f"g14_walker_{method}"
    return proof


def g14_pyramid_walker(spark, grid):
    """Near the full walk: it differs only where the coarse one was sure."""
    want = _dense(grid, {c: float(v > 100) for c, v in grid.items() if v > 140 or v < 80})
    assert max(abs(r.probability - want[r.x, r.y, r.z]) for r in collect(spark, "g14_pyramid_walker")) < 0.05


def _dense(grid, seeds, weight=None):
    """Harmonic values by one dense solve; cells that reach no seed keep one half."""
    weight = weight or (lambda c, d: math.exp(-0.01 * (grid[c] - grid[d]) ** 2))
    number = {c: i for i, c in enumerate(grid)}
    a, b = np.zeros((len(grid), len(grid))), np.zeros(len(grid))
    for c, i in number.items():
        near = [] if c in seeds else [(number[at(c, o)], weight(c, at(c, o))) for o in SIX if at(c, o) in grid]
        a[i, i], b[i] = sum(w for _, w in near) or 1.0, seeds.get(c, 0.0 if near else 0.5)
        for j, w in near:
            a[i, j] = -w
    return dict(zip(grid, np.linalg.solve(a, b), strict=True))


def g14_random_walker(spark, grid):
    want = _dense(grid, {c: float(v > 100) for c, v in grid.items() if v > 140 or v < 80})
    assert max(abs(r.probability - want[r.x, r.y, r.z]) for r in collect(spark, "g14_random_walker")) < 1e-4


def g14_t10_multilabel_walker(spark, grid):
    counts = {(x, y, z): n for x, y, z, _, n in rows(f"WITH {fx.GRID_SQL} SELECT x, y, z, v, n FROM grid")}
    seeds = {c: 2 if v > 140 else 1 if v < 70 else 3 for c, v in grid.items() if v > 140 or v < 70 or counts[c] == 36}
    found = {label: _dense(grid, {c: float(s == label) for c, s in seeds.items()}) for label in (1, 2, 3)}
    for r in collect(spark, "g14_t10_multilabel_walker"):
        chances = {label: p[r.x, r.y, r.z] for label, p in found.items()}
        assert chances[r.label] >= max(chances.values()) - 1e-4


def f32_polynomial_fit(spark, grid):
    data = rows("SELECT l_returnflag, l_quantity, l_extendedprice FROM lineitem")
    got = {r[0]: list(r)[1:] for r in collect(spark, "f32_polynomial_fit")}
    for flag in {f for f, _, _ in data}:
        x, y = np.array([(float(q), float(p)) for f, q, p in data if f == flag]).T
        found = got[flag][0] if isinstance(got[flag][0], list) else got[flag]
        np.testing.assert_allclose(np.array(found[:3], float), np.polyfit(x, y, 2)[::-1], rtol=1e-4)


def _splines(data, pieces):
    """Per group: its points, and the dense least-squares coefficients."""
    by = defaultdict(list)
    for group, *row in data:
        by[group].append([float(c) for c in row])
    for group, values in by.items():
        values = np.array(values)
        design = basis(values[:, 0], values[:, 0].min(), values[:, 0].max(), pieces)
        yield group, values, design, np.linalg.lstsq(design, values[:, 1], rcond=None)[0]


def f32_spline_fit(spark, grid):
    got = {r.l_returnflag: r for r in collect(spark, "f32_spline_fit")}
    for flag, values, _, want in _splines(rows("SELECT l_returnflag, l_quantity, l_extendedprice FROM lineitem"), 8):
        np.testing.assert_allclose(got.pop(flag).coefficients, want, rtol=1e-6, atol=1e-6 * abs(values[:, 1]).max())
    assert not got


def f32_spline_values(spark, grid):
    got = {r.o_orderkey: r.fitted for r in collect(spark, "f32_spline_values")}
    for _, values, design, want in _splines(rows("SELECT o_orderpriority, dayofyear(o_orderdate), o_totalprice, o_orderkey FROM orders"), 12):
        np.testing.assert_allclose([got.pop(int(key)) for key in values[:, 2]], design @ want, rtol=1e-6)
    assert not got


def w05_resample_curve(spark, grid):
    lines = Counter(r.line for r in collect(spark, "w05_resample_curve"))
    assert lines.keys() == {y * 100 + z for _, y, z in grid} and set(lines.values()) == {20}


def p42_phase_unwrapping(spark, grid):
    phase, mask = np.zeros((16, 16, 7)), np.zeros((16, 16, 7), bool)
    for c, v in grid.items():
        phase[c], mask[c] = (v / 20) % 6.283185307179586, True
    want = unwrapped(phase, mask, 2 * math.pi)
    got = {(r.x, r.y, r.z): r.unwrapped for r in collect(spark, "p42_phase_unwrapping")}
    assert got.keys() == grid.keys() and max(abs(got[c] - want[c]) for c in got) < 1e-6


def p60_lattice_stress(spark, grid):
    got = collect(spark, "p60_lattice_stress")
    assert got and all(r.norm2 >= 0 and r.knudsen >= 0 and abs(r.shear) <= math.sqrt(r.norm2) + 1e-9 for r in got)


def s37_particles(spark, grid):
    got = collect(spark, "s37_particles")
    paths = defaultdict(dict)
    for r in got:
        paths[r.id][r.t] = r
    assert len(paths) == 200 and all(sorted(p) == list(range(5)) for p in paths.values())
    assert all(abs(p[t].x - p[0].x - t * p[0].vx) < 1e-9 and 0 <= p[0].mass < 1 for p in paths.values() for t in p)


def j16_assignment(spark, grid):
    got = collect(spark, "j16_assignment")
    by = defaultdict(list)
    for r in got:
        by[r.z].append((r.x, r.y))
    for z in range(7):
        pairs = by[z]
        assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs) == 10
        total = sum(grid[x, y, z] for x, y in pairs)
        for (a, b), (c, d) in itertools.combinations(pairs, 2):  # no exchange of two is better
            assert total <= total - grid[a, b, z] - grid[c, d, z] + grid.get((a, d, z), math.inf) + grid.get((c, b, z), math.inf) + 1e-9


def g16_streamlines(spark, grid):
    lines = defaultdict(dict)
    for r in collect(spark, "g16_streamlines"):
        lines[r.line_id][r.i] = np.array([r.x, r.y, r.z])
    assert lines.keys() == {x * 100 + y for (x, y, z), v in grid.items() if z == 0 and v > 110}
    for points in lines.values():
        assert sorted(points) == list(range(len(points)))
        assert all(abs(np.linalg.norm(points[i + 1] - points[i]) - 0.25) < 1e-6 for i in range(len(points) - 1))


def _flow(spark):
    u, values = {}, np.full((16, 16, 7, 6), np.nan)
    for x, y, z, *v in rows(f"WITH {fx.VEC_SQL} SELECT x, y, z, u0, u1, u2 FROM vec"):
        u[x, y, z] = np.array(v, float)
    for c, v in u.items():
        slopes = np.array([[central({k: w[i] for k, w in u.items() if sum(abs(a - b) for a, b in zip(k, c, strict=True)) == 1}, c, a) for a in range(3)] for i in range(3)])
        values[c] = [*v, *(slopes @ v)]
    return values


def _parted(values, corners, b):
    """How far from parallel both fields are at barycentric coordinates of a triangle, by their sizes at its corners."""
    sides = [np.array([values[tuple(k)][s] for k in corners]) for s in (slice(0, 3), slice(3, 6))]
    size = np.prod([np.linalg.norm(s, axis=1).max() for s in sides])
    return np.linalg.norm(np.cross(b @ sides[0], b @ sides[1])) / size if size else 0.0


def g18_parallel_points(spark, grid):
    """Both fields are parallel at every point, and no point is missing of those that a search finds as exactly."""
    values, got = _flow(spark), []
    kinds = {n: k for k, n in corelines.KINDS.items()}
    for r in collect(spark, "g18_parallel_points"):
        place, low = r.point >> 7, (1 << corelines.BITS) - 1
        base = np.array([place >> 2 * corelines.BITS, place >> corelines.BITS & low, place & low])
        corners = np.array([base, *[base + np.array(k) for k in kinds[r.point >> 2 & 31]]])
        b = np.linalg.lstsq(np.vstack([corners.T, np.ones(len(corners))]), np.array([r.x, r.y, r.z, 1.0]), rcond=None)[0]
        assert np.abs(b @ corners - [r.x, r.y, r.z]).max() < 1e-9 and b.min() > -1e-9 and _parted(values, corners, b) < 1e-5
        got.append((r.x, r.y, r.z))

    def exact(corners, b):
        """A triangle whose solutions are isolated, and one of them: where a field vanishes on an edge they are not."""
        return all(np.linalg.cond([values[tuple(k)][s] for k in corners]) < 1e7 for s in (slice(0, 3), slice(3, 6))) and _parted(values, corners, b) < 1e-9

    want = searched(values, 9, exact)
    near = ((np.array(got)[:, None] - np.array(sorted(want))[None]) ** 2).sum(axis=2)
    assert len(want) > 100 and near.min(axis=0).max() < 1e-8


def g19_coreline_lines(spark, grid):
    points = {(round(r.x, 6), round(r.y, 6), round(r.z, 6)) for r in collect(spark, "g18_parallel_points")}
    lines = defaultdict(dict)
    for r in collect(spark, "g19_coreline_lines"):
        lines[r.line][r.i] = r
    assert lines
    for line in lines.values():
        assert sorted(line) == list(range(len(line)))
        where = np.array([(line[i].x, line[i].y, line[i].z) for i in range(len(line))])
        steps = np.linalg.norm(np.diff(where, axis=0), axis=1)
        np.testing.assert_allclose([line[i].length for i in range(len(line))], np.concatenate([[0], np.cumsum(steps)]), atol=1e-9)
        assert steps.max() < 1.8 and steps.sum() >= 3 and {tuple(np.round(p, 6)) for p in where.tolist()} <= points


def g17_line_bundles(spark, grid):
    """Cells of the threshold's size bundled on their own, prototypes within it joined, by all pairs."""
    points = defaultdict(dict)
    for r in tables.resample_curve(row_curves(spark, DATA), "line", "i", ["x", "y", "z"], 12).collect():
        points[r.line][r.sample] = (r.x, r.y, r.z)
    lines = {n: np.array([p[i] for i in range(12)]) for n, p in sorted(points.items())}
    cells = defaultdict(list)
    for n, line in lines.items():
        cells[tuple(np.floor(line.mean(axis=0) / 1.0))].append(n)
    owner, mean = {}, {}
    for own in cells.values():
        which, _, sums, counts = bundling.bundle(np.array([lines[n] for n in own]), 1.0)
        heads = {p: own[which.index(p)] for p in set(which)}
        owner.update({n: heads[p] for n, p in zip(own, which, strict=True)})
        mean.update({heads[p]: sums[p] / counts[p] for p in heads})
    part = {h: h for h in mean}
    find = lambda h: h if part[h] == h else find(part[h])
    for a, b in itertools.combinations(sorted(mean), 2):
        if bundling.distances(mean[a], mean[b][None])[0][0] <= 1.0:
            a, b = sorted((find(a), find(b)))
            part[b] = a
    got = {r.line: r.bundle for r in collect(spark, "g17_line_bundles")}
    assert got == {n: find(h) for n, h in owner.items()} and 1 < len(set(got.values())) < len(got)


def _pairs():
    return {(f"c{c}", f"s{s}") for c, s in rows("SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")}


def g01_prune_whole(spark, grid):
    left = _pairs()
    while True:
        degree = Counter(n for e in left for n in e)
        kept = {e for e in left if min(degree[e[0]], degree[e[1]]) > 1}
        if kept == left:
            break
        left = kept
    assert {tuple(r) for r in collect(spark, "g01_prune_whole")} == left


def g04_contract_paths(spark, grid):
    pairs = _pairs()
    degree = Counter(n for e in pairs for n in e)
    got = collect(spark, "g04_contract_paths")
    assert sum(r.edges for r in got) == len(pairs) and all(r.length == r.edges for r in got)
    assert all(degree[r.src] != 2 and degree[r.dst] != 2 for r in got if r.src is not None)
    assert sum(r.edges - 1 for r in got if r.src is not None) + sum(r.edges for r in got if r.src is None) == sum(d == 2 for d in degree.values())


PROOFS = {f.__name__: f for f in (n17_curvature, n28_anisotropic_diffusion, n29_gradient_vector_flow, n34_advection_diffusion, n30_vesselness, n21_medial_surface, g13_bayesian_classifier, g29_vector_quantisation, g14_random_walker, g14_t10_multilabel_walker, f32_polynomial_fit, w05_resample_curve, p42_phase_unwrapping, p60_lattice_stress, s37_particles, j16_assignment, g16_streamlines, g01_prune_whole, g04_contract_paths, f32_spline_fit, f32_spline_values, g17_line_bundles, g18_parallel_points, g19_coreline_lines, n21_medial_line, n21_medial_point, g12_watershed_level, g14_pyramid_walker, *map(_noise_walker, walker_weights.METHODS))}


def test_every_query_without_sql_has_a_proof():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == set(PROOFS)


@pytest.mark.parametrize("name", PROOFS)
def test_query_without_sql(spark, grid, name):
    PROOFS[name](spark, grid)
