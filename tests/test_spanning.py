"""Plateaus, unwrapping and watersheds against sequential algorithms on small random volumes."""

import itertools

import numpy as np
import pytest

from gridloom.operators import graph, spanning, stencil, unwrapping

NEAR = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]


def cells(spark, values, mask=None):
    rows = [(*map(int, c), float(values[c]), int(mask is None or mask[c])) for c in np.ndindex(*values.shape)]
    return spark.createDataFrame(rows, "x int, y int, z int, v double, valid int").repartition(4)


def around(c, shape, offsets=NEAR):
    for o in offsets:
        d = tuple(a + b for a, b in zip(c, o, strict=True))
        if all(0 <= a < n for a, n in zip(d, shape, strict=True)):
            yield d


@pytest.mark.parametrize("seed", range(3))
def test_regional_maxima_of_plateaus(spark, seed):
    values = np.random.default_rng(seed).integers(0, 2 + seed, (8, 6, 4)).astype(float)
    if seed == 0:
        values = np.array([1.0, 1, 1, 1, 2, 0, 3, 3, 0, 5]).reshape(10, 1, 1)
    want, seen = {}, set()
    for c in np.ndindex(*values.shape):
        if c in seen:
            continue
        plateau, front = {c}, [c]
        while front:
            for d in around(front.pop(), values.shape):
                if values[d] == values[c] and d not in plateau:
                    plateau.add(d)
                    front.append(d)
        seen |= plateau
        top = not any(values[d] > values[c] for p in plateau for d in around(p, values.shape))
        want.update({p: float(top) for p in plateau})
    got = {(r.x, r.y, r.z): r.is_max for r in stencil.regional_maxima(cells(spark, values), "v").collect()}
    assert got == want


def unwrapped(phase, mask, period):
    """Edges sorted by reliability, groups shifted one by one."""
    padded = np.full([n + 2 for n in phase.shape], np.nan)
    padded[1:-1, 1:-1, 1:-1] = np.where(mask, phase, np.nan)
    wrap = lambda d: d - np.rint(d)
    cost = {}
    for c in np.ndindex(*phase.shape):
        total = 0.0
        for o in [o for o in NEAR if o > (0, 0, 0)]:
            here, ahead, behind = (padded[tuple(i + 1 + s * j for i, j in zip(c, o, strict=True))] for s in (0, 1, -1))
            total += (wrap((ahead - here) / period) - wrap((here - behind) / period)) ** 2
        cost[c] = unwrapping.BORDER if np.isnan(total) else total
    edges = []
    for c in np.ndindex(*phase.shape):
        for axis in range(3):
            d = tuple(i + (k == axis) for k, i in enumerate(c))
            if d in cost and mask[c] and mask[d]:
                edges.append((cost[c] + cost[d], c, d))
    group = {c: [c] for c in cost if mask[c]}
    turns = dict.fromkeys(group, 0)
    for _, c, d in sorted(edges):
        if group[c] is not group[d]:
            shift = turns[c] + round((phase[c] - phase[d]) / period) - turns[d]
            moved = group[d]
            for e in moved:
                turns[e] += shift
            group[c].extend(moved)
            for e in moved:
                group[e] = group[c]
    return {c: phase[c] + period * (turns[c] - turns[min(group[c])]) if mask[c] else phase[c] for c in cost}


@pytest.mark.parametrize("seed,brick", [(1, 4), (2, 3), (3, 32)])
def test_unwrapping_equals_the_sequential_one(spark, seed, brick):
    rng = np.random.default_rng(seed)
    x, y, z = np.indices((9, 7, 5))
    true = 0.9 * x + 0.7 * y - 1.1 * z + rng.normal(0, 0.8, x.shape)
    phase = np.angle(np.exp(1j * true))
    mask = rng.random(x.shape) > 0.15
    got = {(r.x, r.y, r.z): r.unwrapped for r in unwrapping.unwrap(cells(spark, phase, mask), "v", "valid", brick=brick).collect()}
    want = unwrapped(phase, mask, 2 * np.pi)
    assert got.keys() == want.keys() and max(abs(got[c] - want[c]) for c in want) < 1e-9


def test_smooth_phase_is_found_again(spark):
    x, y, z = np.indices((10, 6, 4))
    true = 0.05 * x * x + 0.6 * y + 0.4 * z
    mask = np.ones(x.shape, bool)
    mask[4, 1:] = False  # a wall with a gap
    got = unwrapping.unwrap(cells(spark, np.angle(np.exp(1j * true)), mask), "v", "valid", brick=4).collect()
    assert all(abs(r.unwrapped - true[r.x, r.y, r.z]) < 1e-9 for r in got if mask[r.x, r.y, r.z])


def flooded(values, basin, level):
    """Passes in ascending order; components keep their lowest minimum, labels join where the shallower side is shallow."""
    lowest, low = {}, {}
    for c, b in basin.items():
        low[b] = min(low.get(b, np.inf), values[c])
        for d in around(c, values.shape):
            if d in basin and b < basin[d]:
                lowest[b, basin[d]] = min(lowest.get((b, basin[d]), np.inf), max(values[c], values[d]))
    find = lambda up, n: n if up[n] == n else find(up, up[n])
    part, label = {b: b for b in low}, {b: b for b in low}
    for (u, v), height in sorted(lowest.items(), key=lambda e: (e[1], e[0])):
        a, b = find(part, u), find(part, v)
        if a == b:
            continue
        (_, keep), (deep, gone) = sorted([(low[a], a), (low[b], b)])
        part[gone] = keep
        if height - deep <= level:
            s, t = sorted((find(label, u), find(label, v)))
            label[t] = s
    return {c: find(label, b) for c, b in basin.items()}


@pytest.mark.parametrize("threshold", [0.0, 0.3])
def test_watershed_equals_flooding(spark, threshold):
    values = np.random.default_rng(7).integers(0, 40, (9, 8, 3)).astype(float)
    field = cells(spark, values)
    raised = np.maximum(values, values.min() + threshold * np.ptp(values))
    basin = {(r.x, r.y, r.z): r.basin for r in graph.basins(cells(spark, raised), "v").collect()}
    counts = []
    for level in (0.0, 0.15, 0.4):
        got = {(r.x, r.y, r.z): r.basin for r in graph.watershed(field, "v", level, threshold).collect()}
        assert got == flooded(raised, basin, level * np.ptp(values))
        counts.append(len(set(got.values())))
    assert counts[0] > counts[-1] >= 1


def test_forest_of_a_random_graph(spark):
    """Roots are components; numbers differ along tree edges as these say."""
    rng = np.random.default_rng(2)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 60, (90, 2)).tolist() if p[0] != p[1]}
    edges = [(u, v, float(rng.integers(0, 9)), u, v, int(rng.integers(-3, 4))) for u, v in sorted(pairs)]
    got = {r.node: (r.root, r.turn) for r in spanning.minimum_forest(spark.createDataFrame(edges, "u long, v long, cost double, a long, b long, turn long")).collect()}
    part, tree = {n: n for e in edges for n in e[:2]}, []
    find = lambda n: n if part[n] == n else find(part[n])
    for u, v, cost, a, b, turn in sorted(edges, key=lambda e: e[2:5]):
        if find(u) != find(v):
            part[find(u)] = find(v)
            tree.append((u, v, turn))
    assert got.keys() == part.keys() and all(got[u][0] == got[v][0] and got[v][1] - got[u][1] == turn for u, v, turn in tree)
    assert len({r for r, _ in got.values()}) == len(part) - len(tree)
    assert spanning.minimum_forest(spark.createDataFrame([], "u long, v long, cost double, a long, b long, turn long")).count() == 0
