"""Thinning keeps components, tunnels and cavities, whatever the bricks."""

import itertools

import numpy as np
import pytest

from gridloom.operators import thinning


def parts(there, corners):
    """Number of components, by corners or by faces."""
    left, n = set(map(tuple, np.argwhere(there).tolist())), 0
    near = [o for o in itertools.product((-1, 0, 1), repeat=3) if (any(o) if corners else sum(map(abs, o)) == 1)]
    while left:
        front = [left.pop()]
        n += 1
        while front:
            c = front.pop()
            for o in near:
                d = tuple(a + b for a, b in zip(c, o, strict=True))
                if d in left:
                    left.remove(d)
                    front.append(d)
    return n


def topology(there):
    """Components, tunnels and cavities, the second from the Euler number of the cubes, faces, edges and corners."""
    padded = np.pad(there, 1)
    total = 0
    for shape in itertools.product((0, 1), repeat=3):  # cells of a complex that span these axes
        found = np.zeros([n - 1 + s for n, s in zip(padded.shape, shape, strict=True)], bool)
        for shift in itertools.product(*[(0,) if s else (0, 1) for s in shape]):
            found |= padded[tuple(slice(h, h + n) for h, n in zip(shift, found.shape, strict=True))]
        total += (-1) ** sum(shape) * int(found.sum())
    components, cavities = parts(padded, True), parts(~padded, False) - 1
    return components, components + cavities - total, cavities


def frame(spark, there):
    return spark.createDataFrame([tuple(map(int, c)) for c in np.argwhere(there)], "x int, y int, z int").repartition(3)


def test_simple_cells_keep_the_topology():
    rng = np.random.default_rng(1)
    near = rng.random((400, 26)) < rng.random((400, 1))
    for flags, is_simple in zip(near, thinning.simple(near), strict=True):
        block = np.zeros((3, 3, 3), bool)
        block[tuple((thinning._NEAR + 1).T)] = flags
        whole = block.copy()
        whole[1, 1, 1] = True
        assert is_simple == (topology(block) == topology(whole))


@pytest.mark.parametrize("ends", [True, False])
def test_thinning_of_random_masks(spark, ends):
    rng = np.random.default_rng(2)
    noise = rng.random((14, 10, 8))
    there = sum(np.roll(noise, (i, j, k), (0, 1, 2)) for i, j, k in itertools.product((0, 1), repeat=3)) > 4.1
    want = there
    while True:
        new = thinning.thin_once(want, [0, 0, 0], ends)
        if (new == want).all():
            break
        want = new
    found = {}
    for brick in (32, 5):
        got = np.zeros_like(there)
        for r in thinning.thin(frame(spark, there), ends, brick=brick).collect():
            got[r.x, r.y, r.z] = True
        found[brick] = got
    assert (found[32] == want).all() and (found[5] == want).all()
    assert topology(want) == topology(there) and want.sum() < there.sum() and topology(there)[1] > 0


def test_lines_and_points(spark):
    bar = np.zeros((15, 5, 5), bool)
    bar[1:14, 1:4, 1:4] = True
    line = thinning.thin(frame(spark, bar)).collect()
    assert len(line) >= 8 and {(r.y, r.z) for r in line if 3 < r.x < 11} == {(2, 2)}
    assert thinning.thin(frame(spark, bar), ends=False).count() == 1
    ring = bar.copy()
    ring[4:11, 2, :] = False
    kept = np.zeros_like(ring)
    for r in thinning.thin(frame(spark, ring), ends=False).collect():
        kept[r.x, r.y, r.z] = True
    assert topology(kept) == topology(ring) == (1, 1, 0)
    assert thinning.thin(frame(spark, bar & False)).count() == 0
