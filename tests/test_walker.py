"""The random walker against a dense solve."""

import numpy as np
import pytest

from gridloom.operators import graph


def solved(values, seeds, beta):
    cells = list(np.ndindex(*values.shape))
    number = {c: i for i, c in enumerate(cells)}
    a, b = np.zeros((len(cells), len(cells))), np.zeros(len(cells))
    for c, i in number.items():
        if c in seeds:
            a[i, i], b[i] = 1, seeds[c]
            continue
        for axis in range(3):
            for step in (1, -1):
                j = number.get(tuple(x + step * (k == axis) for k, x in enumerate(c)))
                if j is not None:
                    w = np.exp(-beta * (values[c] - values[cells[j]]) ** 2)
                    a[i, i] += w
                    a[i, j] -= w
    return {c: x for c, x in zip(cells, np.linalg.solve(a, b), strict=True)}


@pytest.mark.parametrize("brick", [4, 16])
def test_far_cells_are_solved(spark, brick):
    values = np.random.default_rng(3).integers(0, 15, (9, 6, 3)).astype(float)
    seeds = {(0, 0, 0): 0, (8, 5, 2): 1, (8, 0, 1): 0}
    field = spark.createDataFrame([(*map(int, c), float(values[c])) for c in np.ndindex(*values.shape)], "x int, y int, z int, v double")
    marks = spark.createDataFrame([(*c, v) for c, v in seeds.items()], "x int, y int, z int, label int")
    want = solved(values, seeds, 0.01)
    got = {(r.x, r.y, r.z): r.probability for r in graph.random_walker(field, "v", marks, brick=brick).collect()}
    assert got.keys() == want.keys() and max(abs(got[c] - want[c]) for c in want) < 1e-5
    if brick == 16:
        labels = {(r.x, r.y, r.z): r.label for r in graph.multilabel_walker(field, "v", marks, (0, 1)).collect()}
        assert labels == {c: int(p > 0.5) for c, p in want.items()}


def test_weak_links_count(spark):
    """Cells behind a weight of 1e-22 still get their seed's value; without rounds enough there is no result."""
    field = spark.createDataFrame([(x, 0, 0, 0.0 if x < 2 else 71.0) for x in range(9)], "x int, y int, z int, v double")
    marks = spark.createDataFrame([(0, 0, 0, 1)], "x int, y int, z int, label int")
    assert all(abs(r.probability - 1) < 1e-9 for r in graph.random_walker(field, "v", marks).collect())
    with pytest.raises(RuntimeError):
        graph.random_walker(field, "v", marks, rounds=1, brick=4)
