"""Whitening and exact top-k search against plain numpy and Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import topk, whitening

SCHEMA = "vec_id long, embedding array<float>, score string, x string, place string, n string"


def cases(seed=1):
    """Small vectors of several lengths with ties, a large group of copies, repeated and missing ids, and odd entries."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(c) for c in rng.choice([-1.0, 0.0, 0.5, 1.0, 2.0], rng.choice([3, 3, 3, 2, 0]))]) for i in range(150)]
    rows += [(400 + i, [1.0, 1.0, 1.0]) for i in range(700)]
    rows += [(None, [1.0, 2.0, 2.0]), (20, [2.0, 2.0, 2.0]), (20, [2.0, 2.0, 2.0]), (5, None), (6, [None, 1.0]), (7, [float("nan")]), (8, [float("inf"), 1.0])]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, *["other"] * 4) for r in rows], SCHEMA).repartition(5)


def integers(rows, scale):
    kept = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in x]) for i, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    width = max((len(x) for _, x in kept), default=0)
    return [(i, x + [0] * (width - len(x))) for i, x in kept]


def nearest(rows, k):
    vectors, out = integers(rows, 64), []
    for a, (i, x) in enumerate(vectors):
        if i is None or i % 20:
            continue
        found = sorted((-sum(p * r for p, r in zip(x, y, strict=True)), j is None, j or 0, b) for b, (j, y) in enumerate(vectors) if b != a)[:k]
        out += [(i, n + 1, None if null else j, -s) for n, (s, null, j, _) in enumerate(found)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(1024, 256, 16), (32, 8, 2)])
def test_topk_equals_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("ROWS", "QUERIES", "SLICE"), sizes, strict=True):
        monkeypatch.setattr(topk, name, size)
    monkeypatch.setattr(topk, "PIVOT_ROWS", 50)
    rows = cases()
    got = topk.search(table(spark, rows), F.col("vec_id") % 20 == 0, 20)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == nearest(rows, 20)


def test_topk_of_random_and_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    for spread in (3.0, 0.02):
        rows = [(i, [float(c) for c in centres[i % 6] + spread * rng.normal(size=12)]) for i in range(600)]
        assert sorted(map(tuple, topk.search(table(spark, rows), F.col("vec_id") % 20 == 0, 7).collect()), key=repr) == nearest(rows, 7)


def test_annuli_out_of_reach_are_passed_over(monkeypatch):
    """Clustered vectors: most annuli are never multiplied."""
    rng = np.random.default_rng(4)
    centres = 100 * rng.normal(size=(20, 8))
    x = np.round(np.repeat(centres, 50, axis=0) * 10 + rng.normal(size=(1000, 8))).astype(np.int64)
    space = topk.Space(8, float((x * x).sum(axis=1).max()), np.zeros((1, 9)))
    space.pivots = topk.farthest_first(space.lift(x), 20)
    away = space.distances(x, False)
    pivot = away.argmin(axis=1)
    as_row = lambda at, p: {"pivot": p, "lo": float(away[at, p].min()), "hi": float(away[at, p].max()), "ids": at.tolist(), "places": at.tolist(), "width": 8, "bytes": 8, "vectors": x[at].tobytes()}
    annuli = [as_row(np.flatnonzero(pivot == p), p) for p in range(20)]
    visited = []
    real = topk.products
    monkeypatch.setattr(topk, "products", lambda q, v: visited.append(len(q)) or real(q, v))
    query = as_row(np.array([7]), 0)
    best = topk._visit(space, 10, query, annuli, np.array([-np.inf]))
    score = x @ x[7]
    score[7] = -(1 << 60)
    assert sorted(best.held[1].tolist()) == sorted(score.tolist())[-10:] and sum(visited) < 10


def test_products_of_any_size_are_exact():
    for top in (10, 1 << 30, 1 << 62):
        rng = np.random.default_rng(top % 1000)
        q, x = rng.integers(-top, top, (3, 5)), rng.integers(-top, top, (4, 5))
        clip = lambda v: min(max(v, -(1 << 63)), (1 << 63) - 1)
        assert topk.products(q, x).tolist() == [[clip(sum(int(a) * int(b) for a, b in zip(u, v, strict=True))) for v in x] for u in q]


def test_empty_and_small_tables(spark):
    rows = table(spark, cases())
    asks = F.col("vec_id") % 20 == 0
    assert topk.search(rows.limit(0), asks, 20).count() == 0 == topk.search(rows.limit(1), F.lit(True), 20).count()
    assert topk.search(rows, F.lit(False), 20).count() == 0
    empty = table(spark, [(1, []), (20, [])])
    assert sorted(map(tuple, topk.search(empty, asks, 20).collect())) == [(20, 1, 1, 0)]
    assert whitening.whiten(rows.limit(0), whitening.fit(rows.limit(0))).count() == 0 == whitening.whiten(empty, whitening.fit(empty)).count()


def test_whitening_equals_numpy(spark):
    rows = cases(2)
    given = table(spark, rows)
    model = whitening.fit(given)
    got = whitening.whiten(given, model).collect()
    x = integers(rows, 256)
    whole = np.array(sorted({tuple(v) for _, v in x}))
    n, sums = len(whole), whole.sum(axis=0)
    assert model.n == n and model.sums == sums.tolist() and len(got) == 3 * len(x)
    centred = whole - whole.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    want = {}
    for i, v in x:
        for k in range(3):
            deviation = int(((n * np.array(v) - sums) ** 2).sum())
            want.setdefault((i, k + 1, deviation), []).append(abs((np.array(v) - sums / n) @ axes[:, 2 - k] / np.sqrt(values[2 - k])))
    for r in got:
        assert min(abs(abs(r.whitened) - w) for w in want[r.vec_id, r.component, r.deviation]) < 1e-9
        assert r.n == n and abs(r.explained - values[3 - r.component] / values.sum()) < 1e-12 and 0 <= r.identity_error < 1e-9


def test_merged_moments_do_not_depend_on_the_parts():
    rng = np.random.default_rng(5)
    rows = rng.integers(-(1 << 40), 1 << 40, (500, 6)) + (1 << 45)
    whole = whitening.moments(rows)
    merged = whitening.Moments(0, np.zeros(6), np.zeros((6, 6)), [0] * 6)
    for part in np.array_split(rows, [1, 7, 7, 200, 480]):
        if len(part):
            merged = whitening.merge(merged, whitening.moments(part))
    assert merged.n == 500 and merged.sums == whole.sums == [sum(c) for c in rows.T.tolist()]
    assert np.allclose(merged.scatter, whole.scatter, rtol=1e-12) and np.allclose(merged.mean, whole.mean, rtol=1e-14)


def test_directions_without_variance_and_large_entries(spark):
    flat = table(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(30)])
    got = whitening.whiten(flat, whitening.fit(flat)).collect()
    assert {r.component for r in got if r.whitened is None} == {2, 3} and max(r.identity_error for r in got) < 1e-9
    huge = table(spark, [(1, [3e38]), (2, [-3e38]), (3, [1.0])])
    rows = whitening.whiten(huge, whitening.fit(huge)).collect()
    assert len(rows) == 3 and all(r.deviation is None or r.deviation >= 0 for r in rows) and any(r.deviation is None for r in rows)
