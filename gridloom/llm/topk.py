"""Exact top-k inner products by a pivot-distance index.

Vectors are lifted to points x' = (x, sqrt(M^2 - |x|^2)), M the largest norm, and queries to q' = (q, 0); then

    |q' - x'|^2 = |q|^2 + M^2 - 2 q.x

so the nearest points have the greatest products. Every vector is keyed by its nearest pivot and its distance to it, and
sorted by both; runs of these rows are annuli around pivots. By the triangle inequality a query at distance d from a pivot
is at least max(lo - d, d - hi) from all of the annulus [lo, hi]. Queries are sorted by the same key, so a block of them
is compact; a first pass through the annuli nearest to a block gives each query a bound, a second one visits the annuli
that the bounds leave, nearest first, and stops for a query where its own bound says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom import storage
from gridloom.session import discard, materialize

from .batches import named
from .vectors import fixed_point, matrix

#: Pivots at most, and rows for each of them; rows that pivots are chosen from (a sample: the index holds every row).
PIVOTS, PIVOT_ROWS, SAMPLE = 64, 1024, 2048
#: Rows and bytes of an annulus, queries of a block, annuli of a slice (one task's work for a block of queries), and
#: annuli around a pivot of the first pass.
ROWS, BYTES, QUERIES, SLICE, NEAR = 1024, 1 << 20, 256, 16, 4
#: Relative slack of distances, above their rounding errors.
SLACK = 1e-6

_LONGS = ("<i2", "<i4", "<i8")


class Space:
    """The lifted space: dimension, largest squared norm, and pivots as lifted rows."""

    def __init__(self, width: int, top: float, pivots: np.ndarray):
        self.width, self.top, self.pivots = width, top, pivots
        self.slack = SLACK * (np.sqrt(top) + 1)

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0.0))])

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """From each row, as a query or as a point, to each pivot."""
        points = np.column_stack([x.astype(np.float64), np.zeros(len(x))]) if query else self.lift(x)
        squares = (points * points).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0.0))

    def radius(self, x: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How far a point may be from each query whose product with it is to reach ``least``."""
        x = x.astype(np.float64)
        squares = (x * x).sum(axis=1) + self.top - 2 * least
        return np.sqrt(np.maximum(squares, 0.0)) + self.slack


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """Points far from each other: each next one is farthest from those before."""
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those beyond a long stay at its end."""
    bound = max(1, q.shape[1]) * max(1, abs(int(q.max(initial=0))), abs(int(q.min(initial=0)))) * max(1, abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if bound < 1 << 53:  # sums of this size are exact in floating point
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return q @ x.T
    whole = q.astype(object) @ x.astype(object).T
    return np.array([[min(max(v, -(1 << 63)), (1 << 63) - 1) for v in row] for row in whole.tolist()], np.int64).reshape(len(q), len(x))


_BLOCK = "block long, pivot int, lo double, hi double, ids array<long>, places array<long>, width int, bytes int, vectors binary"
_NAMES = ["block", "pivot", "lo", "hi", "ids", "places", "width", "bytes", "vectors"]


def _vectors(row: dict) -> np.ndarray:
    return np.frombuffer(row["vectors"], f"<i{row['bytes']}").reshape(len(row["places"]), row["width"]).astype(np.int64)


def _keyed(space: Space, query: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = space.distances(matrix(batch.column(2), space.width), query)
                nearest = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(away[np.arange(len(away)), nearest])], names=["vec_id", "place", "x", "pivot", "away"])

    return run


def _packed(space: Space, most: int, apart: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of sorted rows as one row each; with ``apart`` each run is around one pivot."""
    most = max(1, min(most, BYTES // (8 * max(1, space.width))))

    def block(number: int, table: pa.Table) -> pa.RecordBatch:
        x = matrix(table.column("x"), space.width)
        kind = next(k for k in _LONGS if not x.size or (np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max))
        away = table.column("away").to_numpy()
        values = [number, table.column("pivot")[0].as_py(), float(away.min()), float(away.max()), table.column("vec_id").to_pylist(), table.column("place").to_pylist(), space.width, int(kind[-1]), x.astype(kind).tobytes()]
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = storage.task_number() << 32
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            while batch.num_rows:
                pivots = batch.column(3).to_numpy()
                end = batch.num_rows if not apart else int(np.searchsorted(pivots, pivots[0], "right"))
                if held and (rows >= most or (apart and held[0].column(3)[0].as_py() != pivots[0])):
                    yield block(number, pa.Table.from_batches(held))
                    number, held, rows = number + 1, [], 0
                take = min(end, most - rows)
                held.append(batch.slice(0, take))
                rows += take
                batch = batch.slice(take)
        if held:
            yield block(number, pa.Table.from_batches(held))

    return run


class Best:
    """The best candidates so far of each query of a block."""

    def __init__(self, k: int, queries: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.held = [np.zeros(0, np.int64) for _ in range(4)]  # query, score, vec_id, place
        self.null = np.zeros(0, bool)

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, null: np.ndarray, place: np.ndarray) -> None:
        q, s, v, p = (np.concatenate([a, b]) for a, b in zip(self.held, (query, score, vec_id, place), strict=True))
        null = np.concatenate([self.null, null])
        order = np.lexsort((p, v, null, ~s, q))  # ~s falls as s rises, without overflow
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[rank < self.k]
        self.held = [a[keep] for a in (np.concatenate([self.held[0], query]), s, v, p)]
        self.null = null[keep]
        full = rank == self.k - 1
        # As floating point: a step lower, so that a score that was rounded up still reaches it.
        self.least[q[full]] = np.maximum(self.least[q[full]], np.nextafter(s[order][full].astype(np.float64), -np.inf))


def _visit(space: Space, k: int, query: dict, annuli: list[dict], least: np.ndarray) -> Best:
    """Expand annuli, nearest first, for a block of queries; a query passes over those that its bound rules out."""
    q, places = _vectors(query), np.array(query["places"], np.int64)
    away = space.distances(q, True)
    best = Best(k, len(q), least)
    order = sorted(annuli, key=lambda r: np.maximum(r["lo"] - away[:, r["pivot"]], away[:, r["pivot"]] - r["hi"]).min())
    for row in order:
        d = away[:, row["pivot"]]
        live = np.flatnonzero(np.maximum(row["lo"] - d, d - row["hi"]) <= space.radius(q, best.least))
        if not len(live):
            continue
        score = products(q[live], _vectors(row))
        own = np.array(row["places"], np.int64)
        fits = score >= best.least[live][:, None]
        fits &= places[live][:, None] != own
        a, b = np.nonzero(fits)
        null = np.array([x is None for x in row["ids"]])
        ids = np.array([x or 0 for x in row["ids"]], np.int64)
        best.add(live[a], score[a, b], ids[b], null[b], own[b])
    return best


def search(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, pivots: int = PIVOTS) -> DataFrame:
    """The k rows of greatest inner product with each query row: query_id, rank (from 1), vec_id, score.

    Vectors become floor(scale * entry); null ones and those with null or non-finite entries take no part, shorter ones
    count as filled up with zeros. Queries are the rows where ``is_query`` (of the table's columns) holds; candidates are
    all rows but the query's own, also those that repeat its id or vector. Ties go to the smaller vec_id, null last, then
    to either of equal rows. Fewer than k candidates give all of them; a table without queries gives none. Scores beyond a
    long stay at its end. Other columns are ignored.
    """
    chosen = vectors.select(named(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), named(vector_col).alias("vector"))
    rows = fixed_point(chosen, "vector", scale).select("vec_id", F.monotonically_increasing_id().alias("place"), "x", "asks")
    rows = materialize(rows, "topk-rows")
    norm = F.aggregate("x", F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double"))
    count, width, top = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    space = Space(width, top, np.zeros((1, width + 1)))
    sample = rows.orderBy(F.xxhash64("place"), "place").select("x").limit(SAMPLE).toArrow().column("x")
    if count:
        space.pivots = farthest_first(space.lift(matrix(sample, width)), min(pivots, max(1, count // PIVOT_ROWS)))
    index = _index(rows.drop("asks"), space, ROWS, False)
    asked = _index(rows.where("asks").drop("asks"), space, QUERIES, True)
    bounded = _bounds(index, asked, space, k)
    found = _candidates(index, bounded, space, k)
    order = Window.partitionBy("query_place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _index(rows: DataFrame, space: Space, most: int, query: bool) -> DataFrame:
    """Blocks of rows in order of nearest pivot and distance; equal keys are told apart, so any number of equal vectors
    spreads over tasks."""
    keyed = rows.select("vec_id", "place", "x").mapInArrow(_keyed(space, query), "vec_id long, place long, x array<long>, pivot int, away double")
    order = ("pivot", "away", "place")
    blocks = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_packed(space, most, not query), _BLOCK)
    return materialize(blocks, "topk-queries" if query else "topk-index")


def _bounds(index: DataFrame, asked: DataFrame, space: Space, k: int) -> DataFrame:
    """The blocks of queries with the k-th best score of each query among the annuli nearest to its block, and for each
    pivot the range of distances that the block's bounds leave."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                away = space.distances(_vectors(row), True)
                nearest = away.argmin(axis=1)
                for p in np.unique(nearest).tolist():
                    d = away[nearest == p, p]
                    yield pa.RecordBatch.from_pylist([{"asked": row["block"], "pivot": p, "low": float(d.min()), "high": float(d.max())}], pa.schema([("asked", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))

    near = asked.mapInArrow(homes, "asked long, pivot int, low double, high double")
    gap = F.greatest(F.col("lo") - F.col("high"), F.col("low") - F.col("hi"))
    ranked = near.join(index.select("block", "pivot", "lo", "hi"), "pivot").withColumn("rank", F.row_number().over(Window.partitionBy("asked", "pivot").orderBy(gap, "block")))
    pairs = ranked.where(F.col("rank") <= NEAR).select("asked", "block")

    def bound(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        query = {c: rows[0][f"q_{c}"] for c in _NAMES}
        least = _visit(space, k, query, rows, np.full(len(query["places"]), -np.inf)).least
        q = _vectors(query)
        away, radius = space.distances(q, True), space.radius(q, least)[:, None]
        return pa.Table.from_pylist([query | {"least": least.tolist(), "lows": (away - radius).min(axis=0).tolist(), "highs": (away + radius).max(axis=0).tolist()}], _BOUNDED_ARROW)

    both = pairs.join(index, "block").join(asked.select(*[F.col(c).alias(f"q_{c}") for c in _NAMES]), F.col("asked") == F.col("q_block"))
    return materialize(both.groupBy("asked").applyInArrow(bound, _BOUNDED), "topk-bounds")


_BOUNDED = _BLOCK + ", least array<double>, lows array<double>, highs array<double>"
_BOUNDED_ARROW = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())), ("width", pa.int32()), ("bytes", pa.int32()), ("vectors", pa.binary()), ("least", pa.list_(pa.float64())), ("lows", pa.list_(pa.float64())), ("highs", pa.list_(pa.float64()))])


def _candidates(index: DataFrame, bounded: DataFrame, space: Space, k: int) -> DataFrame:
    """(query_place, query_id, vec_id, place, score): per slice of annuli that a block of queries must visit, the best of
    each query that reach its bound."""
    ranges = bounded.select(F.col("block").alias("asked"), F.posexplode(F.arrays_zip("lows", "highs")).alias("pivot", "r")).select("asked", "pivot", "r.lows", "r.highs")
    # A slice is a run of consecutive annuli: the index numbers its blocks in order within each of its tasks.
    slices = F.struct("pivot", F.shiftright("block", 32).alias("part"), F.floor(F.col("block").bitwiseAND((1 << 32) - 1) / SLICE).alias("run"))
    pairs = ranges.join(index.select("block", "pivot", "lo", "hi"), "pivot").where("hi >= lows and lo <= highs").select("asked", "block", slices.alias("slice"))
    queries = bounded.select(*[F.col(c).alias(f"q_{c}") for c in _NAMES], F.col("least").alias("q_least"))

    def visit(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        query = {c: rows[0][f"q_{c}"] for c in _NAMES}
        best = _visit(space, k, query, rows, np.array(rows[0]["q_least"], np.float64))
        at, score, ids, places = best.held
        asked = pa.array(query["ids"], pa.int64())
        return pa.table(
            [pa.array(np.array(query["places"], np.int64)[at]), asked.take(pa.array(at)), pa.array(ids, mask=best.null), pa.array(places), pa.array(score)],
            names=["query_place", "query_id", "vec_id", "place", "score"],
        )

    both = pairs.join(index, "block").join(queries, F.col("asked") == F.col("q_block"))
    return both.groupBy("asked", "slice").applyInArrow(visit, "query_place long, query_id long, vec_id long, place long, score long")
