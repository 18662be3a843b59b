"""Bundles of streamlines by the mean distance of their points, in either direction.

Lines are resampled to equal numbers of points. The distance of two lines is the mean distance of their points in order,
or with one of them reversed if that is less. It is never below the distance of the lines' mean points, so lines within a
threshold lie in the same or in neighbouring cells of that size, and lines meet by cells. Each cell is bundled on its own, a
bounded number of lines at a time, into prototypes; prototypes within the threshold are joined, with the reversal of each
along a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import discard, materialize

from .combine import CELL
from .spanning import minimum_forest
from .tables import resample_curve

#: Lines that are bundled together at a time.
TOGETHER = 4096


def distances(line: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distance of a line (points x 3) to each other one, and whether it is that of the reversed line."""
    straight, turned = (np.linalg.norm(others - p, axis=2).mean(axis=1) for p in (line, line[::-1]))
    return np.minimum(straight, turned), turned < straight


def bundle(lines: np.ndarray, threshold: float) -> tuple[list[int], list[bool], list[np.ndarray], list[int]]:
    """In order: each line joins the nearest prototype within the threshold, which moves to the mean of its lines, or makes
    a new one. Returns each line's prototype and whether it was reversed, and sums and counts of the prototypes."""
    which: list[int] = []
    turned: list[bool] = []
    sums: list[np.ndarray] = []
    counts: list[int] = []
    for line in lines:
        at, flip = -1, False
        if sums:
            away, flips = distances(line, np.array(sums) / np.array(counts)[:, None, None])
            at = int(away.argmin())
            at, flip = (at, bool(flips[at])) if away[at] <= threshold else (-1, False)
        if at < 0:
            at = len(sums)
            sums.append(np.zeros_like(line))
            counts.append(0)
        sums[at] = sums[at] + (line[::-1] if flip else line)
        counts[at] += 1
        which.append(at)
        turned.append(flip)
    return which, turned, sums, counts


_LOCAL = T.StructType([T.StructField(n, k) for n, k in (("line", T.LongType()), ("prototype", T.LongType()), ("turned", T.BooleanType()), ("lines", T.LongType()), ("points", T.ArrayType(T.DoubleType())))])


def bundles(curves: DataFrame, line: str, order: str, threshold: float, points: int = 12) -> tuple[DataFrame, DataFrame]:
    """(line, bundle, turned), and (bundle, lines, i, x, y, z): the bundle of each line and whether it runs against the
    bundle's smallest line, and the mean curves.

    ``line`` is a whole number that names the lines, ``threshold`` a positive distance. A bundle is named by its smallest
    line. Lines without length are left out. Where bundles are apart by more than the threshold the result is that of
    bundling all lines in order; where they are not, chains of near prototypes are one bundle. A cell of any number of lines
    is split by a hash of these, TOGETHER at a time.
    """
    curve = resample_curve(curves, line, order, list(CELL), points)
    packed = curve.groupBy(F.col(line).cast("long").alias("line")).agg(F.array_sort(F.collect_list(F.struct("sample", *CELL))).alias("p"), *[F.floor(F.avg(c) / threshold).alias(f"b{c}") for c in CELL])
    flat = F.flatten(F.transform("p", lambda p: F.array(*[p[c] for c in CELL])))
    cell = [f"b{c}" for c in CELL]
    lines = materialize(packed.select("line", *cell, flat.alias("points")), "lines")
    parts = lines.groupBy(*cell).agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    salted = lines.join(parts, cell).withColumn("part", F.pmod(F.xxhash64("line"), F.col("parts")))

    def local(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("line")
        ids = block["line"].to_numpy()
        which, turned, sums, counts = bundle(np.array(block["points"].tolist()).reshape(len(block), points, 3), threshold)
        first: dict[int, int] = {}
        for i, p in enumerate(which):
            first.setdefault(p, i)
        names = [int(ids[first[p]]) for p in which]
        heads = {first[p]: p for p in first}
        return pd.DataFrame({"line": ids, "prototype": names, "turned": turned, "lines": [counts[heads[i]] if i in heads else 0 for i in range(len(block))], "points": [sums[heads[i]].ravel().tolist() if i in heads else None for i in range(len(block))]})

    placed = materialize(salted.groupBy(*cell, "part").applyInPandas(local, _LOCAL), "bundled-lines")
    heads = placed.where("lines > 0").select("prototype", "lines", "points")
    mean = F.transform("points", lambda v: v / F.col("lines"))
    middle = [F.aggregate(F.sequence(F.lit(k), F.lit(3 * points - 3 + k), F.lit(3)), F.lit(0.0), lambda s, i: s + F.get("mean", i)) / points for k in range(3)]
    keyed = heads.withColumn("mean", mean).select("prototype", "mean", *[F.floor(m / threshold).alias(c) for m, c in zip(middle, cell, strict=True)])
    near = keyed
    for c in cell:
        near = near.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    pairs = keyed.select(F.col("prototype").alias("u"), F.col("mean").alias("p"), *cell).join(near.select(F.col("prototype").alias("v"), F.col("mean").alias("q"), *cell), cell).where("u < v")

    def measure(batches):
        for frame in batches:
            frame = frame.reset_index(drop=True)
            if len(frame):
                p, q = (np.array(frame[c].tolist()).reshape(len(frame), points, 3) for c in "pq")
                straight, turned = (np.linalg.norm(p - r, axis=2).mean(axis=1) for r in (q, q[:, ::-1]))
                yield pd.DataFrame({"u": frame["u"], "v": frame["v"], "cost": np.minimum(straight, turned), "a": frame["u"], "b": frame["v"], "turn": (turned < straight).astype(np.int64)})[np.minimum(straight, turned) <= threshold]

    edges = pairs.select("u", "v", "p", "q").mapInPandas(measure, "u long, v long, cost double, a long, b long, turn long")
    forest = minimum_forest(edges)
    # A prototype is named by its smallest line; the smallest of a bundle's prototypes names it and gives its direction.
    named = forest.groupBy("root").agg(F.min("node").alias("bundle"), F.min_by("turn", "node").alias("_base"))
    joined = forest.join(named, "root").select(F.col("node").alias("prototype"), "bundle", (F.pmod(F.col("turn") - F.col("_base"), F.lit(2)) == 1).alias("_against"))
    found = materialize(placed.join(joined, "prototype", "left").select("line", F.coalesce("bundle", "prototype").alias("bundle"), (F.col("turned") != F.coalesce("_against", F.lit(False))).alias("turned"), F.coalesce("_against", F.lit(False)).alias("_against"), "lines", "points"), "bundles")
    for table in (lines, placed):
        discard(table)
    spread = found.where("lines > 0").select("bundle", "lines", "_against", "points", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i"))
    i = F.when(F.col("_against"), points - 1 - F.col("_i")).otherwise(F.col("_i"))
    curves = spread.groupBy("bundle", i.cast("int").alias("i")).agg(F.sum("lines").alias("lines"), *[(F.sum(F.get("points", 3 * F.col("_i") + k)) / F.sum("lines")).alias(c) for k, c in enumerate(CELL)])
    return found.select("line", "bundle", "turned"), curves.select("bundle", "lines", "i", *CELL)
