"""Spline fits and regressions by sums: Spark adds up what the normal equations need, a small solve per group follows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Coefficients of the four uniform cubic B-splines on a unit interval, by powers of the place in it (rows: splines).
CUBIC = np.array([[1, -3, 3, -1], [4, 0, -6, 3], [1, 3, 3, -3], [0, 0, 0, 1]]) / 6.0


def banded_solve(band: np.ndarray, right: np.ndarray, tiny: float = 1e-12) -> np.ndarray:
    """Solve a symmetric positive system given by its diagonals (band[k, i] = a[i, i + k]) by banded Cholesky, in linear
    time; unknowns that nothing depends on become 0."""
    width, n = band.shape
    least = tiny * max(band[0].max(initial=0.0), 1e-300)
    lower = np.zeros((n, width))
    y = np.zeros(n)
    for i in range(n):
        for j in range(max(0, i - width + 1), i):
            first = max(0, i - width + 1)
            both = sum(lower[i, i - k] * lower[j, j - k] for k in range(max(first, j - width + 1), j))
            lower[i, i - j] = (band[i - j, j] - both) / lower[j, 0] if lower[j, 0] else 0.0
        pivot = band[0, i] - (lower[i, 1:] ** 2).sum()
        lower[i, 0] = np.sqrt(pivot) if pivot > least else 0.0
        y[i] = (right[i] - sum(lower[i, k] * y[i - k] for k in range(1, min(width, i + 1)))) / lower[i, 0] if lower[i, 0] else 0.0
    x = np.zeros(n)
    for i in range(n - 1, -1, -1):
        x[i] = (y[i] - sum(lower[i + k, k] * x[i + k] for k in range(1, min(width, n - i)))) / lower[i, 0] if lower[i, 0] else 0.0
    return x


def _spans(points: DataFrame, x: str, y: str, pieces: int, by: Sequence[str]) -> DataFrame:
    """Points with the ends of their group, the piece of the range that they lie in, and their place in it."""
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    ends = known.groupBy(*by).agg(F.min("_x").alias("low"), F.max("_x").alias("high"))
    if by:
        renamed = ends.select(*[F.col(c).alias(f"_{c}") for c in by], "low", "high")
        condition = F.lit(True)
        for c in by:
            condition = condition & known[c].eqNullSafe(renamed[f"_{c}"])
        joined = known.join(renamed, condition)
    else:
        joined = known.crossJoin(F.broadcast(ends))  # one row
    place = F.when(F.col("high") > F.col("low"), (F.col("_x") - F.col("low")) / (F.col("high") - F.col("low")) * pieces).otherwise(0.0)
    piece = F.least(F.floor(place), F.lit(pieces - 1)).cast("int")
    return joined.select(*by, "low", "high", "_x", "_y", piece.alias("_piece"), (place - piece).alias("_t"))


def spline_fit(points: DataFrame, x: str, y: str, pieces: int = 8, by: Sequence[str] = (), smooth: float = 0.0) -> DataFrame:
    """(*by, low, high, coefficients): the least-squares cubic spline of y over x, with ``pieces`` equal pieces between the
    smallest and the largest x of each group; ``pieces`` + 3 coefficients of uniform B-splines.

    Per piece Spark sums the powers of the place in it and their products with y: as many numbers as pieces, whatever the
    number of points. They give the bands of the normal equations, solved in linear time. ``smooth`` weighs the squared
    second differences of coefficients, as a share of the mean diagonal; without it coefficients that no point touches
    are 0. Points with a missing x or y take no part; null groups are a group.
    """
    spans = _spans(points, x, y, pieces, by)
    powers = [F.sum(F.pow("_t", F.lit(float(k)))).alias(f"_s{k}") for k in range(7)]
    products = [F.sum(F.pow("_t", F.lit(float(k))) * F.col("_y")).alias(f"_p{k}") for k in range(4)]
    sums = spans.groupBy(*by, "_piece").agg(F.first("low").alias("low"), F.first("high").alias("high"), *powers, *products)
    types = dict(sums.dtypes)

    def solve(block: pd.DataFrame) -> pd.DataFrame:
        band, right = np.zeros((4, pieces + 3)), np.zeros(pieces + 3)
        for _, row in block.iterrows():
            first = int(row["_piece"])
            hankel = np.array([[row[f"_s{i + j}"] for j in range(4)] for i in range(4)], float)
            gram = CUBIC @ hankel @ CUBIC.T
            for i in range(4):
                right[first + i] += CUBIC[i] @ np.array([row[f"_p{k}"] for k in range(4)], float)
                for j in range(i, 4):
                    band[j - i, first + i] += gram[i, j]
        if smooth:
            weight, second = smooth * band[0].mean(), (1.0, -2.0, 1.0)
            for i in range(pieces + 1):
                for a in range(3):
                    for b in range(a, 3):
                        band[b - a, i + a] += weight * second[a] * second[b]
        head = block.iloc[0]
        return pd.DataFrame([[*[head[c] for c in by], head["low"], head["high"], banded_solve(band, right).tolist()]], columns=[*by, "low", "high", "coefficients"])

    schema = ", ".join([f"{c} {types[c]}" for c in by] + ["low double", "high double", "coefficients array<double>"])
    return (sums if by else sums.withColumn("_all", F.lit(0))).groupBy(*(by or ["_all"])).applyInPandas(solve, schema)


def spline_values(points: DataFrame, x: str, fit: DataFrame, by: Sequence[str] = (), out: str = "fitted") -> DataFrame:
    """The points with the value of their group's spline; null outside its range, for a missing x and without a fit."""
    model = fit.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("coefficients").alias("_coefficients"))
    condition = F.lit(True)
    for c in by:
        condition = condition & points[c].eqNullSafe(model[f"_{c}"])
    joined = points.join(model, condition, "left")
    pieces = F.size("_coefficients") - 3
    place = F.when(F.col("_high") > F.col("_low"), (F.col(x) - F.col("_low")) / (F.col("_high") - F.col("_low")) * pieces).otherwise(0.0)
    piece = F.least(F.floor(place), pieces - 1).cast("int")
    t = place - piece
    value = F.lit(0.0)
    for i in range(4):
        basis = sum((F.lit(float(c)) * F.pow(t, F.lit(float(k))) for k, c in enumerate(CUBIC[i])), F.lit(0.0))
        value = value + basis * F.get("_coefficients", piece + i)
    inside = F.col(x).between(F.col("_low"), F.col("_high"))
    return joined.select(*[points[c] for c in points.columns], F.when(inside, value).alias(out))


def multiple_regression(points: DataFrame, xs: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, n, intercept, slopes, r2): least squares of y on several columns, from means and covariances alone.

    Rows with a missing value take no part. Columns that others determine get the shares of the shortest solution; r2 is
    null where y does not vary.
    """
    names = [f"_x{i}" for i in range(len(xs))]
    known = points.select(*by, *[F.col(c).cast("double").alias(n) for c, n in zip(xs, names, strict=True)], F.col(y).cast("double").alias("_y")).dropna(subset=[*names, "_y"])
    every = [*names, "_y"]
    covariances = [F.covar_pop(a, b).alias(f"_c{i}_{j}") for i, a in enumerate(every) for j, b in enumerate(every) if j >= i]
    sums = known.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(every)], *covariances).where("n > 0")
    types = dict(sums.dtypes)
    size = len(xs)

    def solve(frames):
        for frame in frames:
            rows = []
            for _, row in frame.iterrows():
                full = np.array([[row[f"_c{min(i, j)}_{max(i, j)}"] for j in range(size + 1)] for i in range(size + 1)], float)
                means = np.array([row[f"_m{i}"] for i in range(size + 1)], float)
                scale = np.sqrt(np.maximum(np.diag(full)[:size], 0))
                scale[scale == 0] = 1.0
                slopes = np.linalg.lstsq(full[:size, :size] / np.outer(scale, scale), full[:size, size] / scale, rcond=1e-12)[0] / scale
                spread = full[size, size]
                rows.append([*[row[c] for c in by], int(row["n"]), means[size] - slopes @ means[:size], slopes.tolist(), slopes @ full[:size, size] / spread if spread > 0 else None])
            yield pd.DataFrame(rows, columns=[*by, "n", "intercept", "slopes", "r2"])

    return sums.mapInPandas(solve, ", ".join([f"{c} {types[c]}" for c in by] + ["n long", "intercept double", "slopes array<double>", "r2 double"]))
