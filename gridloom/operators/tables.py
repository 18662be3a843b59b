"""Plot-table operators: selection, grouping, merging, curves and fits."""

from __future__ import annotations

import ast
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def brushed(intervals: dict[str, Sequence[tuple[float, float]]]) -> Column:
    """All axes must lie in one of their intervals."""
    axes = [reduce(lambda p, q: p | q, (F.col(c).between(a, b) for a, b in parts)) for c, parts in intervals.items()]
    return reduce(lambda p, q: p & q, axes, F.lit(True))


def merge(left: DataFrame, right: DataFrame, key: str, suffix: str = "_2") -> DataFrame:
    """Full outer join on a key column; columns of the second table that clash get a suffix."""
    renamed = right.select(key, *[F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c != key])
    return left.join(renamed, key, "full_outer")


def candles(series: DataFrame, bucket: Column, time: str, value: str, by: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """First, highest, lowest and last value per bucket, without a window."""
    order = F.struct(time, tie) if tie else F.col(time)
    return series.groupBy(*by, bucket.alias("bucket")).agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"))


def linear_fit(points: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def polynomial_moments(points: DataFrame, x: str, y: str, degree: int, by: Sequence[str] = ()) -> DataFrame:
    """Sums of powers for the normal equations of a polynomial fit; as many numbers as coefficients, per group."""
    px = [F.sum(F.pow(F.col(x), F.lit(float(k)))).alias(f"x{k}") for k in range(2 * degree + 1)]
    py = [F.sum(F.pow(F.col(x), F.lit(float(k))) * F.col(y)).alias(f"y{k}") for k in range(degree + 1)]
    return points.groupBy(*by).agg(*px, *py)


def polynomial_fit(points: DataFrame, x: str, y: str, degree: int, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares coefficients c0.. of a polynomial: sums in Spark, one small solve per group."""
    import numpy as np
    import pandas as pd

    moments = polynomial_moments(points, x, y, degree, by)
    if not by:
        moments = moments.withColumn("_g", F.lit(0))
    keys = list(by) or ["_g"]

    def solve(frames):
        for frame in frames:
            rows = []
            for _, r in frame.iterrows():
                a = np.array([[r[f"x{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)], float)
                b = np.array([r[f"y{i}"] for i in range(degree + 1)], float)
                rows.append([*[r[k] for k in keys], *np.linalg.lstsq(a, b, rcond=None)[0]])
            yield pd.DataFrame(rows, columns=[*keys, *[f"c{i}" for i in range(degree + 1)]])

    types = dict(moments.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"c{i} double" for i in range(degree + 1)])
    out = moments.mapInPandas(solve, schema)
    return out if by else out.drop("_g")


def arc_length(curve: DataFrame, line: str, order: str, coordinates: Sequence[str]) -> DataFrame:
    """Curve points with their distance along the line; a line is one polyline, windows are per line."""
    w = Window.partitionBy(line).orderBy(order)
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in coordinates), F.lit(0.0)))
    stepped = curve.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return stepped.withColumn("length", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def resample_curve(curve: DataFrame, line: str, order: str, coordinates: Sequence[str], points: int) -> DataFrame:
    """Points at equal distances along each line: every segment yields the samples that fall on it."""
    w = Window.partitionBy(line).orderBy(order)
    along = arc_length(curve, line, order, coordinates)
    along = along.withColumn("_total", F.max("length").over(Window.partitionBy(line)))
    ahead = along.select("*", F.lead("length").over(w).alias("_next"), *[F.lead(c).over(w).alias(f"_n_{c}") for c in coordinates])
    spacing = F.col("_total") / (points - 1)
    first, last = F.ceil(F.col("length") / spacing - 1e-9), F.floor(F.col("_next") / spacing - 1e-9)
    final = F.when(F.col("_next") >= F.col("_total"), F.lit(points - 1).cast("long")).otherwise(last)
    filled = ahead.where(F.col("_next").isNotNull() & (F.col("_total") > 0)).withColumn("sample", F.explode(F.when(first <= final, F.sequence(first, final)).otherwise(F.array().cast("array<bigint>"))))
    t = F.when(F.col("_next") > F.col("length"), (F.col("sample") * spacing - F.col("length")) / (F.col("_next") - F.col("length"))).otherwise(0.0)
    return filled.select(line, "sample", *[(F.col(c) + t * (F.col(f"_n_{c}") - F.col(c))).alias(c) for c in coordinates])


#: Functions and operators that a plot expression may use.
FUNCTIONS = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "exp": F.exp, "log": F.ln, "log10": F.log10, "sqrt": F.sqrt, "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "min": F.least, "max": F.greatest, "atan2": F.atan2}


def plot_expression(text: str, variables: Sequence[str]) -> Column:
    """A Column from an arithmetic expression over named columns; only listed functions and variables are allowed."""
    operators = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Pow: F.pow}

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in operators:
            return operators[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in variables:
            return F.col(node.id).cast("double")
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and not node.keywords:
            return FUNCTIONS[node.func.id](*map(build, node.args))
        raise ValueError(f"not allowed in a plot expression: {ast.dump(node)[:80]}")

    return build(ast.parse(text.replace("^", "**"), mode="eval").body)


def sampled(spark, text: str, variable: str, low: float, high: float, points: int) -> DataFrame:
    """A plot function as a table of equally spaced points."""
    x = spark.range(points).select((F.lit(low) + F.col("id") * ((high - low) / (points - 1))).alias(variable))
    return x.withColumn("value", plot_expression(text, [variable]))
