"""Masked and grouped reductions, norms and statistics of fields; all partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked(df: DataFrame, mask: Column | None, by: Sequence[str], **columns: Column) -> DataFrame:
    """Aggregates over the cells of a mask; null, not 0, where no cell is in it."""
    chosen = df if mask is None else df.where(mask)
    return chosen.groupBy(*by).agg(*[c.alias(n) for n, c in columns.items()])


def sums(df: DataFrame, value: str, mask: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Sum and cell count, average, extremes."""
    v = F.col(value)
    return masked(df, mask, by, total=F.sum(v), cells=F.count("*"), average=F.avg(v), low=F.min(v), high=F.max(v))


def integral(df: DataFrame, value: str, spacing: float, dims: int = 3, mask: Column | None = None) -> DataFrame:
    return masked(df, mask, (), integral=F.sum(value) * spacing**dims)


def lp_norm(df: DataFrame, components: Sequence[Column], p: float, spacing: float = 1.0, dims: int = 3, mask: Column | None = None) -> DataFrame:
    """Weighted Lp norm over cells and components; p = 0 is the maximum norm and ignores the weight."""
    if p == 0:
        return masked(df, mask, (), norm=F.max(F.greatest(*map(F.abs, components), F.lit(0.0))))
    each = sum((F.pow(F.abs(c), F.lit(float(p))) for c in components[1:]), F.pow(F.abs(components[0]), F.lit(float(p))))
    return masked(df, mask, (), norm=F.pow(F.sum(each) * spacing**dims, F.lit(1.0 / p)))


def error_norms(df: DataFrame, wanted: str, found: str, p: float, spacing: float = 1.0) -> DataFrame:
    """Lp norm of the difference of two fields on the same cells, and its ratio to that of the wanted one."""
    e = lp_norm(df, [F.col(wanted) - F.col(found)], p, spacing).withColumnRenamed("norm", "absolute")
    w = lp_norm(df, [F.col(wanted)], p, spacing).withColumnRenamed("norm", "_wanted")
    return e.crossJoin(F.broadcast(w)).select("absolute", F.try_divide("absolute", F.col("_wanted")).alias("relative"))


def deviation(df: DataFrame, value: str, expected: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Population variance and standard deviation about the mean or a given value."""
    v = F.col(value)
    variance = F.var_pop(v) if expected is None else F.avg((v - expected) * (v - expected))
    return masked(df, None, by, variance=variance, deviation=F.sqrt(variance))


def exact_sum(df: DataFrame, value: str, scale: int = 6) -> DataFrame:
    """A sum that does not depend on the order of rows: decimal where a compensated sum would be used."""
    return df.agg(F.sum(F.col(value).cast(f"decimal(28,{scale})")).cast("double").alias("total"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins; the last one includes its upper end, values outside the range are left out."""
    v = F.col(value)
    number = F.least(F.floor((v - low) * (bins / (high - low))), F.lit(bins - 1)).cast("int")
    return df.where(v.between(low, high)).groupBy(*by, number.alias("bin")).agg(F.count("*").alias("n"))


def segments(df: DataFrame, label: str) -> DataFrame:
    """Per label: cells, share of all cells, centroid and bounding box."""
    rows = df.groupBy(label).agg(F.count("*").alias("cells"), *[F.avg(a).alias(f"c{a}") for a in "xyz"], *[F.min(a).alias(f"lo_{a}") for a in "xyz"], *[F.max(a).alias(f"hi_{a}") for a in "xyz"])
    total = df.agg(F.count("*").alias("_all"))
    return rows.crossJoin(F.broadcast(total)).withColumn("share", F.col("cells") / F.col("_all")).drop("_all")


def point_statistics(points: DataFrame, group: str, value: str) -> DataFrame:
    """Statistics of each group and, with a null group, of all points, in one pass."""
    return points.rollup(group).agg(F.count("*").alias("points"), F.avg(value).alias("average"), F.min(value).alias("low"), F.max(value).alias("high"))


def exceedance(ensemble: DataFrame, cell: Sequence[str], member: str, value: str, q: float, limit: float) -> DataFrame:
    """Per cell: share of samples above q, and whether at least ``limit`` of them are."""
    share = F.avg((F.col(value) > q).cast("double"))
    return ensemble.groupBy(*cell).agg(F.countDistinct(member).alias("members"), share.alias("probability")).withColumn("likely", F.col("probability") >= limit)


def volume_hash(field: DataFrame, cell: Column, fanout: int = 1024) -> DataFrame:
    """(hash) of all cells, each as the text ``cell``: digests of pieces of rows, then of rows, slices and slabs.

    A group holds at most ``fanout`` digests (for axes of up to fanout^2 cells), so no task collects the volume. The
    result does not depend on the order or the partitions of the rows.
    """
    level = field.select("x", "y", "z", cell.alias("h"))
    for keys, axis in (("zyx", "x"), ("zy", "x"), ("zy", "y"), ("z", "y"), ("z", "z"), ("", "z")):
        groups = [(F.floor(F.col(c) / fanout) if c == axis else F.col(c)).alias(f"_{c}") for c in keys]
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(axis, "h"))), lambda s: s["h"])
        level = level.groupBy(*groups).agg(F.md5(F.concat_ws(",", ordered)).alias("h")).withColumnsRenamed({f"_{c}": c for c in keys})
    return level.withColumnRenamed("h", "hash")
