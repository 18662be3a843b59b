"""Combination of two fields, list operators and ensembles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ("x", "y", "z")


def align(a: DataFrame, b: DataFrame, on: Sequence[str] = CELL, how: str = "inner", left: str = "a", right: str = "b", value: str = "v") -> DataFrame:
    """Two fields cell by cell, with their values as columns ``left`` and ``right``."""
    return a.select(*on, F.col(value).alias(left)).join(b.select(*on, F.col(value).alias(right)), list(on), how)


def checkerboard(a: Column, b: Column, block: int, x: Column, y: Column, z: Column) -> Column:
    """Blocks of two volumes in turn."""
    parity = F.pmod(F.floor(x / block) + F.floor(y / block) + F.floor(z / block), F.lit(2))
    return F.when(parity == 0, a).otherwise(b)


def label_overlay(value: Column, label: Column, opacity: float, levels: float) -> Column:
    """The value blended with a label's level; label 0 is transparent."""
    return F.when(label == 0, value).otherwise(value * (1 - opacity) + label * levels * opacity)


def interpolate_time(series: DataFrame, time: str, at: float, keys: Sequence[str], value: str) -> DataFrame:
    """Linear interpolation between the two list members around a fractional position, in one aggregation."""
    low = int(at // 1)
    f = at - low
    near = series.where(F.col(time).isin(low, low + 1) if f else F.col(time) == low)
    weight = F.when(F.col(time) == low, 1 - f).otherwise(f)
    enough = F.count("*") == (2 if f else 1)
    return near.groupBy(*keys).agg(F.when(enough, F.sum(F.col(value) * weight)).alias(value)).where(F.col(value).isNotNull())


def resample(field: DataFrame, value: str, factor: Sequence[float], shape: Sequence[int]) -> DataFrame:
    """Nearest-cell resampling: a target cell takes the source cell at its coordinates times the factors, by equi-join."""
    spark = field.sparkSession
    target = spark.range(shape[0] * shape[1] * shape[2])
    x, y, z = (F.col("id") % shape[0]).cast("int"), (F.floor(F.col("id") / shape[0]) % shape[1]).cast("int"), F.floor(F.col("id") / (shape[0] * shape[1])).cast("int")
    target = target.select(x.alias("x"), y.alias("y"), z.alias("z"))
    source = target.select("*", *[F.floor(F.col(a) * f).cast("int").alias(f"s{a}") for a, f in zip(CELL, factor, strict=True)])
    cells = field.select(*[F.col(a).alias(f"s{a}") for a in CELL], value)
    return source.join(cells, ["sx", "sy", "sz"]).select(*CELL, value)


def densify(field: DataFrame, shape: Sequence[int], value: str, pad: float = 0.0) -> DataFrame:
    """The full grid of a shape; cells that the field lacks get the pad value. Also pads to equal dimensions."""
    spark = field.sparkSession
    n = shape[0] * shape[1] * shape[2]
    grid = spark.range(n).select((F.col("id") % shape[0]).cast("int").alias("x"), (F.floor(F.col("id") / shape[0]) % shape[1]).cast("int").alias("y"), F.floor(F.col("id") / (shape[0] * shape[1])).cast("int").alias("z"))
    return grid.join(field.select(*CELL, value), list(CELL), "left").withColumn(value, F.coalesce(value, F.lit(pad)))


def append(lists: Sequence[DataFrame], key: str = "port") -> DataFrame:
    """Lists one after another, with the number of the list that each row came from."""
    return reduce(DataFrame.unionByName, [d.withColumn(key, F.lit(i)) for i, d in enumerate(lists)])


def interleave(lists: Sequence[DataFrame], order: str) -> DataFrame:
    """Rows of several lists in turn, cut at the shortest: position, port and the columns of the lists.

    Positions are counted within each list by ranges of its order, so lists may be of any length.
    """
    from .graph import compact

    numbered = append([compact(d, order, "_n") for d in lists])
    shortest = numbered.groupBy("port").agg(F.count("*").alias("_size")).agg(F.min("_size").alias("_least"))
    return numbered.crossJoin(F.broadcast(shortest)).where("_n < _least").withColumn("position", F.col("_n") * len(lists) + F.col("port")).drop("_n", "_least")


def common_fields(ensemble: DataFrame, member: str = "member", field: str = "field") -> DataFrame:
    """Every field, and whether all members have it."""
    members = ensemble.agg(F.countDistinct(member).alias("_members"))
    held = ensemble.groupBy(field).agg(F.countDistinct(member).alias("members"))
    return held.crossJoin(F.broadcast(members)).select(field, "members", (F.col("members") == F.col("_members")).alias("common"))


def ensemble_hash(ensemble: DataFrame, member: str = "member", time: str = "time", field: str = "field") -> DataFrame:
    """md5 over member names with their numbers of steps, then the unique and the common field names, all in order."""
    steps = ensemble.groupBy(member).agg(F.countDistinct(time).alias("steps"))
    names = steps.agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(F.col(member).cast("string").alias("m"), "steps"))), lambda s: F.concat(s["m"], s["steps"].cast("string")))).alias("a"))
    held = common_fields(ensemble, member, field)
    fields = held.agg(F.concat_ws("", F.array_sort(F.collect_list(field))).alias("b"), F.concat_ws("", F.array_sort(F.collect_list(F.when(F.col("common"), F.col(field))))).alias("c"))
    return names.crossJoin(F.broadcast(fields)).select(F.md5(F.concat("a", "b", "c")).alias("hash"))


def overlap(before: DataFrame, after: DataFrame, label: str, least: float) -> DataFrame:
    """Pairs of labels of two time steps whose shared cells are at least a share of the earlier label's."""
    a = before.select(*CELL, F.col(label).alias("from_label"))
    b = after.select(*CELL, F.col(label).alias("to_label"))
    shared = a.join(b, list(CELL)).groupBy("from_label", "to_label").agg(F.count("*").alias("shared"))
    sizes = a.groupBy("from_label").agg(F.count("*").alias("size"))
    return shared.join(sizes, "from_label").withColumn("fraction", F.col("shared") / F.col("size")).where(F.col("fraction") >= least)


def similarity(samples: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(i, j, distance): root mean square difference of the samples of each pair of groups that share keys.

    Samples are joined on their key, so the work is groups squared per key, not rows squared.
    """
    a = samples.select(F.col(group).alias("i"), key, F.col(value).alias("_a"))
    b = samples.select(F.col(group).alias("j"), key, F.col(value).alias("_b"))
    d = F.col("_a") - F.col("_b")
    return a.join(b, key).where("i < j").groupBy("i", "j").agg(F.sqrt(F.avg(d * d)).alias("distance"))
