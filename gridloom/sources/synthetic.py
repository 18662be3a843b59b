"""Synthetic fields and particles from ``spark.range`` and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cells(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    i = F.col("id")
    return spark.range(nx * ny * nz).select((i % nx).cast("int").alias("x"), (F.floor(i / nx) % ny).cast("int").alias("y"), F.floor(i / (nx * ny)).cast("int").alias("z"))


def channel_flow(spark: SparkSession, n: int, peak: float = 1.0) -> DataFrame:
    """A parabolic flow along x through a round channel."""
    r2 = ((F.col("y") - (n - 1) / 2) * (F.col("y") - (n - 1) / 2) + (F.col("z") - (n - 1) / 2) * (F.col("z") - (n - 1) / 2)) / ((n / 2) ** 2)
    return cells(spark, n, n, n).withColumns({"u0": F.greatest(F.lit(0.0), (1 - r2) * peak), "u1": F.lit(0.0), "u2": F.lit(0.0)})


def shell(spark: SparkSession, n: int, radius: float, shift: float = 0.0) -> DataFrame:
    """Distance from a sphere about the shifted centre."""
    c = (n - 1) / 2 + shift
    d = F.sqrt(sum(((F.col(a) - c) * (F.col(a) - c) for a in "xyz"), F.lit(0.0)))
    return cells(spark, n, n, n).withColumn("v", F.abs(d - radius))


def particles(spark: SparkSession, count: int, steps: int, seed: int = 1) -> DataFrame:
    """Particles on straight paths, a row per time step; the same for any number of partitions."""

    def uniform(name: str) -> Column:
        return F.pmod(F.xxhash64(F.col("id"), F.lit(f"{seed}{name}")), F.lit(1 << 40)) / (1 << 40)

    base = spark.range(count).select("id", *[uniform(a).alias(a) for a in "xyz"], *[(uniform("v" + a) - 0.5).alias("v" + a) for a in "xyz"], uniform("m").alias("mass"))
    moved = base.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return moved.select("t", "id", *[(F.col(a) + F.col("v" + a) * F.col("t")).alias(a) for a in "xyz"], "vx", "vy", "vz", "mass")


def box_muller(a: Column, b: Column) -> Column:
    """A standard normal value from two uniform ones."""
    return F.sqrt(F.ln(a) * -2) * F.cos(b * 6.283185307179586)
