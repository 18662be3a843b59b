"""Coordinate systems: bounds under a transform, spherical grids, star coordinates and seed patterns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cellwise import affine, magnitude

CELL = ("x", "y", "z")


def transform_bounds(low: Sequence[Column], high: Sequence[Column], matrix: Sequence[Sequence[float]], corners: int = 8) -> tuple[list[Column], list[Column]]:
    """The box around a transformed box: of all eight corners, or of the two extreme ones only, which is smaller."""
    if corners == 2:
        moved = [affine(matrix, *low), affine(matrix, *high)]
    else:
        moved = [affine(matrix, *(pair[i] for pair, i in zip(zip(low, high, strict=True), pick, strict=True))) for pick in product((0, 1), repeat=3)]
    axes = list(zip(*moved, strict=True))
    return [F.least(*a) for a in axes], [F.greatest(*a) for a in axes]


def from_spherical(radius: Column, azimuth: Column, polar: Column) -> list[Column]:
    """Cartesian coordinates of a spherical position."""
    return [radius * F.sin(polar) * F.cos(azimuth), radius * F.sin(polar) * F.sin(azimuth), radius * F.cos(polar)]


def shell(points: DataFrame, inner: float, outer: float) -> DataFrame:
    """Points whose distance from the origin lies between two radii, with that distance as ``radius``."""
    return points.withColumn("radius", magnitude(*map(F.col, CELL))).where(F.col("radius").between(inner, outer))


def radial_profile(points: DataFrame, value: str, width: float) -> DataFrame:
    """Count and mean of a value by distance from the origin, in rings of a width."""
    ring = F.floor(magnitude(*map(F.col, CELL)) / width).cast("int")
    return points.groupBy(ring.alias("ring")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def star_coordinates(values: Sequence[Column]) -> tuple[Column, Column]:
    """Each value along its own axis; the axes are spread evenly over the circle."""
    angles = [2 * math.pi * i / len(values) for i in range(len(values))]
    return tuple(reduce(add, (v * turn(a) for v, a in zip(values, angles, strict=True))) for turn in (math.cos, math.sin))


def disk_seeds(spark: SparkSession, rings: int, per_ring: int, radius: float, center: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Seeds (seed, x, y, z) on concentric circles of a disk across z."""
    ring, step = F.floor(F.col("id") / per_ring) + 1, F.col("id") % per_ring
    r, angle = ring * (radius / rings), step * (2 * math.pi / per_ring)
    return spark.range(rings * per_ring).select(F.col("id").alias("seed"), (r * F.cos(angle) + center[0]).alias("x"), (r * F.sin(angle) + center[1]).alias("y"), F.lit(float(center[2])).alias("z"))
