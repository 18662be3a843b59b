"""Cell-wise operators: Columns from Columns, so that Catalyst fuses any chain of them into one pass over a scan."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def binarize(v: Column, threshold: float) -> Column:
    """1 from the threshold on, else 0."""
    return F.when(v >= threshold, 1).otherwise(0)


def threshold(v: Column, limit: float, replacement: float, below: bool = True) -> Column:
    """Values on one side of the limit are replaced."""
    return F.when((v < limit) if below else (v > limit), F.lit(replacement)).otherwise(v)


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def image_threshold(v: Column, lower: float, upper: float, lower_mask: float, upper_mask: float) -> Column:
    """At most ``lower`` gives one mask, above ``upper`` the other, else the value."""
    return F.when(v <= lower, F.lit(lower_mask)).when(v > upper, F.lit(upper_mask)).otherwise(v)


def color_distance_mask(channels: Sequence[Column], reference: Sequence[float], tolerance: float = 0.01) -> Column:
    """Whether a mask colour lies within the tolerance of the reference colour."""
    return F.sqrt(sum(((c - r) * (c - r) for c, r in zip(channels, reference, strict=True)), F.lit(0.0))) < tolerance


def rescale(df: DataFrame, value: str, low: float = 0.0, high: float = 1.0, out: str = "rescaled") -> DataFrame:
    """Min-max rescaling of a whole field; the extremes are one row, joined to every cell."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * (high - low) + low
    return df.crossJoin(F.broadcast(ends)).withColumn(out, scaled).drop("_lo", "_hi")


def invert(df: DataFrame, value: str, out: str = "inverted") -> DataFrame:
    """max + min - v."""
    ends = df.agg((F.min(value) + F.max(value)).alias("_sum"))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, F.col("_sum") - F.col(value)).drop("_sum")


def transfer(v: Column, keys: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear lookup through (position, value) keys, constant beyond the ends."""
    keys = sorted(keys)
    out = F.when(v <= keys[0][0], F.lit(keys[0][1]))
    for (a, p), (b, q) in zip(keys, keys[1:], strict=False):
        out = out.when(v <= b, F.lit(p) + (v - a) * ((q - p) / (b - a)))
    return out.otherwise(F.lit(keys[-1][1]))


def preintegrated(front: Column, back: Column, keys: Sequence[tuple[float, float]]) -> Column:
    """Mean of the transfer function over a ray segment with the given end values, by its trapezoid."""
    return (transfer(front, keys) + transfer(back, keys)) / 2


def magnitude(*channels: Column) -> Column:
    """Euclidean norm; the absolute value of a single channel."""
    return F.abs(channels[0]) if len(channels) == 1 else F.sqrt(sum((c * c for c in channels[1:]), channels[0] * channels[0]))


def spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Radius, azimuth and polar angle; the polar angle of the null vector is 0."""
    radius = magnitude(x, y, z)
    return radius, F.atan2(y, x), F.when(radius == 0, F.lit(0.0)).otherwise(F.acos(z / radius))


def real_world(raw: Column, scale: float, offset: float) -> Column:
    return raw * scale + offset


def mirror(index: Column, size: int) -> Column:
    return F.lit(size - 1) - index


def scale_about(coordinate: Column, center: float, factor: float) -> Column:
    return (coordinate - center) * factor + center


def affine(matrix: Sequence[Sequence[float]], x: Column, y: Column, z: Column) -> list[Column]:
    """The first three components of a 4 x 4 matrix times (x, y, z, 1)."""
    return [x * r[0] + y * r[1] + z * r[2] + r[3] for r in matrix[:3]]


def mix(a: Column, b: Column, f: float) -> Column:
    return a * (1.0 - f) + b * f


def grayscale(r: Column, g: Column, b: Column) -> Column:
    """Luma with the Rec. 601 weights."""
    return r * 0.299 + g * 0.587 + b * 0.114


def luminance_alpha(r: Column) -> Column:
    return F.when(r > 0, 1.0).otherwise(0.0)


def linear_range(v: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    return F.lit(b[0]) + (v - a[0]) * ((b[1] - b[0]) / (a[1] - a[0]))


def box_inside(inner: Sequence[Column], outer: Sequence[Column]) -> Column:
    """Whether a box (x0, y0, x1, y1) lies in another, edges included."""
    return (inner[0] >= outer[0]) & (inner[1] >= outer[1]) & (inner[2] <= outer[2]) & (inner[3] <= outer[3])


def flag_priority(flags: Column, order: Sequence[tuple[int, str]], default: str) -> Column:
    """Name of the first flag in the order that is set."""
    out = None
    for bit, name in order:
        hit = flags.bitwiseAND(bit) != 0
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def discretize(v: Column, low: float, high: float, n: int) -> Column:
    """Clip to [low, high], or snap to one of n steps, halves to even."""
    step = (high - low) / max(n - 1, 1)
    inside = v if n == 1 else F.lit(low) + F.rint((v - low) / step) * step
    return F.when(v <= low, F.lit(low)).when(v >= high, F.lit(high)).otherwise(inside)


def rounded(v: Column, mode: str) -> Column:
    """none, nearest (halves to even), floor or ceil."""
    return {"none": lambda: v, "nearest": lambda: F.rint(v), "floor": lambda: F.floor(v).cast("double"), "ceil": lambda: F.ceil(v).cast("double")}[mode]()


def fringe(x: Column, rise: float, fall: float, strength: float) -> Column:
    """strength * (s(x / rise) - s(x / fall)) with the smooth step s."""

    def smooth(t: Column) -> Column:
        return F.when(t <= 0, F.lit(0.0)).when(t >= 1, F.lit(1.0)).otherwise(1 / (1 + F.exp(1 / (t - 1) + 1 / t)))

    return (smooth(x / rise) - smooth(x / fall)) * strength


def monod(substrate: Column, biomass: Column, rate: float, half: float) -> Column:
    """rate * s / (half + s) * biomass; null for a zero denominator."""
    return F.try_divide(substrate * rate, substrate + half) * biomass


def haldane(substrate: Column, biomass: Column, rate: float, half: float, inhibition: float) -> Column:
    return F.try_divide(substrate * rate, F.lit(half) + substrate + substrate * substrate / inhibition) * biomass


def pressure(rho: Column, inv_cs2: float, factor: float = 1.0) -> Column:
    return (rho - 1.0) / inv_cs2 * factor


def kinetic_energy(*u: Column) -> Column:
    return sum((c * c for c in u[1:]), u[0] * u[0]) * 0.5


def dissipation(pi_norm2: Column, nu: float, omega: float, inv_cs2: float, rho: Column) -> Column:
    return pi_norm2 * nu * (omega * inv_cs2) ** 2 / rho / 2.0


def strain_rate(pi: Column, omega: float, inv_cs2: float, rho: Column, dt: float) -> Column:
    return -pi * omega * inv_cs2 / rho / 2.0 / dt


def viscosity(omega: Column, inv_cs2: float, dx: float, dt: float, log: bool = False) -> Column:
    """Not a number where omega is 0."""
    nu = (1 / omega - 0.5) / inv_cs2 * (dx * dx) / dt
    return F.when(omega == 0, F.lit(math.nan)).otherwise(F.log10(nu) if log else nu)


def permeability(v: Column) -> Column:
    """Not a number, infinities and values above 1 become 1."""
    return F.when(F.isnan(v) | (v > 1) | (v == float("-inf")), F.lit(1.0)).otherwise(v)


def front_to_back(previous: Sequence[Column], color: Sequence[Column]) -> list[Column]:
    """Accumulated (r, g, b, a) after one more sample."""
    left = 1 - previous[3]
    return [p + left * color[3] * c for p, c in zip(previous[:3], color[:3], strict=True)] + [previous[3] + left * color[3]]


def source_over(top: Column, top_alpha: Column, under: Column) -> Column:
    return top * top_alpha + under * (1 - top_alpha)


def add_blend(top: Column, top_alpha: Column, under: Column) -> Column:
    return F.least(F.lit(1.0), top + under * (1 - top_alpha))


def unsharp(original: Column, blurred: Column, amount: float, limit: float) -> Column:
    return F.when(F.abs(original - blurred) < limit, original).otherwise(original * amount + blurred * (1 - amount))


def gabor(x: Column, y: Column, theta: float, wavelength: float, phase: float, sigma: float, gamma: float, pi: float = 3.141) -> Column:
    """Gabor kernel value mapped to [0, 1]; pi keeps the rounded literal of the original."""
    u, w = x * math.cos(theta) + y * math.sin(theta), -x * math.sin(theta) + y * math.cos(theta)
    return (F.exp(-(u * u + w * w * gamma**2) / (2 * sigma**2)) * F.cos(u * (2 * pi / wavelength) + phase) + 1) / 2
