"""Moments of lattice populations as Columns: the populations of a cell are one array column."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights by squared speed of the usual velocity sets (fixed values of the method).
WEIGHTS = {"D2Q9": {0: 4 / 9, 1: 1 / 9, 2: 1 / 36}, "D3Q19": {0: 1 / 3, 1: 1 / 18, 2: 1 / 36}, "D3Q27": {0: 8 / 27, 1: 2 / 27, 2: 1 / 54, 3: 1 / 216}}
CS2 = 1 / 3


def velocities(name: str) -> list[tuple[int, ...]]:
    """All vectors of -1, 0 and 1 whose squared speed has a weight, the rest velocity first."""
    dims = int(name[1])
    return sorted((c for c in product((-1, 0, 1), repeat=dims) if sum(i * i for i in c) in WEIGHTS[name]), key=lambda c: (sum(i * i for i in c), c))


def weight(name: str, c: tuple[int, ...]) -> float:
    return WEIGHTS[name][sum(i * i for i in c)]


def density(f: Column, name: str) -> Column:
    return sum((f[i] for i in range(1, len(velocities(name)))), f[0])


def momentum(f: Column, name: str) -> list[Column]:
    """Flux: the first moments."""
    sets = velocities(name)
    return [sum((f[i] * float(c[a]) for i, c in enumerate(sets) if c[a]), F.lit(0.0)) for a in range(len(sets[0]))]


def velocity(f: Column, name: str) -> list[Column]:
    rho = density(f, name)
    return [F.try_divide(m, rho) for m in momentum(f, name)]


def equilibrium(rho: Column, u: list[Column], name: str) -> Column:
    """Second-order equilibrium populations as an array."""
    square = sum((c * c for c in u[1:]), u[0] * u[0])
    out = []
    for c in velocities(name):
        cu = sum((x * float(i) for x, i in zip(u, c, strict=True)), F.lit(0.0))
        out.append(rho * weight(name, c) * (1 + cu / CS2 + cu * cu / (2 * CS2 * CS2) - square / (2 * CS2)))
    return F.array(*out)


def with_equilibrium(df: DataFrame, f: str, name: str) -> DataFrame:
    """Add rho, u (array) and eq (array), one projection after another, so that no expression is written out twice."""
    df = df.withColumn("rho", density(F.col(f), name))
    df = df.withColumn("u", F.array(*[F.try_divide(m, F.col("rho")) for m in momentum(F.col(f), name)]))
    return df.withColumn("eq", equilibrium(F.col("rho"), [F.col("u")[a] for a in range(len(velocities(name)[0]))], name))


def stress(f: Column, eq: Column, name: str) -> dict[tuple[int, int], Column]:
    """Second moments of the populations less those of their equilibrium."""
    sets = velocities(name)
    dims = len(sets[0])
    return {(a, b): sum(((f[i] - eq[i]) * float(c[a] * c[b]) for i, c in enumerate(sets) if c[a] * c[b]), F.lit(0.0)) for a in range(dims) for b in range(a, dims)}


def stress_norm2(pi: dict[tuple[int, int], Column]) -> Column:
    """Squared norm of the symmetric stress tensor."""
    return sum((p * p * (1.0 if a == b else 2.0) for (a, b), p in pi.items()), F.lit(0.0))


def relax(f: Column, eq: Column, omega: float) -> Column:
    """One collision towards equilibrium."""
    return F.zip_with(f, eq, lambda a, b: a + (b - a) * omega)


def knudsen(f: Column, eq: Column, name: str) -> Column:
    """Mean relative deviation of the populations from equilibrium."""
    q = len(velocities(name))
    return F.aggregate(F.zip_with(f, eq, lambda a, b: F.abs(F.try_divide(a - b, b))), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / q


def porous_epsilon(porosity: Column, floor: float = 1e-9) -> Column:
    return F.greatest(porosity, F.lit(floor))


def temperature_to_physical(t: Column, low: float, high: float) -> Column:
    """Lattice temperature 0.5 to 1.5 as a physical one."""
    return (t - 0.5) * (high - low) + low


def wall_shear(pi: dict[tuple[int, int], Column], normal: list[float]) -> Column:
    """Norm of the tangential part of stress times a wall normal."""
    dims = len(normal)
    at = lambda a, b: pi[(a, b) if a <= b else (b, a)]
    traction = [sum((at(a, b) * normal[b] for b in range(1, dims)), at(a, 0) * normal[0]) for a in range(dims)]
    along = sum((t * n for t, n in zip(traction[1:], normal[1:], strict=True)), traction[0] * normal[0])
    parts = [t - along * n for t, n in zip(traction, normal, strict=True)]
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
