"""Queries of the lattice functions: populations made from the grid in equilibrium plus a small shift."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import register
from gridloom.functions import lattice

from . import fixtures as fx

NAME = "D2Q9"
SETS = lattice.velocities(NAME)


def _populations(spark, d):
    """f[i] = weight * (n + i)."""
    parts = [(F.col("n") + float(i)) * lattice.weight(NAME, c) for i, c in enumerate(SETS)]
    return fx.grid(spark, d).select("x", "y", "z", "n", F.array(*parts).alias("f"))


F_SQL = [f"(n + {i}) * {lattice.weight(NAME, c)!r}::DOUBLE" for i, c in enumerate(SETS)]
RHO = " + ".join(F_SQL)
MOMENTS = ["(" + " + ".join(f"{c[a]} * ({F_SQL[i]})" for i, c in enumerate(SETS) if c[a]) + ")" for a in range(2)]


@register("p60_lattice_moments", f"WITH {fx.GRID_SQL} SELECT x, y, z, round({RHO}, 6) AS rho, round({MOMENTS[0]} / ({RHO}), 6) AS ux, round({MOMENTS[1]} / ({RHO}), 6) AS uy FROM grid")
def lattice_moments(spark, d):
    cells = lattice.with_equilibrium(_populations(spark, d), "f", NAME)
    return cells.select("x", "y", "z", F.round("rho", 6).alias("rho"), F.round(F.col("u")[0], 6).alias("ux"), F.round(F.col("u")[1], 6).alias("uy"))


@register("p60_lattice_equilibrium", f"WITH {fx.GRID_SQL} SELECT x, y, z, round(0.01::DOUBLE * n, 6) AS total, round(0.01::DOUBLE * n * 0.1::DOUBLE, 6) AS flux FROM grid")
def lattice_equilibrium(spark, d):
    """The equilibrium has the density and momentum that it was made from."""
    eq = lattice.equilibrium(F.col("n") * 0.01, [F.lit(0.1), F.lit(-0.05)], NAME)
    return fx.grid(spark, d).select("x", "y", "z", eq.alias("f")).select("x", "y", "z", F.round(lattice.density(F.col("f"), NAME), 6).alias("total"), F.round(lattice.momentum(F.col("f"), NAME)[0], 6).alias("flux"))


@register("p60_lattice_stress")
def lattice_stress(spark, d):
    f, eq = F.col("f"), F.col("eq")
    pi = lattice.stress(f, eq, NAME)
    cells = lattice.with_equilibrium(_populations(spark, d), "f", NAME)
    return cells.select("x", "y", "z", lattice.stress_norm2(pi).alias("norm2"), lattice.knudsen(f, eq, NAME).alias("knudsen"), lattice.wall_shear(pi, [1.0, 0.0]).alias("shear"))
