"""Queries of the cell-wise, region, reduction and scalar-function operators, with their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.catalog import register
from gridloom.operators import cellwise as cw
from gridloom.operators import combine, coordinates, reductions, region
from gridloom.operators.graph import bounding_box
from gridloom.session import new_folder

from . import fixtures as fx


Make = Callable[[], Column]


def _cells(name: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str], where: Make | None = None, where_sql: str = "") -> None:
    """Register a projection of the grid; Columns are made when the query runs, as they need a session."""

    def query(spark, sf_dir):
        g = fx.grid(spark, sf_dir)
        g = g if where is None else g.where(where())
        return g.select("x", "y", "z", *[c.alias(k) for k, c in columns().items()])

    parts = ", ".join(f"{e} AS {k}" for k, e in sql.items())
    register(name, f"WITH {fx.GRID_SQL} SELECT x, y, z{', ' if parts else ''}{parts} FROM grid {where_sql}")(query)


def _r(c: Column) -> Column:
    return F.round(c, 6)


def _one(name: str, column: Make, sql: str, digits: bool = True) -> None:
    _cells(name, lambda: {"out": _r(column()) if digits else column()}, {"out": f"round({sql}, 6)" if digits else sql})


# Cell-wise projections and predicates.
_one("p01_binarize", lambda: cw.binarize(F.col("v"), 100.0), "CASE WHEN v >= 100 THEN 1 ELSE 0 END", False)
_one("p02_threshold", lambda: cw.threshold(F.col("v"), 60.0, 0.0), "CASE WHEN v < 60 THEN 0.0::DOUBLE ELSE v END", False)
_one("p03_clamp", lambda: cw.clamp(F.col("v"), 50.0, 150.0), "greatest(50.0::DOUBLE, least(150.0::DOUBLE, v))", False)
_one("p05_image_threshold", lambda: cw.image_threshold(F.col("v"), 40.0, 200.0, -1.0, 999.0), "CASE WHEN v <= 40 THEN -1.0::DOUBLE WHEN v > 200 THEN 999.0::DOUBLE ELSE v END", False)
_one("p06_mask_color", lambda: cw.color_distance_mask([F.col("v") / 255, F.col("n") / 10.0], [100 / 255, 0.4], 0.2), "sqrt((v / 255 - 100.0::DOUBLE / 255) ** 2 + (n / 10.0::DOUBLE - 0.4::DOUBLE) ** 2) < 0.2", False)
KEYS = ((0.0, 0.0), (50.0, 10.0), (120.0, 40.0), (300.0, 100.0))
TF_SQL = "(CASE WHEN {v} <= 0 THEN 0.0::DOUBLE WHEN {v} <= 50 THEN {v} * 0.2::DOUBLE WHEN {v} <= 120 THEN 10 + ({v} - 50) * (30.0::DOUBLE / 70) WHEN {v} <= 300 THEN 40 + ({v} - 120) * (60.0::DOUBLE / 180) ELSE 100.0::DOUBLE END)"
_one("p08_value_map", lambda: cw.transfer(F.col("v"), KEYS), TF_SQL.format(v="v"))
_cells("p09_transfer_function", lambda: {"alpha": _r(cw.transfer(F.col("v"), KEYS) / 100), "red": _r(cw.transfer(F.col("v"), ((0.0, 0.0), (200.0, 1.0))))}, {"alpha": f"round({TF_SQL.format(v='v')} / 100, 6)", "red": "round(CASE WHEN v <= 0 THEN 0.0::DOUBLE WHEN v <= 200 THEN v * (1.0::DOUBLE / 200) ELSE 1.0::DOUBLE END, 6)"})
_one("p10_preintegrated", lambda: cw.preintegrated(F.col("v"), F.col("n") * 30.0, KEYS), f"({TF_SQL.format(v='v')} + {TF_SQL.format(v='(n * 30.0::DOUBLE)')}) / 2")
_one("p14_real_world_mapping", lambda: cw.real_world(F.col("v"), 0.5, -10.0), "v * 0.5::DOUBLE - 10")
_cells("p16_mirror", lambda: {"mx": cw.mirror(F.col("x"), 16), "v": F.col("v")}, {"mx": "CAST(15 - x AS INT)", "v": "v"})
_cells("p17_offset", lambda: {"wx": F.col("x") + 2.5, "wy": F.col("y") - 1.0, "wz": F.col("z") * 1.0}, {"wx": "x + 2.5::DOUBLE", "wy": "y - 1.0::DOUBLE", "wz": "z * 1.0::DOUBLE"})
_cells("p20_scale_center", lambda: {"sx": cw.scale_about(F.col("x"), 7.5, 2.0), "v": F.col("v")}, {"sx": "(x - 7.5::DOUBLE) * 2 + 7.5::DOUBLE", "v": "v"})
M4 = ((0.0, -1.0, 0.0, 3.0), (1.0, 0.0, 0.0, 1.0), (0.0, 0.0, 2.0, -1.0), (0.0, 0.0, 0.0, 1.0))
_cells("p21_affine", lambda: dict(zip(("tx", "ty", "tz"), cw.affine(M4, F.col("x"), F.col("y"), F.col("z")), strict=True)), {"tx": "x * 0.0::DOUBLE - y * 1.0::DOUBLE + 3", "ty": "x * 1.0::DOUBLE + 1", "tz": "z * 2.0::DOUBLE - 1"})
_cells("p24_sampling_transform", lambda: {"tx": F.when(F.col("n") > 3, cw.affine(M4, F.col("x"), F.col("y"), F.col("z"))[0]).otherwise(0.0)}, {"tx": "CASE WHEN n > 3 THEN 3.0::DOUBLE - y ELSE 0.0::DOUBLE END"})
_one("p25_fade", lambda: cw.mix(F.col("v"), F.lit(200.0), 0.25), "v * 0.75::DOUBLE + 200.0::DOUBLE * 0.25::DOUBLE")
_one("p26_grayscale", lambda: cw.grayscale(F.col("v"), F.col("n") * 1.0, F.col("x") * 1.0), "v * 0.299::DOUBLE + n * 0.587::DOUBLE + x * 0.114::DOUBLE")
_one("p27_scale_constant", lambda: F.col("v") * 3.0, "v * 3")
_cells("p28_square_cube", lambda: {"square": F.col("v") * F.col("v"), "cube": F.col("v") * F.col("v") * F.col("v")}, {"square": "v * v", "cube": "v * v * v"})
_one("p29_luminance_alpha", lambda: cw.luminance_alpha(F.col("v") - 100), "CASE WHEN v - 100 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", False)
_one("p30_linear_range", lambda: cw.linear_range(F.col("v"), (0.0, 400.0), (-1.0, 1.0)), "-1 + v * (2.0::DOUBLE / 400)")
_one("p31_box_inside", lambda: cw.box_inside((F.col("x"), F.col("y"), F.col("x") + 2, F.col("y") + 2), (F.lit(2), F.lit(2), F.lit(9), F.lit(9))), "x >= 2 AND y >= 2 AND x + 2 <= 9 AND y + 2 <= 9", False)
_one("p32_flag_priority", lambda: cw.flag_priority(F.col("n").cast("int"), ((1, "selected"), (2, "mouseover"), (8, "orphan"), (4, "path")), "ordinary"), "CASE WHEN n & 1 <> 0 THEN 'selected' WHEN n & 2 <> 0 THEN 'mouseover' WHEN n & 8 <> 0 THEN 'orphan' WHEN n & 4 <> 0 THEN 'path' ELSE 'ordinary' END", False)
_one("p43_discretize", lambda: cw.discretize(F.col("v"), 20.0, 180.0, 9), "CASE WHEN v <= 20 THEN 20.0::DOUBLE WHEN v >= 180 THEN 180.0::DOUBLE ELSE 20 + round_even((v - 20) / 20, 0) * 20 END", False)
_cells("p44_round", lambda: {m: cw.rounded(F.col("v") / 8, m) for m in ("none", "nearest", "floor", "ceil")}, {"none": "v / 8", "nearest": "round_even(v / 8, 0)", "floor": "floor(v / 8)", "ceil": "ceil(v / 8)"})
_cells("p46_constant", lambda: {"c0": F.lit(1.5), "c1": F.lit(-2.0)}, {"c0": "1.5::DOUBLE", "c1": "-2.0::DOUBLE"})
_one("p48_lift", lambda: F.sin(F.col("x") * 0.1 + 0.05) * (F.col("z") * 0.1 + 0.05), "sin(x * 0.1::DOUBLE + 0.05::DOUBLE) * (z * 0.1::DOUBLE + 0.05::DOUBLE)")
_cells("p49_indicator", lambda: {"inside": (F.col("v") > 100).cast("int"), "outside": (~(F.col("v") > 100)).cast("int")}, {"inside": "CAST(v > 100 AS INT)", "outside": "CAST(NOT v > 100 AS INT)"})
_one("p51_fringe", lambda: cw.fringe(F.col("x") / 15, 0.8, 0.3, 2.0), "2 * (CASE WHEN x / 15 / 0.8::DOUBLE <= 0 THEN 0 WHEN x / 15 / 0.8::DOUBLE >= 1 THEN 1 ELSE 1 / (1 + exp(1 / (x / 15 / 0.8::DOUBLE - 1) + 1 / (x / 15 / 0.8::DOUBLE))) END - CASE WHEN x / 15 / 0.3::DOUBLE <= 0 THEN 0 WHEN x / 15 / 0.3::DOUBLE >= 1 THEN 1 ELSE 1 / (1 + exp(1 / (x / 15 / 0.3::DOUBLE - 1) + 1 / (x / 15 / 0.3::DOUBLE))) END)")
_cells("p52_reaction_rates", lambda: {"constant": F.lit(1.0), "first": _r(F.col("v") / 4.0), "monod": _r(cw.monod(F.col("v"), F.col("n") * 1.0, 0.3, 50.0)), "haldane": _r(cw.haldane(F.col("v"), F.col("n") * 1.0, 0.3, 50.0, 80.0))}, {"constant": "1.0::DOUBLE", "first": "round(v / 4, 6)", "monod": "round(v * 0.3::DOUBLE / (v + 50) * n, 6)", "haldane": "round(v * 0.3::DOUBLE / (50 + v + v * v / 80) * n, 6)"})
_one("p53_pressure", lambda: cw.pressure(F.col("v"), 3.0, 2.0), "(v - 1) / 3 * 2")
_one("p54_kinetic_energy", lambda: cw.kinetic_energy(F.col("v"), F.col("n") * 1.0, F.col("x") * 1.0), "(v * v + n * n + x * x) * 0.5::DOUBLE")
_one("p55_dissipation", lambda: cw.dissipation(F.col("v") * F.col("v"), 0.125, 1.25, 3.0, F.col("n") + 1.0), "v * v * 0.125::DOUBLE * (1.25::DOUBLE * 3) ** 2 / (n + 1) / 2")
_one("p56_strain_rate", lambda: cw.strain_rate(F.col("v"), 1.2, 3.0, F.col("n") + 1.0, 0.5), "-v * 1.2::DOUBLE * 3 / (n + 1) / 2 / 0.5::DOUBLE")
_one("p57_viscosity", lambda: F.nanvl(cw.viscosity(F.col("n") % 3 / 2, 3.0, 0.1, 0.01), F.lit(-1.0)), "CASE WHEN n % 3 = 0 THEN -1 ELSE (1 / (n % 3 / 2) - 0.5::DOUBLE) / 3 * (0.1::DOUBLE * 0.1::DOUBLE) / 0.01::DOUBLE END")
_one("p58_permeability", lambda: cw.permeability(F.when(F.col("n") == 3, F.lit(math.nan)).otherwise(F.col("v") / 200)), "CASE WHEN n = 3 OR v / 200 > 1 THEN 1 ELSE v / 200 END")
_cells("p59_partition_ids", lambda: {"brick": (F.floor(F.col("x") / 8) + F.floor(F.col("y") / 8) * 2 + 1).cast("int")}, {"brick": "CAST(x // 8 + (y // 8) * 2 + 1 AS INT)"})
_one("n33_gabor", lambda: cw.gabor(F.col("x") - 8.0, F.col("y") - 8.0, 0.3, 5.0, 0.1, 3.0, 0.7), "(exp(-((((x - 8) * cos(0.3::DOUBLE) + (y - 8) * sin(0.3::DOUBLE)) ** 2) + ((-(x - 8) * sin(0.3::DOUBLE) + (y - 8) * cos(0.3::DOUBLE)) ** 2) * 0.7::DOUBLE ** 2) / 18) * cos(((x - 8) * cos(0.3::DOUBLE) + (y - 8) * sin(0.3::DOUBLE)) * (2 * 3.141::DOUBLE / 5) + 0.1::DOUBLE) + 1) / 2")


def _whole(name: str, sql: str):
    """Register a query over the grid that is more than a projection."""

    def wrap(make):
        register(name, f"WITH {fx.GRID_SQL} {sql}")(lambda spark, d: make(fx.grid(spark, d)))
        return make

    return wrap


_whole("p07_rescale", "SELECT x, y, z, round((v - (SELECT min(v) FROM grid)) / ((SELECT max(v) FROM grid) - (SELECT min(v) FROM grid)), 6) AS rescaled FROM grid")(lambda g: cw.rescale(g, "v").select("x", "y", "z", _r(F.col("rescaled")).alias("rescaled")))
_whole("p11_inversion", "SELECT x, y, z, (SELECT max(v) + min(v) FROM grid) - v AS inverted FROM grid")(lambda g: cw.invert(g, "v").select("x", "y", "z", "inverted"))
_whole("p18_cubify", "SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z, coalesce(v, 0) AS v FROM range(16) a(i), range(16) b(i), range(16) c(i) LEFT JOIN grid ON x = a.i AND y = b.i AND z = c.i")(lambda g: combine.densify(g, (16, 16, 16), "v"))
_whole("p19_resample", "SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z, v FROM range(8) a(i), range(8) b(i), range(7) c(i), grid WHERE x = a.i * 2 AND y = b.i * 2 AND z = c.i")(lambda g: combine.resample(g, "v", (2.0, 2.0, 1.0), (8, 8, 7)))

def _vector() -> list[Column]:
    return [F.col("u0"), F.col("u1"), F.col("u2")]


@register("p12_vector_magnitude", f"WITH {fx.VEC_SQL} SELECT x, y, z, round(sqrt(u0 * u0 + u1 * u1 + u2 * u2), 6) AS magnitude, abs(u1) AS single FROM vec")
def vector_magnitude(spark, d):
    return fx.vecfield(spark, d).select("x", "y", "z", _r(cw.magnitude(*_vector())).alias("magnitude"), cw.magnitude(F.col("u1")).alias("single"))


@register("p13_spherical", f"WITH {fx.VEC_SQL} SELECT x, y, z, round(sqrt(u0 * u0 + u1 * u1 + u2 * u2), 6) AS radius, round(atan2(u1, u0), 6) AS phi, round(acos(u2 / sqrt(u0 * u0 + u1 * u1 + u2 * u2)), 6) AS theta FROM vec")
def spherical(spark, d):
    return fx.vecfield(spark, d).select("x", "y", "z", *[_r(c).alias(n) for c, n in zip(cw.spherical(*_vector()), ("radius", "phi", "theta"), strict=True)])


@register("p47_embedding_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE)))), 4) AS norm FROM embeddings")
def embedding_norm(spark, d):
    v = fx.table(spark, d, "embeddings")
    return v.select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))), 4).alias("norm"))


# Scalar functions of one and two fields.
ONE = {
    "f01_abs": (lambda: F.abs(F.col("v") - 100), "abs(v - 100)"),
    "f02_acos": (lambda: F.acos(F.col("v") / 1000), "acos(v / 1000)"),
    "f03_asin": (lambda: F.asin(F.col("v") / 1000), "asin(v / 1000)"),
    "f04_atan": (lambda: F.atan(F.col("v")), "atan(v)"),
    "f05_atan2": (lambda: F.atan2(F.col("v"), F.col("n") * 1.0), "atan2(v, n)"),
    "f06_cos": (lambda: F.cos(F.col("v")), "cos(v)"),
    "f07_sin": (lambda: F.sin(F.col("v")), "sin(v)"),
    "f08_tan": (lambda: F.tan(F.col("v") / 1000), "tan(v / 1000)"),
    "f09_exp": (lambda: F.exp(F.col("v") / 100), "exp(v / 100)"),
    "f10_exp_negative": (lambda: F.exp(-F.col("v") / 100), "exp(-v / 100)"),
    "f11_log": (lambda: F.ln(F.col("v")), "ln(v)"),
    "f12_log10": (lambda: F.log10(F.col("v")), "log10(v)"),
    "f13_sqrt": (lambda: F.sqrt(F.col("v")), "sqrt(v)"),
    "f14_square": (lambda: F.col("v") * F.col("v"), "v * v"),
    "f15_add": (lambda: F.col("v") + F.col("n"), "v + n"),
    "f16_subtract": (lambda: F.col("v") - F.col("n"), "v - n"),
    "f17_multiply": (lambda: F.col("v") * F.col("n"), "v * n"),
    "f18_divide": (lambda: F.try_divide(F.col("v"), F.col("n") - 3), "v / nullif(n - 3, 0)"),
    "f19_maximum": (lambda: F.greatest(F.col("v"), F.col("n") * 30.0), "greatest(v, n * 30.0::DOUBLE)"),
    "f20_minimum": (lambda: F.least(F.col("v"), F.col("n") * 30.0), "least(v, n * 30.0::DOUBLE)"),
    "f21_binary_magnitude": (lambda: F.hypot(F.col("v"), F.col("n")), "sqrt(v * v + n * n)"),
    "f26_positive_fmod": (lambda: F.pmod(F.col("v") - 100, F.lit(7.0)), "((v - 100) % 7 + 7) % 7"),
    "f27_power": (lambda: F.pow(F.col("v"), F.lit(1.5)), "v ** 1.5::DOUBLE"),
}
for _name, (_column, _sql) in ONE.items():
    _one(_name, _column, _sql)
_cells("f22_25_bitwise", lambda: {"a": F.col("n").bitwiseAND(F.col("x").cast("long")), "o": F.col("n").bitwiseOR(F.col("x").cast("long")), "e": F.col("n").bitwiseXOR(F.col("x").cast("long")), "i": F.bitwise_not(F.col("n"))}, {"a": "n & x", "o": "n | x", "e": "xor(n, CAST(x AS BIGINT))", "i": "~n"})
_cells("f28_extremes", lambda: {"most": F.array_max(F.array(F.col("x"), F.col("y"), F.col("z"))), "least": F.array_min(F.array(F.col("x"), F.col("y"), F.col("z")))}, {"most": "greatest(x, y, z)", "least": "least(x, y, z)"})
_cells("f33_36_text", lambda: {"padded": F.lpad(F.col("x").cast("string"), 4, "0"), "path": F.regexp_replace(F.concat(F.lit("vol"), F.col("x").cast("string"), F.lit(".vti")), r"\.[^.]*$", ".h5"), "encoded": F.base64(F.concat(F.lit("c"), F.col("y").cast("string")).cast("binary")), "info": F.format_string("(%d, %d)", F.col("x"), F.col("y"))}, {"padded": "lpad(CAST(x AS VARCHAR), 4, '0')", "path": "'vol' || x || '.h5'", "encoded": "base64(encode('c' || y))", "info": "'(' || x || ', ' || y || ')'"})

# Regions.
BALL, BLOCK, ROD = region.sphere((8.0, 8.0, 3.0), 5.0), region.cube((8.0, 8.0, 3.0), (2.0, 2.0, 2.0)), region.cylinder((4.0, 4.0, 3.0), 3.0, 2.0)
BALL_SQL, BLOCK_SQL, ROD_SQL = "((x - 8) ** 2 + (y - 8) ** 2 + (z - 3) ** 2 <= 25)", "(abs(x - 8) <= 2 AND abs(y - 8) <= 2 AND abs(z - 3) <= 2)", "((x - 4) ** 2 + (y - 4) ** 2 <= 9 AND abs(z - 3) <= 2)"
for _name, _region, _sql in (
    ("u01_region_union", BALL | ROD, f"{BALL_SQL} OR {ROD_SQL}"),
    ("u02_region_subtract", BALL - BLOCK, f"{BALL_SQL} AND NOT {BLOCK_SQL}"),
    ("u04_primitives", BLOCK, BLOCK_SQL),
    ("u06_region_intersection", BALL & ROD, f"{BALL_SQL} AND {ROD_SQL}"),
    ("u14_complement_elongated", ~region.elongated(BALL, 2.0), "NOT ((x - 8) ** 2 + (y - 8) ** 2 + (z / 2 - 3) ** 2 <= 25)"),
    ("p40_clip_plane", region.clip_plane(9.0, 0.5, 0.2), "x * (cos(0.2::DOUBLE) * cos(0.5::DOUBLE)) + y * (cos(0.2::DOUBLE) * sin(0.5::DOUBLE)) + z * sin(0.2::DOUBLE) <= 9"),
):
    _cells(_name, lambda: {"v": F.col("v")}, {"v": "v"}, lambda r=_region: r.contains(F.col("x"), F.col("y"), F.col("z")), f"WHERE {_sql}")


@register("u03_bounding_box", f"WITH {fx.GRID_SQL} SELECT min(x) AS lo_x, min(y) AS lo_y, min(z) AS lo_z, max(x) AS hi_x, max(y) AS hi_y, max(z) AS hi_z FROM grid WHERE {BALL_SQL} OR {ROD_SQL}")
def region_box(spark, d):
    return bounding_box(fx.grid(spark, d).where((BALL | ROD).contains(F.col("x"), F.col("y"), F.col("z"))))


@register("m0_flagship", f"WITH {fx.GRID_SQL}, b AS (SELECT CASE WHEN v <= 20 THEN 20.0::DOUBLE WHEN v >= 180 THEN 180.0::DOUBLE ELSE 20 + round_even((v - 20) / 20, 0) * 20 END AS bucket, v FROM grid WHERE {BALL_SQL} AND NOT {BLOCK_SQL}) SELECT bucket, count(*) AS cells, sum(v) AS total, min(v) AS low, max(v) AS high FROM b GROUP BY bucket")
def flagship(spark, d):
    """Region algebra, discretisation and grouped reductions in one plan."""
    cells = fx.grid(spark, d).where((BALL - BLOCK).contains(F.col("x"), F.col("y"), F.col("z"))).withColumn("bucket", cw.discretize(F.col("v"), 20.0, 180.0, 9))
    return cells.groupBy("bucket").agg(F.count("*").alias("cells"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))


# Reductions.
_whole("a01_04_sums", f"SELECT z, sum(v) AS total, count(*) AS cells, round(avg(v), 6) AS average, min(v) AS low, max(v) AS high FROM grid WHERE {BALL_SQL} GROUP BY z")(lambda g: reductions.sums(g, "v", BALL.contains(F.col("x"), F.col("y"), F.col("z")), ["z"]).withColumn("average", _r(F.col("average"))))
_whole("a05_integral", f"SELECT round(sum(v) * 0.001::DOUBLE, 6) AS integral FROM grid WHERE {BALL_SQL}")(lambda g: reductions.integral(g, "v", 0.1, 3, BALL.contains(F.col("x"), F.col("y"), F.col("z"))).withColumn("integral", _r(F.col("integral"))))
for _p, _sql in ((1, "sum(abs(v) + abs(n)) * 0.001::DOUBLE"), (2, "sqrt(sum(v * v + n * n) * 0.001::DOUBLE)"), (0, "max(greatest(abs(v), abs(n)))")):
    _whole(f"a06_07_lp_norm_{_p}", f"SELECT round({_sql}, 6) AS norm FROM grid")(lambda g, p=_p: reductions.lp_norm(g, [F.col("v"), F.col("n").cast("double")], p, 0.1).withColumn("norm", _r(F.col("norm"))))
_whole("a08_09_deviation", "SELECT z, round(var_pop(v), 6) AS variance, round(stddev_pop(v), 6) AS deviation FROM grid GROUP BY z")(lambda g: reductions.deviation(g, "v", None, ["z"]).select("z", _r(F.col("variance")).alias("variance"), _r(F.col("deviation")).alias("deviation")))
_whole("a12_lattice_statistics", "SELECT round(avg(n), 6) AS rho, round(avg(0.5::DOUBLE * v * v), 4) AS energy, max(v) AS max_u, count(*) AS cells FROM grid")(lambda g: g.agg(_r(F.avg("n")).alias("rho"), F.round(F.avg(cw.kinetic_energy(F.col("v"))), 4).alias("energy"), F.max("v").alias("max_u"), F.count("*").alias("cells")))
_whole("a15_histogram", "SELECT CAST(least(floor((v - 0) * (20 / 400.0::DOUBLE)), 19) AS INT) AS bin, count(*) AS n FROM grid WHERE v BETWEEN 0 AND 400 GROUP BY 1")(lambda g: reductions.histogram(g, "v", 0.0, 400.0, 20))
_whole("a16_min_max", "SELECT min(v) AS low, max(v) AS high FROM grid")(lambda g: g.agg(F.min("v").alias("low"), F.max("v").alias("high")))
_whole("a17_segment_info", "SELECT n, count(*) AS cells, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, min(x) AS lo_x, min(y) AS lo_y, min(z) AS lo_z, max(x) AS hi_x, max(y) AS hi_y, max(z) AS hi_z, round(count(*) / (SELECT count(*) FROM grid), 6) AS share FROM grid GROUP BY n")(lambda g: reductions.segments(g, "n").withColumns({c: _r(F.col(c)) for c in ("cx", "cy", "cz", "share")}))
_whole("a18_volume_center", "SELECT round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM grid WHERE v > 100")(lambda g: g.where(F.col("v") > 100).agg(*[_r(F.avg(c)).alias(f"c{c}") for c in "xyz"]))
_whole("a19_bounding_box", "SELECT min(x) AS lo_x, min(y) AS lo_y, min(z) AS lo_z, max(x) AS hi_x, max(y) AS hi_y, max(z) AS hi_z FROM grid WHERE v > 200")(lambda g: bounding_box(g.where(F.col("v") > 200)))
_whole("a20_slice_density", "SELECT z, round(avg(CAST(v > 100 AS INT)), 6) AS density FROM grid GROUP BY z")(lambda g: g.groupBy("z").agg(_r(F.avg((F.col("v") > 100).cast("int"))).alias("density")))
_whole("a21_point_statistics", "SELECT z, count(*) AS points, round(avg(v), 6) AS average, min(v) AS low, max(v) AS high FROM grid GROUP BY ROLLUP (z)")(lambda g: reductions.point_statistics(g, "z", "v").withColumn("average", _r(F.col("average"))))
VOLUME_HASH_SQL = "SELECT md5(string_agg(h, ',' ORDER BY z)) AS hash FROM (SELECT floor(z / 1024) AS z, md5(string_agg(h, ',' ORDER BY z)) AS h FROM (SELECT z, md5(string_agg(h, ',' ORDER BY y)) AS h FROM (SELECT z, floor(y / 1024) AS y, md5(string_agg(h, ',' ORDER BY y)) AS h FROM (SELECT z, y, md5(string_agg(h, ',' ORDER BY x)) AS h FROM (SELECT z, y, floor(x / 1024) AS x, md5(string_agg(x || ':' || y || ':' || z || ':' || CAST(v * 8 AS BIGINT), ',' ORDER BY x)) AS h FROM grid GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)"
for _name in ("a23_volume_hash", "a23_volume_hash_whole"):
    _whole(_name, VOLUME_HASH_SQL)(lambda g: reductions.volume_hash(g, F.concat_ws(":", "x", "y", "z", (F.col("v") * 8).cast("long"))))
_whole("a25_mean_plot", "SELECT x, round(avg(v), 6) AS mean FROM grid GROUP BY x")(lambda g: g.groupBy("x").agg(_r(F.avg("v")).alias("mean")))
_whole("a26_field_plot", "SELECT x, CAST(floor(v / 20) AS INT) AS bin, count(*) AS intensity FROM grid WHERE n > 2 GROUP BY 1, 2")(lambda g: g.where(F.col("n") > 2).groupBy("x", F.floor(F.col("v") / 20).cast("int").alias("bin")).agg(F.count("*").alias("intensity")))
_whole("a27_line_density", "SELECT x, y, count(*) AS density FROM grid WHERE v > 120 GROUP BY x, y")(lambda g: g.where(F.col("v") > 120).groupBy("x", "y").agg(F.count("*").alias("density")))


@register("a13_exact_sum", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(28, 6))) AS DOUBLE) AS total FROM lineitem")
def exact_sum(spark, d):
    return reductions.exact_sum(fx.table(spark, d, "lineitem"), "l_extendedprice")


@register("a10_11_error_norms", f"WITH {fx.GRID_SQL}, {fx.GRID2_SQL} SELECT round(sqrt(sum((g.v - h.v) ** 2)), 6) AS absolute, round(sqrt(sum((g.v - h.v) ** 2)) / sqrt(sum(g.v ** 2)), 6) AS relative FROM grid g JOIN grid2 h USING (x, y, z)")
def error_norms(spark, d):
    both = combine.align(fx.grid(spark, d), fx.grid2(spark, d))
    return reductions.error_norms(both, "a", "b", 2).select(_r(F.col("absolute")).alias("absolute"), _r(F.col("relative")).alias("relative"))


@register("a24_uncertain_field", f"WITH {fx.ENSEMBLE_SQL} SELECT time, field, count(DISTINCT member) AS members, round(avg(CAST(value > 150000 AS INT)), 6) AS probability, avg(CAST(value > 150000 AS INT)) >= 0.45 AS likely FROM ensemble GROUP BY time, field")
def uncertain_field(spark, d):
    return reductions.exceedance(fx.ensemble(spark, d), ["time", "field"], "member", "value", 150000.0, 0.45).withColumn("probability", _r(F.col("probability")))


_cells("p50_indicator_inverse", lambda: {"outside": ~(F.col("v") > 100)}, {"outside": "NOT (v > 100)"})
_cells("p22_point_transform", lambda: {"tx": F.when(F.col("n") > 0, cw.affine(M4, F.col("x"), F.col("y"), F.col("z"))[1])}, {"tx": "x * 1.0::DOUBLE + 1"})
TURN = ((1.0, -1.0, 0.0, 0.0), (1.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.5), (0.0, 0.0, 0.0, 1.0))
for _name, _corners, _lo, _hi in (
    ("p23_bounds_transform", 8, ("x - y - 1.0::DOUBLE", "x + y * 1.0::DOUBLE", "z + 0.5::DOUBLE"), ("x - y + 2.0::DOUBLE", "x + y + 3.0::DOUBLE", "z + 3.5::DOUBLE")),
    ("p23_bounds_two_corners", 2, ("x - y * 1.0::DOUBLE", "x + y * 1.0::DOUBLE", "z + 0.5::DOUBLE"), ("x - y + 1.0::DOUBLE", "x + y + 3.0::DOUBLE", "z + 3.5::DOUBLE")),
):

    def _bounds(corners=_corners):
        low, high = coordinates.transform_bounds([F.col(a) for a in "xyz"], [F.col("x") + 2, F.col("y") + 1, F.col("z") + 3], TURN, corners)
        return {f"lo_{a}": c for a, c in zip("xyz", low, strict=True)} | {f"hi_{a}": c for a, c in zip("xyz", high, strict=True)}

    _cells(_name, _bounds, {f"lo_{a}": e for a, e in zip("xyz", _lo, strict=True)} | {f"hi_{a}": e for a, e in zip("xyz", _hi, strict=True)})


@register("p13_spherical_inverse", f"WITH {fx.VEC_SQL} SELECT x, y, z, u0, u1, u2 FROM vec")
def spherical_inverse(spark, sf_dir):
    """To spherical coordinates and back."""
    back = coordinates.from_spherical(*cw.spherical(F.col("u0"), F.col("u1"), F.col("u2")))
    return fx.vecfield(spark, sf_dir).select("x", "y", "z", *[F.round(c, 6).alias(f"u{i}") for i, c in enumerate(back)])


@register("p40_spherical_shell", f"WITH {fx.GRID_SQL} SELECT x, y, z, sqrt(x * x + y * y + z * z) AS radius FROM grid WHERE sqrt(x * x + y * y + z * z) BETWEEN 5 AND 9")
def spherical_shell(spark, sf_dir):
    return coordinates.shell(fx.grid(spark, sf_dir), 5.0, 9.0).select("x", "y", "z", "radius")


@register("a26_distance_profile", f"WITH {fx.GRID_SQL} SELECT CAST(floor(sqrt(x * x + y * y + z * z) / 1.5::DOUBLE) AS INT) AS ring, count(*) AS n, round(avg(v), 6) AS mean FROM grid GROUP BY 1")
def distance_profile(spark, sf_dir):
    return coordinates.radial_profile(fx.grid(spark, sf_dir), "v", 1.5).select("ring", "n", F.round("mean", 6).alias("mean"))


@register("p21_star_coordinates", f"WITH {fx.VEC_SQL} SELECT x, y, z, round(u0 - 0.5::DOUBLE * u1 - 0.5::DOUBLE * u2, 6) AS sx, round(sqrt(0.75::DOUBLE) * (u1 - u2), 6) AS sy FROM vec")
def star_coordinates(spark, sf_dir):
    sx, sy = coordinates.star_coordinates([F.col("u0"), F.col("u1"), F.col("u2")])
    return fx.vecfield(spark, sf_dir).select("x", "y", "z", F.round(sx, 6).alias("sx"), F.round(sy, 6).alias("sy"))


@register("g15_disk_seeds", "SELECT 8 * r + s AS seed, round((r + 1) * 1.25::DOUBLE * cos(s * pi() / 4) + 3, 6) AS x, round((r + 1) * 1.25::DOUBLE * sin(s * pi() / 4), 6) AS y FROM range(4) a(r), range(8) b(s)")
def disk_seeds(spark, sf_dir):
    seeds = coordinates.disk_seeds(spark, 4, 8, 5.0, (3.0, 0.0, 0.0))
    return seeds.select("seed", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("u05_region_collection", f"WITH {fx.GRID_SQL} SELECT x, y, z FROM grid WHERE {BALL_SQL} AND NOT {BLOCK_SQL}")
def region_collection(spark, sf_dir):
    """Regions stored as records and built again."""
    path = f"{new_folder(spark, 'regions')}/all.json"
    ball, block = ({"kind": "sphere", "center": [8.0, 8.0, 3.0], "radius": 5.0}, {"kind": "cube", "center": [8.0, 8.0, 3.0], "half": [2.0, 2.0, 2.0]})
    region.save_collection([{"kind": "subtract", "children": [ball, block]}], path)
    (stored,) = region.load_collection(path)
    return fx.grid(spark, sf_dir).where(stored.contains(F.col("x"), F.col("y"), F.col("z"))).select("x", "y", "z")
