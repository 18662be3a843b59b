"""Queries of the combination, plot-table, list, ensemble and window operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.catalog import register
from gridloom.operators import assignment, combine, fits, particles, tables, unwrapping
from gridloom.operators import cellwise as cw

from . import fixtures as fx

BOTH = f"{fx.GRID_SQL}, {fx.GRID2_SQL}, both_fields AS (SELECT g.x, g.y, g.z, g.v AS a, h.v AS b, g.n FROM grid g JOIN grid2 h USING (x, y, z))"


def _both(spark, d):
    return combine.align(fx.grid(spark, d), fx.grid2(spark, d))


def _pair(name: str, sql: dict[str, str], columns) -> None:
    register(name, f"WITH {BOTH} SELECT x, y, z, " + ", ".join(f"{e} AS {k}" for k, e in sql.items()) + " FROM both_fields")(lambda spark, d: _both(spark, d).select("x", "y", "z", *[c.alias(k) for k, c in columns().items()]))


_pair("j01_grid_binary", {"plus": "a + b", "minus": "a - b", "most": "greatest(a, b)"}, lambda: {"plus": F.col("a") + F.col("b"), "minus": F.col("a") - F.col("b"), "most": F.greatest(F.col("a"), F.col("b"))})
_pair("j02_image_mix", {"color": "0.5::DOUBLE * a + 0.5::DOUBLE * b", "depth": "least(a, b)"}, lambda: {"color": F.col("a") * 0.5 + F.col("b") * 0.5, "depth": F.least(F.col("a"), F.col("b"))})
_pair("j03_blend", {"over": "round(a * 0.25::DOUBLE + b * 0.75::DOUBLE, 6)", "added": "least(1.0::DOUBLE, a / 200 + b / 200 * 0.5::DOUBLE)"}, lambda: {"over": F.round(cw.source_over(F.col("a"), F.lit(0.25), F.col("b")), 6), "added": cw.add_blend(F.col("a") / 200, F.lit(0.5), F.col("b") / 200)})
_pair("j05_front_compositing", {"color": "round(a / 400 + (1 - 0.25::DOUBLE) * (b / 200) * (a / 200), 6)", "alpha": "0.25::DOUBLE + 0.75::DOUBLE * (b / 200)"}, lambda: dict(zip(("color", "alpha"), (lambda c: (F.round(c[0], 6), c[3]))(cw.front_to_back([F.col("a") / 400, F.col("a") / 400, F.col("a") / 400, F.lit(0.25)], [F.col("a") / 200, F.col("a") / 200, F.col("a") / 200, F.col("b") / 200])), strict=True)))
_pair("j06_checkerboard", {"v": "CASE WHEN (x // 4 + y // 4 + z // 4) % 2 = 0 THEN a ELSE b END"}, lambda: {"v": combine.checkerboard(F.col("a"), F.col("b"), 4, F.col("x"), F.col("y"), F.col("z"))})
_pair("j07_label_overlay", {"v": "round(CASE WHEN x % 3 = 0 THEN a ELSE a * 0.6::DOUBLE + (x % 3) * 50.0::DOUBLE * 0.4::DOUBLE END, 6)"}, lambda: {"v": F.round(combine.label_overlay(F.col("a"), F.col("x") % 3, 0.4, 50.0), 6)})
_pair("u07_boolean_minus", {"only_a": "a > 100 AND NOT b > 25"}, lambda: {"only_a": (F.col("a") > 100) & ~(F.col("b") > 25)})
_pair("p45_functor_arithmetic", {"sum": "a + b", "ratio": "round(b / a, 6)", "power": "round((a / 100) ** (b / 100), 6)"}, lambda: {"sum": F.col("a") + F.col("b"), "ratio": F.round(F.try_divide(F.col("b"), F.col("a")), 6), "power": F.round(F.pow(F.col("a") / 100, F.col("b") / 100), 6)})


@register("j04_overlay", f"WITH {BOTH} SELECT coalesce(t.x, u.x) AS x, coalesce(t.y, u.y) AS y, coalesce(t.z, u.z) AS z, CASE WHEN t.a > 0 THEN t.a ELSE u.b END AS v FROM (SELECT * FROM both_fields WHERE a > 110) t FULL OUTER JOIN (SELECT * FROM both_fields WHERE b > 25) u ON t.x = u.x AND t.y = u.y AND t.z = u.z")
def overlay(spark, d):
    top, under = fx.grid(spark, d).where("v > 110"), fx.grid2(spark, d).where("v > 25")
    return combine.align(top, under, how="full_outer").select("x", "y", "z", F.when(F.col("a") > 0, F.col("a")).otherwise(F.col("b")).alias("v"))


@register("j09_volume_comparison", f"WITH {BOTH} SELECT count(*) AS cells, CAST(sum(CAST(a = b AS INT)) AS BIGINT) AS equal, sum(abs(a - b)) AS l1, max(abs(a - b)) AS worst, round(corr(a, b), 6) AS correlation FROM both_fields")
def volume_comparison(spark, d):
    e = F.abs(F.col("a") - F.col("b"))
    return _both(spark, d).agg(F.count("*").alias("cells"), F.sum((F.col("a") == F.col("b")).cast("int")).alias("equal"), F.sum(e).alias("l1"), F.max(e).alias("worst"), F.round(F.corr("a", "b"), 6).alias("correlation"))


@register("j10_temporal_interpolation", f"WITH {fx.GRID_SQL} SELECT a.x, a.y, a.v * 0.75::DOUBLE + b.v * 0.25::DOUBLE AS v FROM grid a JOIN grid b ON a.x = b.x AND a.y = b.y AND a.z = 2 AND b.z = 3")
def temporal_interpolation(spark, d):
    return combine.interpolate_time(fx.grid(spark, d), "z", 2.25, ["x", "y"], "v")


for _name in ("j12_plot_merge", "j12_plot_merge_whole"):

    @register(_name, "SELECT coalesce(a.k, b.k) AS k, a.n, b.n AS n_2 FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL OUTER JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) b ON a.k = b.k")
    def plot_merge(spark, d):
        left = fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
        right = fx.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"))
        return tables.merge(left, right, "k")


@register("j13_points_to_grid", "SELECT CAST(floor(l_quantity / 5) AS INT) AS x, CAST(floor(l_discount * 100 / 2) AS INT) AS y, count(*) AS particles, sum(l_quantity) AS mass FROM lineitem GROUP BY 1, 2")
def points_to_grid(spark, d):
    key = [F.floor(F.col("l_quantity") / 5).cast("int").alias("x"), F.floor(F.col("l_discount") * 100 / 2).cast("int").alias("y")]
    return fx.table(spark, d, "lineitem").groupBy(*key).agg(F.count("*").alias("particles"), F.sum("l_quantity").alias("mass"))


PARTICLES_SQL = "particles AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity / 5 AS x, l_discount * 50 AS y, CAST(l_linenumber AS DOUBLE) AS z, CASE l_linenumber % 3 WHEN 0 THEN 0.1::DOUBLE WHEN 1 THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS h, mass FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount, sum(l_extendedprice) AS mass FROM lineitem GROUP BY 1, 2)), near AS (SELECT id, mass, CAST(floor(x) + i.n AS INT) AS cx, CAST(floor(y) + j.n AS INT) AS cy, CAST(floor(z) + k.n AS INT) AS cz, sqrt((x - floor(x) - i.n) ** 2 + (y - floor(y) - j.n) ** 2 + (z - floor(z) - k.n) ** 2) / h AS q, x, y, z FROM particles, range(-2, 4) i(n), range(-2, 4) j(n), range(-2, 4) k(n)), kernel AS (SELECT id, mass, cx, cy, cz, CASE WHEN q <= 1 THEN 1 - 1.5::DOUBLE * q * q + 0.75::DOUBLE * q * q * q WHEN q < 2 THEN 0.25::DOUBLE * (2 - q) ** 3 ELSE 0 END AS w, cx = floor(x + 0.5::DOUBLE) AND cy = floor(y + 0.5::DOUBLE) AND cz = floor(z + 0.5::DOUBLE) AS nearest FROM near WHERE q < 2 OR (cx = floor(x + 0.5::DOUBLE) AND cy = floor(y + 0.5::DOUBLE) AND cz = floor(z + 0.5::DOUBLE))), spread AS (SELECT id, mass, cx AS x, cy AS y, cz AS z, CASE WHEN sum(w) OVER p > 0 THEN w / sum(w) OVER p WHEN nearest THEN 1 ELSE 0 END AS w FROM kernel WINDOW p AS (PARTITION BY id))"


def _particles(spark, d):
    """Line items as particles, some of so small a radius that they reach no cell."""
    rows = fx.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_discount").alias("l_discount"), F.sum("l_extendedprice").alias("mass"))
    n = F.col("l_linenumber")
    return rows.select((F.col("l_orderkey") * 8 + n).alias("id"), (F.col("l_quantity") / 5).alias("x"), (F.col("l_discount") * 50).alias("y"), n.cast("double").alias("z"), F.when(n % 3 == 0, 0.1).when(n % 3 == 1, 0.6).otherwise(0.9).alias("h"), "mass")


@register("j13_kernel_to_cells", f"WITH {PARTICLES_SQL} SELECT x, y, z, count(*) AS particles, round(sum(mass * w), 2) AS mass FROM spread WHERE w > 0 GROUP BY x, y, z")
def kernel_to_cells(spark, d):
    return particles.to_cells(_particles(spark, d), ["mass"], "h").withColumn("mass", F.round("mass", 2))


@register("j13_kernel_from_cells", f"WITH {fx.GRID_SQL}, {PARTICLES_SQL} SELECT id, round(sum(v * w) / sum(w), 5) AS v FROM spread JOIN grid USING (x, y, z) WHERE w > 0 GROUP BY id")
def kernel_from_cells(spark, d):
    return particles.from_cells(_particles(spark, d), fx.grid(spark, d), ["v"], "id", "h").withColumn("v", F.round("v", 5))


@register("j15_overlap_tracking", f"WITH {fx.GRID_SQL}, o AS (SELECT CAST(floor(v / 10) AS INT) AS lab, x, y, z FROM grid), p AS (SELECT a.lab AS from_label, b.lab AS to_label, count(*) AS shared FROM o a JOIN o b ON a.x = b.x AND a.y = b.y AND a.z = 2 AND b.z = 3 GROUP BY 1, 2), s AS (SELECT lab, count(*) AS size FROM o WHERE z = 2 GROUP BY 1) SELECT from_label, to_label, shared, round(shared / size, 6) AS fraction FROM p JOIN s ON lab = from_label WHERE shared / size >= 0.2")
def overlap_tracking(spark, d):
    g = fx.grid(spark, d).withColumn("lab", F.floor(F.col("v") / 10).cast("int"))
    step = lambda k: g.where(F.col("z") == k).withColumn("z", F.lit(0))
    return combine.overlap(step(2), step(3), "lab", 0.2).select("from_label", "to_label", "shared", F.round("fraction", 6).alias("fraction"))


@register("j16_assignment")
def optimal_assignment(spark, d):
    pairs = fx.grid(spark, d).select("z", "x", "y", F.col("v").alias("cost"))
    return assignment.assign(pairs, "z", "x", "y", "cost")


@register("p42_phase_unwrapping")
def phase_unwrapping(spark, d):
    g = fx.grid(spark, d).select("x", "y", "z", F.pmod(F.col("v") / 20, F.lit(6.283185307179586)).alias("phase"), F.lit(1).alias("valid"))
    return unwrapping.unwrap(g, "phase", "valid")


@register("p33_prefix_filter", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'STANDARD%' AND p_size IN (1, 2, 3, 5, 8)")
def prefix_filter(spark, d):
    return fx.table(spark, d, "part").where(F.col("p_type").startswith("STANDARD") & F.col("p_size").isin(1, 2, 3, 5, 8)).select("p_partkey", "p_type")


@register("p34_35_select_index", f"WITH {fx.GRID_SQL} SELECT x, y, v FROM grid WHERE z = 4")
def select_index(spark, d):
    return fx.grid(spark, d).where("z = 4").select("x", "y", "v")


@register("p36_37_plot_select", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def plot_select(spark, d):
    return fx.table(spark, d, "orders").where("o_totalprice > 200000 and o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderpriority")


@register("p38_39_brushing", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity BETWEEN 1 AND 10 OR l_quantity BETWEEN 40 AND 45) AND (l_discount BETWEEN 0.02 AND 0.05)")
def brushing(spark, d):
    return fx.table(spark, d, "lineitem").where(tables.brushed({"l_quantity": [(1.0, 10.0), (40.0, 45.0)], "l_discount": [(0.02, 0.05)]})).select("l_orderkey", "l_linenumber")


@register("a14_plot_group_by", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS average, max(o_totalprice) AS high FROM orders GROUP BY 1, 2")
def plot_group_by(spark, d):
    return fx.table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("average"), F.max("o_totalprice").alias("high"))


@register("w02_candles", "SELECT event_type, CAST(user_id // 10 AS BIGINT) AS bucket, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2")
def candles(spark, d):
    return tables.candles(fx.events(spark, d), F.floor(F.col("user_id") / 10), "ts", "value", ["event_type"], "event_id")


@register("w03_log_axes", "SELECT o_orderkey, round(log10(o_totalprice), 6) AS log_y FROM orders")
def log_axes(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", F.round(F.log10("o_totalprice"), 6).alias("log_y"))


@register("w04_sequential", "SELECT event_id, value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS change FROM events")
def sequential(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return fx.events(spark, d).select("event_id", (F.col("value") - F.lag("value").over(w)).alias("change"))


@register("w05_arc_length", f"WITH {fx.GRID_SQL}, s AS (SELECT y, z, x, v, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (v - lag(v) OVER w) ** 2), 0) AS step FROM grid WINDOW w AS (PARTITION BY y * 100 + z ORDER BY x)) SELECT CAST(y * 100 + z AS INT) AS line, x, round(sum(step) OVER (PARTITION BY y * 100 + z ORDER BY x), 5) AS length FROM s")
def curve_length(spark, d):
    g = fx.grid(spark, d).withColumn("line", F.col("y") * 100 + F.col("z"))
    return tables.arc_length(g, "line", "x", ["x", "v"]).select("line", "x", F.round("length", 5).alias("length"))


@register("w05_resample_curve")
def curve_resample(spark, d):
    g = fx.grid(spark, d).withColumn("line", F.col("y") * 100 + F.col("z"))
    return tables.resample_curve(g, "line", "x", ["x", "v"], 20)


@register("w06_07_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@register("w08_length_threshold", "SELECT l_orderkey, count(*) AS points FROM lineitem GROUP BY 1 HAVING count(*) >= 5")
def length_threshold(spark, d):
    return fx.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("points")).where("points >= 5")


def _ports(spark, d):
    n = fx.table(spark, d, "nation").select(F.col("n_name").alias("name"))
    r = fx.table(spark, d, "region").select(F.col("r_name").alias("name"))
    return n, r


@register("u08_10_list_append", "SELECT n_name AS name, 0 AS port FROM nation UNION ALL SELECT r_name, 1 FROM region")
def list_append(spark, d):
    return combine.append(_ports(spark, d))


@register("u09_list_interleave", "WITH a AS (SELECT n_name AS name, 0 AS port, row_number() OVER (ORDER BY n_name) - 1 AS i FROM nation), b AS (SELECT r_name AS name, 1 AS port, row_number() OVER (ORDER BY r_name) - 1 AS i FROM region), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT name, port, i * 2 + port AS position FROM u WHERE i < least((SELECT count(*) FROM a), (SELECT count(*) FROM b))")
def list_interleave(spark, d):
    return combine.interleave(_ports(spark, d), "name")


@register("u11_ensemble_flatten", f"WITH {fx.ENSEMBLE_SQL} SELECT member, time, field, count(*) AS volumes FROM ensemble GROUP BY 1, 2, 3")
def ensemble_flatten(spark, d):
    return fx.ensemble(spark, d).groupBy("member", "time", "field").agg(F.count("*").alias("volumes"))


@register("u12_geometry_merge", f"WITH {fx.GRID_SQL} SELECT z, string_agg(x || ',' || y, ';' ORDER BY x, y) AS line FROM grid WHERE v > 120 GROUP BY z")
def geometry_merge(spark, d):
    points = F.array_sort(F.collect_list(F.struct("x", "y")))
    return fx.grid(spark, d).where("v > 120").groupBy("z").agg(F.concat_ws(";", F.transform(points, lambda p: F.concat_ws(",", p["x"], p["y"]))).alias("line"))


@register("u13_common_fields", f"WITH {fx.ENSEMBLE_SQL} SELECT field, count(DISTINCT member) AS members, count(DISTINCT member) = (SELECT count(DISTINCT member) FROM ensemble) AS common FROM ensemble GROUP BY field")
def common_fields(spark, d):
    return combine.common_fields(fx.ensemble(spark, d))


@register("a22_ensemble_hash", f"WITH {fx.ENSEMBLE_SQL}, s AS (SELECT CAST(member AS VARCHAR) AS member, count(DISTINCT time) AS steps FROM ensemble GROUP BY member), c AS (SELECT field, count(DISTINCT member) = (SELECT count(*) FROM s) AS common FROM ensemble GROUP BY field) SELECT md5((SELECT string_agg(member || steps, '' ORDER BY member) FROM s) || (SELECT string_agg(field, '' ORDER BY field) FROM c) || coalesce((SELECT string_agg(field, '' ORDER BY field) FROM c WHERE common), '')) AS hash")
def ensemble_hash(spark, d):
    return combine.ensemble_hash(fx.ensemble(spark, d))


@register("g28_similarity_matrix", "WITH e AS (SELECT label, i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS v FROM embeddings, range(64) t(i) GROUP BY label, i) SELECT a.label AS i, b.label AS j, round(sqrt(avg((a.v - b.v) ** 2)), 5) AS distance FROM e a JOIN e b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2")
def similarity_matrix(spark, d):
    v = fx.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "e"))
    means = v.groupBy("label", "k").agg(F.avg(F.col("e").cast("double")).alias("m"))
    return combine.similarity(means, "label", "k", "m").withColumn("distance", F.round("distance", 5))


@register("f29_30_plot_expression", f"WITH {fx.GRID_SQL} SELECT x, y, z, round(2 * sin(x) + sqrt(v) / (n + 1) - y ** 2, 6) AS value FROM grid")
def plot_expression(spark, d):
    return fx.grid(spark, d).select("x", "y", "z", F.round(tables.plot_expression("2 * sin(x) + sqrt(v) / (n + 1) - y ^ 2", ["x", "y", "v", "n"]), 6).alias("value"))


@register("f31_function_source", "SELECT i * (10.0::DOUBLE / 100) AS t, round(exp(-(i * (10.0::DOUBLE / 100))) * cos(i * (10.0::DOUBLE / 100)), 6) AS value FROM range(101) r(i)")
def function_source(spark, d):
    return tables.sampled(spark, "exp(-t) * cos(t)", "t", 0.0, 10.0, 101).withColumn("value", F.round("value", 6))


@register("f32_linear_fit", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def linear_fit(spark, d):
    fit = tables.linear_fit(fx.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return fit.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"))


@register("f32_polynomial_fit")
def polynomial_fit(spark, d):
    return tables.polynomial_fit(fx.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 2, ["l_returnflag"])


@register("f32_spline_fit")
def spline_fit(spark, d):
    """Coefficients of a cubic spline of eight pieces for each flag."""
    return fits.spline_fit(fx.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 8, ["l_returnflag"])


@register("f32_spline_values")
def spline_values(spark, d):
    rows = fx.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.dayofyear("o_orderdate").cast("double").alias("day"), "o_totalprice")
    fit = fits.spline_fit(rows, "day", "o_totalprice", 12, ["o_orderpriority"])
    return fits.spline_values(rows, "day", fit, ["o_orderpriority"]).select("o_orderkey", "fitted")


_REGRESSION = "WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, var_pop(l_quantity) AS s11, var_pop(l_discount) AS s22, covar_pop(l_quantity, l_discount) AS s12, covar_pop(l_quantity, l_extendedprice) AS s1, covar_pop(l_discount, l_extendedprice) AS s2, var_pop(l_extendedprice) AS sy FROM lineitem GROUP BY 1), b AS (SELECT *, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) AS b1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s)"


@register("f32_multiple_regression", f"{_REGRESSION} SELECT l_returnflag, n, round(my - b1 * m1 - b2 * m2, 2) AS intercept, round(b1, 4) AS by_quantity, round(b2, 2) AS by_discount, round((b1 * s1 + b2 * s2) / sy, 6) AS r2 FROM b")
def multiple_regression(spark, d):
    fit = fits.multiple_regression(fx.table(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", ["l_returnflag"])
    return fit.select("l_returnflag", "n", F.round("intercept", 2).alias("intercept"), F.round(F.col("slopes")[0], 4).alias("by_quantity"), F.round(F.col("slopes")[1], 2).alias("by_discount"), F.round("r2", 6).alias("r2"))


@register("f35_line_profile", f"WITH {fx.GRID_SQL}, m AS (SELECT y, z, x, x - row_number() OVER (PARTITION BY y, z ORDER BY x) AS island FROM grid WHERE v > 105) SELECT y, z, min(x) AS first, max(x) AS last, max(x) - min(x) AS length FROM m GROUP BY y, z, island")
def line_profile(spark, d):
    w = Window.partitionBy("y", "z").orderBy("x")
    above = fx.grid(spark, d).where("v > 105").withColumn("island", F.col("x") - F.row_number().over(w))
    return above.groupBy("y", "z", "island").agg(F.min("x").alias("first"), F.max("x").alias("last")).select("y", "z", "first", "last", (F.col("last") - F.col("first")).alias("length"))


@register("f38_ragged_series", "SELECT user_id, count(*) AS length, max(value) AS high, min(value) AS low FROM events GROUP BY 1")
def ragged_series(spark, d):
    return fx.events(spark, d).groupBy("user_id").agg(F.count("*").alias("length"), F.max("value").alias("high"), F.min("value").alias("low"))


@register("g30_min_z", "SELECT l_orderkey, l_linenumber, l_extendedprice - min(l_extendedprice) OVER (PARTITION BY trunc(l_quantity)) AS z FROM lineitem")
def min_z(spark, d):
    t = fx.table(spark, d, "lineitem").withColumn("k", F.col("l_quantity").cast("int"))
    least = t.groupBy("k").agg(F.min("l_extendedprice").alias("least"))
    return t.join(least, "k").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") - F.col("least")).alias("z"))
