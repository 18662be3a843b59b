"""Queries of the graph, component and trajectory operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import register
from gridloom.operators import corelines as lines_of
from gridloom.operators import bundling, graph, stencil, thinning, trajectories, walker_weights
from gridloom.operators.components import connected_components

from . import fixtures as fx

DEGREE = "deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node)"
PRUNED = f"WITH {fx.EDGES_SQL}, {DEGREE}"


# The names that end in _whole date from when the others read a part of the edges.
for _name in ("g02_remove_deletable", "g02_remove_deletable_whole"):

    @register(_name, f"WITH {fx.EDGES_SQL} SELECT src, dst FROM edges WHERE NOT dst LIKE 's1%'")
    def remove_deletable(spark, d):
        return graph.remove_deletable(fx.edges(spark, d), F.col("dst").startswith("s1"))


for _name in ("g03_remove_end_edges", "g03_remove_end_edges_whole"):

    @register(_name, f"{PRUNED} SELECT src, dst FROM edges e JOIN deg a ON a.node = src JOIN deg b ON b.node = dst WHERE NOT (a.degree = 1 OR b.degree = 1)")
    def remove_end_edges(spark, d):
        return graph.remove_end_edges(fx.edges(spark, d))


@register("g01_prune", f"WITH RECURSIVE {fx.EDGES_SQL}, r AS (SELECT 0 AS i, src, dst FROM edges UNION ALL SELECT i + 1, src, dst FROM (SELECT i, src, dst, count(*) OVER (PARTITION BY src) AS ds, count(*) OVER (PARTITION BY dst) AS dd FROM r) q WHERE ds > 1 AND dd > 1 AND i < 4) SELECT src, dst FROM r WHERE i = 4")
def prune(spark, d):
    return graph.prune(fx.edges(spark, d), rounds=4)


@register("g01_prune_whole")
def prune_whole(spark, d):
    """Until no end edge is left."""
    return graph.prune(fx.edges(spark, d))


#: Twelve rounds of the smallest name among neighbours; the graph's diameter is below that.
COMPONENTS_SQL = f"WITH RECURSIVE {fx.EDGES_SQL}, near AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges UNION ALL SELECT DISTINCT src, src FROM edges UNION ALL SELECT DISTINCT dst, dst FROM edges), r AS (SELECT 0 AS i, a AS node, a AS root FROM near WHERE a = b UNION ALL SELECT i + 1, near.b, min(root) FROM r JOIN near ON near.a = r.node WHERE i < 12 GROUP BY i, near.b) SELECT node, root FROM r WHERE i = 12"

for _name in ("g08_connected_components", "g08_connected_components_whole"):

    @register(_name, COMPONENTS_SQL)
    def components(spark, d):
        return connected_components(fx.edges(spark, d))


@register("g04_contract_paths")
def contract_paths(spark, d):
    edges = fx.edges(spark, d).withColumn("edge_id", F.xxhash64("src", "dst")).withColumn("length", F.lit(1.0))
    return graph.contract_paths(edges)


@register("g05_centerlines", f"WITH {fx.GRID_SQL} SELECT CAST(y * 100 + z AS INT) AS edge_id, count(*) AS points, min(x) AS first FROM grid WHERE v > 105 GROUP BY 1")
def centerlines(spark, d):
    points = fx.grid(spark, d).where("v > 105").select((F.col("y") * 100 + F.col("z")).alias("edge_id"), F.col("x").alias("i"), "x", "y", "z")
    return graph.centerlines(points).select("edge_id", F.size("line").cast("long").alias("points"), F.col("line")[0]["x"].alias("first"))


@register("g06_network_comparison", f"WITH {fx.GRID_SQL}, f AS (SELECT x, y, z FROM grid WHERE v > 125), t AS (SELECT x, y, z FROM grid WHERE n > 40), h AS (SELECT f.x AS fx, f.y AS fy, f.z AS fz, t.x AS tx, t.y AS ty, t.z AS tz FROM f, t WHERE (f.x - t.x) ** 2 + (f.y - t.y) ** 2 + (f.z - t.z) ** 2 <= 1) SELECT round(1 - (SELECT count(*) FROM (SELECT DISTINCT tx, ty, tz FROM h)) / (SELECT count(*) FROM t), 6) AS false_negative, round(1 - (SELECT count(*) FROM (SELECT DISTINCT fx, fy, fz FROM h)) / (SELECT count(*) FROM f), 6) AS false_positive")
def network_comparison(spark, d):
    g = fx.grid(spark, d)
    return graph.match_rates(g.where("v > 125"), g.where("n > 40"), 1.0).select(*[F.round(c, 6).alias(c) for c in ("false_negative", "false_positive")])


@register("g07_isotropic_spacing", "SELECT s_suppkey, least(s_acctbal, 500.0::DOUBLE, s_suppkey * 1.0::DOUBLE) * 2 AS spacing FROM supplier")
def isotropic_spacing(spark, d):
    return fx.table(spark, d, "supplier").select("s_suppkey", (F.least("s_acctbal", F.lit(500.0), F.col("s_suppkey") * 1.0) * 2).alias("spacing"))


CELLS = f"WITH RECURSIVE {fx.GRID_SQL}, m AS (SELECT x, y, z, CAST(x AS BIGINT) * 1099511627776 + y * 1048576 + z AS id FROM grid WHERE v > 125), e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1), reach AS (SELECT id, id AS other FROM m UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other), lab AS (SELECT id, min(other) AS label FROM reach GROUP BY id)"


@register("g08_cell_components", f"{CELLS} SELECT x, y, z, label FROM m JOIN lab USING (id)")
def cell_components(spark, d):
    return graph.cell_components(fx.grid(spark, d).where("v > 125"))


@register("g09_component_selector", f"{CELLS}, big AS (SELECT label FROM lab GROUP BY label HAVING count(*) >= 3) SELECT x, y, z, label FROM m JOIN lab USING (id) WHERE label IN (SELECT label FROM big)")
def component_selector(spark, d):
    labelled = graph.cell_components(fx.grid(spark, d).where("v > 125"))
    big = labelled.groupBy("label").agg(F.count("*").alias("n")).where("n >= 3").select("label")
    return labelled.join(big, "label", "left_semi").select("x", "y", "z", "label")


@register("j08_g11_flood_fill", f"{CELLS} SELECT x, y, z FROM m JOIN lab USING (id) WHERE label IN (SELECT label FROM m JOIN lab USING (id) WHERE z = 0)")
def flood_fill(spark, d):
    cells = fx.grid(spark, d).where("v > 125")
    return graph.flood_fill(cells, cells.where("z = 0"))


@register("p04_double_threshold", f"{CELLS} SELECT x, y, z FROM m JOIN lab USING (id) WHERE label IN (SELECT label FROM m JOIN lab USING (id) JOIN grid USING (x, y, z) WHERE v > 140)")
def double_threshold(spark, d):
    return graph.hysteresis(fx.grid(spark, d), "v", (125.0000001, 1e9), (140.0000001, 1e9))


@register("g13_bayesian_classifier")
def bayes(spark, d):
    rows = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    total = rows.count()
    model = rows.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("mean"), F.stddev_pop("l_extendedprice").alias("sd"), (F.count("*") / total).alias("prior"))
    return graph.classify_gaussian(rows, model, "l_returnflag", "l_extendedprice")


@register("g16_streamlines")
def streamlines(spark, d):
    seeds = fx.grid(spark, d).where("z = 0 and v > 110").select((F.col("x") * 100 + F.col("y")).alias("line_id"), "x", "y", "z")
    return graph.streamlines(seeds, fx.vecfield(spark, d), ["u0", "u1", "u2"], 0.25, 16)


@register("j14_nearest_line", f"WITH {fx.GRID_SQL}, p AS (SELECT x * 10000 + y * 100 + z AS pid, x, y, z FROM grid WHERE v > 125), q AS (SELECT y AS lid, x, y, z FROM grid WHERE n > 42), d AS (SELECT pid, lid, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS distance FROM p, q) SELECT CAST(pid AS INT) AS pid, arg_min(lid, (distance, lid)) AS lid, round(min(distance), 6) AS distance FROM d WHERE distance <= 2 GROUP BY pid")
def nearest_line(spark, d):
    g = fx.grid(spark, d)
    points = g.where("v > 125").select((F.col("x") * 10000 + F.col("y") * 100 + F.col("z")).alias("pid"), "x", "y", "z")
    lines = g.where("n > 42").select(F.col("y").alias("lid"), "x", "y", "z")
    return graph.nearest(points, lines, 2.0, "pid", "lid").withColumn("distance", F.round("distance", 6))


@register("g18_parallel_vectors", f"WITH {fx.VEC_SQL}, c AS (SELECT x, y, z, sqrt((u1 * 2 - u2 * 7) ** 2 + (u2 * 50 - u0 * 2) ** 2 + (u0 * 7 - u1 * 50) ** 2) AS cr FROM vec) SELECT x, y, z, round(cr, 5) AS \"cross\" FROM c WHERE cr <= 8000")
def parallel_vectors(spark, d):
    f = fx.vecfield(spark, d).withColumns({"b0": F.lit(50.0), "b1": F.lit(7.0), "b2": F.lit(2.0)})
    return graph.parallel_vectors(f, ["u0", "u1", "u2"], ["b0", "b1", "b2"], 8000.0).select("x", "y", "z", F.round("cross", 5).alias("cross"))


def _flow(spark, d):
    """The vector field and its acceleration."""
    f = fx.vecfield(spark, d)
    return f.join(stencil.acceleration(f, ["u0", "u1", "u2"]), ["x", "y", "z"])


@register("g18_parallel_points")
def parallel_points(spark, d):
    """Where the flow is parallel to its acceleration: points on triangles between cells."""
    return lines_of.parallel_vectors(_flow(spark, d), ["u0", "u1", "u2"], ["a0", "a1", "a2"])[0]


@register("g19_coreline_lines")
def coreline_lines(spark, d):
    """Those points in order, as lines of at least three cells' length."""
    return lines_of.corelines(_flow(spark, d), ["u0", "u1", "u2"], ["a0", "a1", "a2"], least=3.0)


@register("g20_rotation_direction", f"WITH {fx.VEC_SQL} SELECT x, y, z, CAST(sign(u0 - 8 * u1) AS INT) AS direction FROM vec")
def rotation_direction(spark, d):
    return fx.vecfield(spark, d).select("x", "y", "z", F.signum(F.col("u0") - F.col("u1") * 8).cast("int").alias("direction"))


@register("g22_compact", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders")
def compact(spark, d):
    return graph.compact(fx.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", buckets=16)


@register("g23_merger_tree", "WITH RECURSIVE p AS (SELECT CAST(p_partkey AS BIGINT) AS node, CASE WHEN p_partkey > 1 THEN CAST(p_partkey // 2 AS BIGINT) END AS parent FROM part WHERE p_partkey >= 1), t AS (SELECT node, node AS root, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.node, t.root, t.depth + 1 FROM p JOIN t ON p.parent = t.node) SELECT node, root, CAST(depth AS BIGINT) AS depth FROM t")
def merger_tree(spark, d):
    p = fx.table(spark, d, "part").where("p_partkey >= 1").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent"))
    return graph.chase(p, "node", "parent")


@register("g25_label_swap", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'R' WHEN 'R' THEN 'A' ELSE l_returnflag END AS label FROM lineitem")
def label_swap(spark, d):
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", graph.swap_labels(F.col("l_returnflag"), "A", "R").alias("label"))


@register("g29_vector_quantisation")
def quantise(spark, d):
    """k-means over the embeddings by pyspark.ml, one code per vector."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = fx.table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=8, seed=1, maxIter=10).fit(v)
    return model.transform(v).select("vec_id", F.col("prediction").alias("code"))


@register("g10_track_statistics", "WITH s AS (SELECT user_id, event_type, event_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events) SELECT user_id, max(event_id) - min(event_id) AS duration, round(coalesce(sum(abs(step)), 0), 4) AS length, round(abs(arg_max(value, event_id) - arg_min(value, event_id)), 6) AS displacement FROM s GROUP BY user_id")
def track_statistics(spark, d):
    out = graph.track_statistics(fx.events(spark, d), "user_id", "event_id", ["value"])
    return out.select("user_id", "duration", F.round("length", 4).alias("length"), F.round("displacement", 6).alias("displacement"))


@register("g12_watershed", f"WITH RECURSIVE {fx.GRID_SQL}, p AS (SELECT x, y, z, v, CAST(x AS BIGINT) * 1073741824 + y * 32768 + z AS node FROM grid), d AS (SELECT a.x, a.y, a.z, a.node, arg_min(b.node, (b.v, b.node)) AS down FROM p a JOIN p b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 GROUP BY ALL), t AS (SELECT node, node AS basin FROM d WHERE node = down UNION ALL SELECT d.node, t.basin FROM d JOIN t ON d.down = t.node WHERE d.node <> d.down) SELECT x, y, z, basin FROM d JOIN t USING (node)")
def watershed(spark, d):
    return graph.basins(fx.grid(spark, d), "v")


@register("g12_watershed_level")
def watershed_level(spark, d):
    """Basins merged up to a fifth of the range, above a tenth of it."""
    return graph.watershed(fx.grid(spark, d), "v", level=0.2, threshold=0.1)


@register("g14_random_walker")
def random_walker(spark, d):
    g = fx.grid(spark, d)
    seeds = g.where("v > 140 or v < 80").select("x", "y", "z", (F.col("v") > 100).cast("int").alias("label"))
    return graph.random_walker(g, "v", seeds)


def _noise_walker(method: str, value: str):
    @register(f"g14_walker_{method}")
    def walker(spark, d):
        """The walker with edge weights of a noise model."""
        g = fx.grid(spark, d)
        seeds = g.where("v > 140 or v < 80").select("x", "y", "z", (F.col("v") > 100).cast("int").alias("label"))
        return graph.random_walker(g, value, seeds, weights=walker_weights.edge_weights(g, value, method))


for _method, _value in (("gaussian", "v"), ("gaussian_local", "v"), ("poisson", "n"), ("ttest", "v")):
    _noise_walker(_method, _value)


@register("g14_pyramid_walker")
def pyramid_walker(spark, d):
    """From a grid of half the resolution; only the bricks that it leaves open are solved."""
    g = fx.grid(spark, d)
    seeds = g.where("v > 140 or v < 80").select("x", "y", "z", (F.col("v") > 100).cast("int").alias("label"))
    return graph.pyramid_walker(g, "v", seeds, levels=1)[0]


@register("g15_seeds", f"WITH {fx.GRID_SQL} SELECT DISTINCT CAST(round_even(x * 1.5::DOUBLE, 0) AS INT) AS x, y, z FROM grid WHERE round_even(x * 1.5::DOUBLE, 0) <= 15 AND n % 5 <> 0")
def seeds(spark, d):
    points = fx.grid(spark, d).select(F.when(F.col("n") % 5 != 0, F.col("x") * 1.5).alias("x"), "y", "z")
    return graph.seeds_from_geometry(points, (16, 16, 7))


@register("g17_bundle_centroid", f"WITH {fx.GRID_SQL} SELECT bundle, i, count(*) AS lines, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM (SELECT z AS bundle, x AS i, x, y, z FROM grid) GROUP BY bundle, i")
def bundle_centroid(spark, d):
    lines = fx.grid(spark, d).withColumns({"bundle": F.col("z"), "i": F.col("x")})
    return graph.bundle_centroid(lines, "bundle", "i")


def row_curves(spark, d):
    """The grid's rows along x as curves whose height is the value."""
    return fx.grid(spark, d).select((F.col("y") * 100 + F.col("z")).alias("line"), F.col("x").alias("i"), F.col("x").cast("double").alias("x"), (F.col("v") / 20).alias("y"), (F.col("z") * 3.0).alias("z"))


@register("g17_line_bundles")
def line_bundles(spark, d):
    """Rows of like values bundled by the mean distance of their points."""
    return bundling.bundles(row_curves(spark, d), "line", "i", 1.0)[0]


@register("g24_label_from_graph", f"WITH {fx.GRID_SQL}, m AS (SELECT x, y, z FROM grid WHERE v > 120), e AS (SELECT y * 100 + z AS lab, x, y, z FROM grid WHERE n > 42), d AS (SELECT m.x, m.y, m.z, lab, sqrt((m.x - e.x) ** 2 + (m.y - e.y) ** 2 + (m.z - e.z) ** 2) AS distance FROM m, e) SELECT CAST(x * 10000 + y * 100 + z AS INT) AS cell, CAST(arg_min(lab, (distance, lab)) AS INT) AS lab, round(min(distance), 6) AS distance FROM d WHERE distance <= 3 GROUP BY x, y, z")
def label_from_graph(spark, d):
    g = fx.grid(spark, d)
    mask = g.where("v > 120").select((F.col("x") * 10000 + F.col("y") * 100 + F.col("z")).alias("cell"), "x", "y", "z")
    edges = g.where("n > 42").select((F.col("y") * 100 + F.col("z")).alias("lab"), "x", "y", "z")
    return graph.nearest(mask, edges, 3.0, "cell", "lab").withColumn("distance", F.round("distance", 6))


@register("j11_cross_grid", f"WITH {fx.GRID_SQL} SELECT CAST(floor(y * 0.5::DOUBLE) AS INT) AS x, CAST(floor(x * 0.25::DOUBLE + 1) AS INT) AS y, CAST(z AS INT) AS z, round(avg(v), 6) AS v FROM (SELECT x, y, z, v FROM grid) GROUP BY ALL")
def cross_grid(spark, d):
    matrix = ((0.0, 0.5, 0.0, 0.0), (0.25, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0))
    return graph.regrid(fx.grid(spark, d), matrix, "v").withColumn("v", F.round("v", 6))


@register("n21_medial_surface")
def medial_surface(spark, d):
    """Cells of a mask whose distance to the outside is a regional maximum."""
    from gridloom.operators.distance import distance_transform
    from gridloom.operators.stencil import regional_maxima

    distance = distance_transform(fx.grid(spark, d), F.col("v") < 96)
    return regional_maxima(distance.where("distance > 0"), "distance").where("is_max = 1").select("x", "y", "z")


@register("n21_medial_line")
def medial_line(spark, d):
    return thinning.thin(fx.grid(spark, d).where("v >= 104"))


@register("n21_medial_point")
def medial_point(spark, d):
    """What thinning leaves where ends may go: a cell for each part without holes, loops for the others."""
    return thinning.thin(fx.grid(spark, d).where("v >= 104"), ends=False)


@register("g14_t10_multilabel_walker")
def multilabel_walker(spark, d):
    """One walk per label against the others; a cell takes the label that is most probable."""
    g = fx.grid(spark, d)
    seeds = g.where("v > 140 or v < 70 or n = 36").select("x", "y", "z", F.when(F.col("v") > 140, 2).when(F.col("v") < 70, 1).otherwise(3).alias("label"))
    return graph.multilabel_walker(g, "v", seeds, (1, 2, 3))


@register("g19_corelines", f"{CELLS}, big AS (SELECT label FROM lab GROUP BY label HAVING count(*) >= 4) SELECT x, y, z, label AS line FROM m JOIN lab USING (id) WHERE label IN (SELECT label FROM big)")
def corelines(spark, d):
    return trajectories.corelines(fx.grid(spark, d).where("v > 125"), least=4, diagonal=False)


@register("g26_step_durations", "SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id AS lasts FROM events")
def step_durations(spark, d):
    return trajectories.step_durations(fx.events(spark, d), "user_id", "event_id").select("user_id", "event_id", "lasts")


@register("g26_migration_score", "WITH s AS (SELECT user_id, event_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events) SELECT user_id, round(abs(arg_max(value, event_id) - arg_min(value, event_id)) / sum(abs(step)), 6) AS directness FROM s GROUP BY user_id")
def migration_score(spark, d):
    return trajectories.migration_scores(fx.events(spark, d), "user_id", "event_id", ["value"]).select("user_id", F.round("directness", 6).alias("directness"))


@register("g26_track_points", "SELECT vec_id, CAST(i - 1 AS INT) AS i, embedding[i] AS value FROM embeddings, range(1, 65) r(i)")
def track_points(spark, d):
    lines = fx.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda e: F.struct(e.alias("value"))).alias("points"))
    return trajectories.track_points(lines, "vec_id")


@register("g27_time_series_extraction", f"WITH {fx.GRID_SQL} SELECT p_partkey, z AS time, v FROM grid JOIN part ON CAST(round_even((p_partkey % 31) * 0.5::DOUBLE, 0) AS INT) = x AND p_size % 16 = y")
def time_series(spark, d):
    """The grid's slices taken as time steps, sampled at points between cells."""
    field = fx.grid(spark, d).select("x", "y", F.lit(0).alias("z"), F.col("z").alias("time"), "v")
    points = fx.table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") % 31) * 0.5).alias("x"), (F.col("p_size") % 16).alias("y"), F.lit(0.0).alias("z"))
    return trajectories.sample_series(field, points, "p_partkey", "time", "v")
