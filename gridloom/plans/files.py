"""Queries that go through a file, a generator or a stream and give back what went in."""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import functions as F

from gridloom import storage
from gridloom.catalog import register
from gridloom.session import new_folder
from gridloom.sources import derived, synthetic, tables, volumes
from gridloom.streaming import live

from . import fixtures as fx

GRID = f"WITH {fx.GRID_SQL} SELECT x, y, z, v FROM grid"


def _round_trip(fmt: str, name: str, dtype: str = "f8"):
    def query(spark, d):
        g = fx.grid(spark, d)
        shape = g.agg(*[(F.max(a) + 1).alias(a) for a in "xyz"]).first()
        path = f"{new_folder(spark, 'volume')}/{name}"
        volumes.write_volume(g, path, tuple(shape), dtype, fmt, slab=4)
        return volumes.read_volumes(spark, [path]).where("v > 0").select("x", "y", "z", "v")

    return query


register("s02_nrrd_round_trip", GRID)(_round_trip("nrrd", "grid.nhdr"))
register("s06_mhd_round_trip", GRID)(_round_trip("mhd", "grid.mhd"))
register("s05_k06_nifti_round_trip", GRID)(_round_trip("nii", "grid.nii"))
register("s03_k01_vvd_round_trip", GRID)(_round_trip("vvd", "grid.vvd"))
register("s11_k03_dat_round_trip", f"WITH {fx.GRID_SQL} SELECT x, y, z, v FROM grid")(_round_trip("dat", "grid.dat", "f4"))
register("s18_k07_k11_image_round_trip", GRID)(_round_trip("pvti", "grid.pvti"))


for _name in ("s01_volume_url", "s01_volume_url_whole"):

    @register(_name, GRID)
    def volume_url(spark, d):
        """A file without an extension, read by the reader that its URL names."""
        g = fx.grid(spark, d)
        shape = g.agg(*[(F.max(a) + 1).alias(a) for a in "xyz"]).first()
        path = f"{new_folder(spark, 'volume')}/grid"
        volumes.write_volume(g, path, tuple(shape), "f8", "mhd")
        return volumes.read_url(spark, f"{path}?timeframe=0&preferredReader=MhdVolumeReader").where("v > 0").select("x", "y", "z", "v")


CELLS_SQL = "SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z, CAST((a.i + b.i * {0} + c.i * {1}) * 7 % 251 AS DOUBLE) AS v FROM range({0}) a(i), range({2}) b(i), range({3}) c(i)"


def _written(spark, name: str, head: bytes, dtype: str, shape: tuple[int, int, int], beside: dict[str, bytes] | None = None):
    """A volume file of a known rule behind a header of its format, read back."""
    folder = new_folder(spark, "volume")
    cells = (np.arange(math.prod(shape)) * 7 % 251).astype(dtype)
    for other, content in (beside or {}).items():
        storage.write_bytes(f"{folder}/{other}", content)
    storage.write_bytes(f"{folder}/{name}", head + cells.tobytes())
    return volumes.read_volumes(spark, [f"{folder}/{name}"]).select("x", "y", "z", "v")


@register("s09_synth2d", CELLS_SQL.format(6, 36, 6, 6))
def synth2d(spark, d):
    return _written(spark, "a.vol", struct.pack("<4si256s?3xiii", b"SYN2", 1, b"a", False, 6, 1, 2), "<u2", (6, 6, 6))


@register("s10_tuv", CELLS_SQL.format(5, 20, 4, 3))
def tuv(spark, d):
    return _written(spark, "a.tuv", struct.pack("<3H", 5, 4, 3), "<u2", (5, 4, 3))


@register("s12_bruker", CELLS_SQL.format(5, 20, 4, 3))
def bruker(spark, d):
    return _written(spark, "2dseq", b"", ">i2", (5, 4, 3), {"reco": b"##$RECO_byte_order=bigEndian\n##$RECO_size=( 2 )\n5 4\n##$RECO_wordtype=_16BIT_SGN_INT\n##END=\n"})


@register("s26_vortex_lines", "SELECT CAST(l.i AS INT) AS line, CAST(p.i AS INT) AS i, CAST(l.i + p.i AS DOUBLE) AS x, CAST(p.i * 2 AS DOUBLE) AS y, CAST(l.i AS DOUBLE) AS z FROM range(6) l(i), range(6) p(i) WHERE p.i <= l.i")
def vortex_lines(spark, d):
    folder = new_folder(spark, "vortices")
    storage.write_bytes(f"{folder}/a.vc", b"".join(struct.pack(f"<i{3 * (n + 1)}f", n + 1, *[c for i in range(n + 1) for c in (n + i, i * 2, n)]) for n in range(6)))
    return tables.read_vortices(spark, folder).select("line", "i", "x", "y", "z")


@register("s19_multiblock", f"WITH {fx.GRID_SQL}, {fx.GRID2_SQL} SELECT z, sum(v) AS total FROM (SELECT z, v FROM grid UNION ALL SELECT z, v FROM grid2) GROUP BY z")
def multiblock(spark, d):
    g = fx.grid(spark, d)
    shape = tuple(g.agg(*[(F.max(a) + 1).alias(a) for a in "xyz"]).first())
    folder = new_folder(spark, "blocks")
    volumes.write_volume(g, f"{folder}/a.pvti", shape, "f8", "pvti", slab=4)
    volumes.write_volume(fx.grid2(spark, d), f"{folder}/b.pvti", shape, "f8", "pvti")
    storage.write_bytes(f"{folder}/all.vtm", b'<VTKFile type="vtkMultiBlockDataSet"><vtkMultiBlockDataSet><DataSet index="0" file="a.pvti"/><DataSet index="1" file="b.pvti"/></vtkMultiBlockDataSet></VTKFile>')
    return volumes.read_volumes(spark, [f"{folder}/all.vtm"], name="v").groupBy("z").agg(F.sum("v").alias("total"))


@register("s33_ensemble_folder", f"WITH {fx.GRID_SQL} SELECT 'm' || m AS member, CAST(t AS INT) AS time, 'rho' AS field, sum(v) + (10 * m + t) * count(*) AS total FROM grid, range(2) a(m), range(2) b(t) GROUP BY m, t")
def ensemble_folder(spark, d):
    g = fx.grid(spark, d)
    n = tuple(g.agg(*[(F.max(a) + 1).alias(a) for a in "xyz"]).first())
    folder = new_folder(spark, "ensemble")
    for m in range(2):
        for t in range(2):
            volumes.write_volume(g.withColumn("v", F.col("v") + (10 * m + t)), f"{folder}/m{m}/rho_{t:03d}.mhd", n, "f8", "mhd")
    return volumes.read_ensemble(spark, folder).groupBy("member", "time", "field").agg(F.sum("v").alias("total"))


@register("s03_slice_range", f"{GRID} WHERE z BETWEEN 2 AND 3")
def slice_range(spark, d):
    """Slices outside the range are not read."""
    g = fx.grid(spark, d)
    shape = g.agg(*[(F.max(a) + 1).alias(a) for a in "xyz"]).first()
    path = f"{new_folder(spark, 'volume')}/grid.mhd"
    volumes.write_volume(g, path, tuple(shape), "f8", "mhd", slab=2)
    return volumes.read_volumes(spark, [path], zmin="2", zmax="3").where("v > 0").select("x", "y", "z", "v")


@register("s07_multi_volume", f"WITH {fx.GRID_SQL} SELECT z, 2 * sum(v) AS total FROM grid GROUP BY z")
def multi_volume(spark, d):
    g = fx.grid(spark, d)
    shape = g.agg(*[(F.max(a) + 1).alias(a) for a in "xyz"]).first()
    folder = new_folder(spark, "volumes")
    volumes.write_volume(g, f"{folder}/a.mhd", tuple(shape), "f8", "mhd")
    storage.write_bytes(f"{folder}/list.txt", b"a.mhd\na.mhd\n")
    return volumes.read_volume_list(spark, f"{folder}/list.txt").groupBy("z").agg(F.sum("v").alias("total"))


@register("s29_k16_points", "SELECT 'n' || n_regionkey AS \"group\", n_nationkey AS id FROM nation WHERE n_regionkey < 3")
def points(spark, d):
    path = new_folder(spark, "points")
    p = fx.table(spark, d, "nation").select(F.concat(F.lit("n"), "n_regionkey").alias("group"), F.col("n_nationkey").cast("long").alias("id"), *[F.lit(0.5).alias(a) for a in "xyz"])
    tables.write_points(p, path, F.substring("group", 2, 9).cast("int") < 3)
    return tables.read_points(spark, path).select("group", F.col("id").cast("int").alias("id"))


@register("k08_10_table_export", "SELECT r_regionkey, r_name FROM region")
def table_export(spark, d):
    path = new_folder(spark, "export")
    tables.export_table(fx.table(spark, d, "region").select("r_regionkey", "r_name"), path)
    return spark.read.schema("r_regionkey int, r_name string").option("sep", ";").option("header", True).csv(path)


@register("k11_18_names", "SELECT 'f_iT' || lpad(CAST(n_nationkey AS VARCHAR), 7, '0') || '_iC' || lpad(CAST(n_regionkey AS VARCHAR), 5, '0') AS name, base64(encode(n_name)) AS packed, 'a.' || n_name AS stem, 'vti' AS ext FROM nation")
def names(spark, d):
    n = fx.table(spark, d, "nation")
    stem, ext = tables.stem_and_extension(F.concat(F.lit("a."), "n_name", F.lit(".vti")))
    return n.select(tables.file_name(F.lit("f"), F.col("n_nationkey"), F.col("n_regionkey")).alias("name"), tables.packed_cells(F.col("n_name")).alias("packed"), stem.alias("stem"), ext.alias("ext"))


@register("k13_14_series_save", f"WITH {fx.ENSEMBLE_SQL} SELECT field, count(*) AS n FROM ensemble WHERE time = 1995 GROUP BY field")
def series_save(spark, d):
    path = new_folder(spark, "series")
    tables.save_series(fx.ensemble(spark, d), path, "time")
    return tables.load_series(spark, path, ("member",)).where("time = 1995").groupBy("field").agg(F.count("*").alias("n"))


@register("s27_field_plot_source", f"WITH {fx.GRID_SQL} SELECT x, CAST(floor(v / 20) AS INT) AS bin, count(*) AS intensity FROM grid GROUP BY 1, 2")
def field_plot_source(spark, d):
    """A stored field plot, checked for intensities when it is loaded."""
    path = new_folder(spark, "plot")
    plot = fx.grid(spark, d).groupBy("x", F.floor(F.col("v") / 20).cast("int").alias("bin")).agg(F.count("*").alias("intensity"))
    tables.save_series(plot, path)
    return tables.load_series(spark, path, ("intensity",))


@register("s32_sample_point_categories", "SELECT n_name AS name, CAST(n_nationkey AS DOUBLE) AS x, CAST(n_regionkey AS DOUBLE) AS y, 0.5::DOUBLE AS z, n_name || '.png' AS texture FROM nation")
def sample_point_categories(spark, d):
    path = new_folder(spark, "categories")
    position = F.struct(F.col("n_nationkey").cast("double").alias("x"), F.col("n_regionkey").cast("double").alias("y"), F.lit(0.5).alias("z"))
    fx.table(spark, d, "nation").select(F.col("n_name").alias("name"), position.alias("position"), F.concat("n_name", F.lit(".png")).alias("texture")).write.json(path)
    return tables.read_sample_points(spark, path).select("name", "position.*", "texture")


@register("f37_point_info", "SELECT n_nationkey, 'point ' || n_nationkey || ' of group ' || n_regionkey || ' at ' || printf('%.2f', n_nationkey * 0.25::DOUBLE) AS info FROM nation")
def point_info(spark, d):
    info = tables.point_info("point %d of group %d at %.2f", F.col("n_nationkey"), F.col("n_regionkey"), F.col("n_nationkey") * 0.25)
    return fx.table(spark, d, "nation").select("n_nationkey", info.alias("info"))


@register("k15_s24_text", "SELECT 'Lorem ipsum dolor sit amet' AS value")
def text_save(spark, d):
    path = new_folder(spark, "text")
    tables.save_text(tables.constant_text(spark, "Lorem ipsum dolor sit amet"), "value", path)
    return spark.read.text(path)


@register("k17_raw_bytes", "SELECT i, CAST((i * 7) % 256 AS INT) AS value FROM range(1000) r(i)")
def raw_bytes(spark, d):
    folder = new_folder(spark, "raw")
    storage.write_bytes(f"{folder}/a.raw", bytes(i * 7 % 256 for i in range(1000)))
    return volumes.raw_values(spark, folder).select("i", "value")


@register("k19_not_yet_written", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def not_yet_written(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey")
    return tables.not_yet_written(o, o.where("o_orderkey % 3 = 0"), "o_orderkey")


@register("s36_channel_flow", "SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z, round(greatest(0, 1 - ((b.i - 3.5::DOUBLE) ** 2 + (c.i - 3.5::DOUBLE) ** 2) / 16), 6) AS u0 FROM range(8) a(i), range(8) b(i), range(8) c(i)")
def channel_flow(spark, d):
    return synthetic.channel_flow(spark, 8).select("x", "y", "z", F.round("u0", 6).alias("u0"))


@register("s38_shell", "SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z, round(abs(sqrt((a.i - 4) ** 2 + (b.i - 4) ** 2 + (c.i - 4) ** 2) - 3), 6) AS v FROM range(9) a(i), range(9) b(i), range(9) c(i)")
def shell(spark, d):
    return synthetic.shell(spark, 9, 3.0).select("x", "y", "z", F.round("v", 6).alias("v"))


@register("s37_particles")
def particles(spark, d):
    return synthetic.particles(spark, 200, 5)


@register("t03_06_continuous_save", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def continuous_save(spark, d):
    """A watched folder saved batch by batch, read back as a table."""
    folder = new_folder(spark, "live")
    fx.events(spark, d).write.parquet(f"{folder}/in")
    stream = live.watch(spark, f"{folder}/in", "event_id long, user_id long, event_type string, ts timestamp, value double", "parquet")
    live.continuous_save(stream, f"{folder}/out", f"{folder}/check", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@register("t11_lookback_text", "SELECT n_nationkey, 't = ' || printf('%.1f', n_nationkey * 0.5) AS label FROM nation")
def lookback_text(spark, d):
    return fx.table(spark, d, "nation").select("n_nationkey", live.lookback_text("n_nationkey").alias("label"))


@register("s40_box_muller", "SELECT p_partkey, round(sqrt(-2 * ln((p_partkey % 997 + 1) / 998.0::DOUBLE)) * cos(6.283185307179586::DOUBLE * (p_size % 50) / 50), 6) AS normal FROM part")
def box_muller(spark, d):
    normal = synthetic.box_muller((F.col("p_partkey") % 997 + 1) / 998.0, F.col("p_size") % 50 / 50.0)
    return fx.table(spark, d, "part").select("p_partkey", F.round(normal, 6).alias("normal"))


@register("t07_pipe_lines", "SELECT event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY event_type")
def pipe_lines(spark, d):
    """Comma-separated lines that arrive as text, parsed as they come and saved batch by batch."""
    folder = new_folder(spark, "pipe")
    fx.events(spark, d).select(F.concat_ws(",", "event_id", "event_type", "value").alias("value")).write.text(f"{folder}/in")
    lines = live.parse_lines(live.watch(spark, f"{folder}/in", "value string", "text"), "event_id long, event_type string, value double")
    live.continuous_save(lines, f"{folder}/out", f"{folder}/check", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@register("t01_event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def event_windows(spark, d):
    """Windows that the watermark has closed, appended once each."""
    folder = new_folder(spark, "windows")
    fx.events(spark, d).coalesce(1).write.parquet(f"{folder}/in")
    stream = live.watch(spark, f"{folder}/in", "event_id long, user_id long, event_type string, ts timestamp_ntz, value double", "parquet")
    windows = live.running_windows(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "event_type", "1 day")
    live.continuous_save(windows, f"{folder}/out", f"{folder}/check", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("start", "event_type", "n", "low", "high")


@register("x10_derived_statistics", f"WITH {fx.GRID_SQL} SELECT min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean, count(*) AS cells FROM grid")
def derived_statistics(spark, d):
    """Statistics of the field, kept under the hash of the files that it is made of."""
    volume = derived.files_hash(spark, [f"{d}/lineitem.parquet"])
    statistics = lambda: fx.grid(spark, d).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg("v"), 6).alias("mean"), F.count("*").alias("cells"))
    return derived.derived(spark, volume, "statistics of v in the grid of 16 x 16 x 7", statistics)
