"""Readers and writers, round trip."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import headers, synthetic, tables, volumes
from gridloom.streaming import live


@pytest.fixture
def cube(tmp_path):
    a = np.arange(4 * 3 * 5, dtype="<u2").reshape(5, 3, 4)  # z, y, x
    (tmp_path / "a.raw").write_bytes(a.tobytes())
    return a


def _same(df, a):
    got = {(r.x, r.y, r.z): r.v for r in df.collect()}
    assert got == {(x, y, z): float(a[z, y, x]) for z, y, x in np.ndindex(*a.shape)}


def test_nrrd_detached_and_attached(spark, tmp_path, cube):
    head = "NRRD0004\ntype: ushort\ndimension: 3\nsizes: 4 3 5\nspacings: 1 2 3\nendian: little\nencoding: raw\n"
    (tmp_path / "a.nhdr").write_text(head + "datafile: ./a.raw\n")
    (tmp_path / "b.nrrd").write_bytes(head.encode() + b"\n" + cube.tobytes())
    for name in ("a.nhdr", "b.nrrd"):
        _same(volumes.read_volumes(spark, [str(tmp_path / name)]), cube)
    assert volumes.read_volumes(spark, [str(tmp_path / "a.nhdr")], zmin="1", zmax="2").select(F.min("z"), F.max("z")).first() == (1, 2)
    row = volumes.metadata(spark, [str(tmp_path / "a.nhdr")]).first()
    assert (row.nx, row.ny, row.nz, row.sy, row.type) == (4, 3, 5, 2.0, "u2")


def test_mhd_vvd_dat(spark, tmp_path, cube):
    (tmp_path / "a.mhd").write_text("ObjectType = Image\nNDims = 3\nDimSize = 4 3 5\nElementType = MET_USHORT\nElementDataFile = a.raw\n")
    (tmp_path / "a.vvd").write_text('<VolumeData><Volumes><Volume><RawData filename="a.raw" format="uint16"><dimensions x="4" y="3" z="5"/></RawData><RealWorldMapping scale="2" offset="1"/></Volume></Volumes></VolumeData>')
    (tmp_path / "a.dat").write_text("ObjectFileName: a.raw\nResolution: 4 3 5\nSliceThickness: 1 1 1\nFormat: USHORT\n")
    _same(volumes.read_volumes(spark, [str(tmp_path / "a.mhd")]), cube)
    _same(volumes.read_volumes(spark, [str(tmp_path / "a.dat")]), cube)
    _same(volumes.read_volumes(spark, [str(tmp_path / "a.vvd")], realworld="false"), cube)
    assert volumes.read_volumes(spark, [str(tmp_path / "a.vvd")]).agg(F.max("v")).first()[0] == 2 * 59 + 1
    (tmp_path / "list.txt").write_text("a.mhd\na.dat\n")
    assert volumes.read_volume_list(spark, str(tmp_path / "list.txt")).count() == 120


def test_nifti(spark, tmp_path, cube):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 4, 3, 5, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 512)
    struct.pack_into("<8f", head, 76, 1, 1, 2, 3, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    (tmp_path / "a.nii").write_bytes(bytes(head) + cube.tobytes())
    _same(volumes.read_volumes(spark, [str(tmp_path / "a.nii")]), cube)


@pytest.mark.parametrize("fmt", ["nrrd", "mhd"])
def test_write_volume(spark, tmp_path, fmt):
    f = synthetic.shell(spark, 9, 3.0)
    path = str(tmp_path / ("out.nhdr" if fmt == "nrrd" else "out.mhd"))
    files = volumes.write_volume(f, path, (9, 9, 9), "f8", fmt, slab=4)
    assert len(files) == 3
    back = volumes.read_volumes(spark, [path]).select("x", "y", "z", F.col("v").alias("w"))
    assert f.join(back, ["x", "y", "z"]).where("v = w").count() == 729


def test_unknown_and_broken_headers(tmp_path):
    with pytest.raises(ValueError):
        headers.read_header("x.abc", b"")
    with pytest.raises(ValueError):
        headers.nrrd("x.nrrd", b"P6\n\n")
    assert headers.extension("a.b.c") == ("a.b", "c") and headers.extension("abc") == ("abc", "")


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, 1.0)], "id int, name string, v double")
    tables.export_table(df, str(tmp_path / "csv"), brackets=True)
    assert {r.id for r in spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "csv")).collect()} == {"(1)", "(2)"}
    tables.export_table(df, str(tmp_path / "html"), "html")
    assert spark.read.text(str(tmp_path / "html")).where(F.col("value").startswith("<tr><td>")).count() == 2
    tables.export_table(df, str(tmp_path / "txt"), "txt", "|")
    assert "1|a|2.5" in {r.value for r in spark.read.text(str(tmp_path / "txt")).collect()}
    tables.export_table(df, str(tmp_path / "xml"), "xml")
    assert spark.read.format("xml").option("rowTag", "row").load(str(tmp_path / "xml")).count() == 2
    points = spark.createDataFrame([("g", 1, 0.0, 1.0, 2.0), ("h", 2, 3.0, 4.0, 5.0)], tables.POINTS)
    tables.write_points(points, str(tmp_path / "poi"), F.col("group") == "g")
    assert [tuple(r) for r in tables.read_points(spark, str(tmp_path / "poi")).collect()] == [("g", 1, 0.0, 1.0, 2.0)]
    tables.save_series(points, str(tmp_path / "series"), "group")
    assert tables.load_series(spark, str(tmp_path / "series"), ("id",)).count() == 2
    assert tables.not_yet_written(df, df.where("id = 1"), "id").count() == 1
    name = spark.range(1).select(tables.file_name(F.lit("f"), F.lit(12), F.lit(3)).alias("n"), *[c.alias(a) for a, c in zip("se", tables.stem_and_extension(F.lit("a.b.vti")), strict=True)]).first()
    assert tuple(name) == ("f_iT0000012_iC00003", "a.b", "vti")


def test_binary_records(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.vc").write_bytes(struct.pack("<i6f", 2, 1, 2, 3, 4, 5, 6) + struct.pack("<i3f", 1, 7, 8, 9))
    assert [tuple(r)[1:] for r in tables.read_vortices(spark, str(tmp_path / "v")).orderBy("line", "i").collect()] == [(0, 0, 1.0, 2.0, 3.0), (0, 1, 4.0, 5.0, 6.0), (1, 0, 7.0, 8.0, 9.0)]
    assert [r.value for r in volumes.raw_values(spark, str(tmp_path / "v")).orderBy("i").limit(4).collect()] == [2, 0, 0, 0]


def test_synthetic(spark):
    assert synthetic.channel_flow(spark, 8).agg(F.max("u0")).first()[0] <= 1.0
    p = synthetic.particles(spark, 50, 3)
    assert p.count() == 150 and p.repartition(7).exceptAll(p).count() == 0


def test_live(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text("2024-01-01 00:10:00,k,1.5\n2024-01-01 00:50:00,k,2.5\n")
    stream = live.watch(spark, str(source), "ts timestamp, k string, v double")
    live.continuous_save(stream, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    query = live.running_windows(stream, "ts", "v", "k").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r)[1:] for r in spark.sql("select * from windows").collect()] == [("k", 2, 4.0, 1.5, 2.5)]


def test_image_pieces_and_multiblock(spark, tmp_path):
    f = synthetic.shell(spark, 9, 3.0)
    files = volumes.write_volume(f, str(tmp_path / "out.pvti"), (9, 9, 9), "f8", "pvti", slab=4)
    assert len(files) == 3 and all(x.endswith(".vti") for x in files)
    for path, wanted in ((str(tmp_path / "out.pvti"), 729), (files[1], 243)):
        back = volumes.read_volumes(spark, [path], name="v").select("x", "y", "z", F.col("v").alias("w"))
        assert f.join(back, ["x", "y", "z"]).where("v = w").count() == wanted
    assert volumes.read_volumes(spark, [str(tmp_path / "out.pvti")], zmin="4", zmax="4").select("z").distinct().collect() == [(4,)]
    with pytest.raises(ValueError):
        volumes.header(files[0], name="absent")
    with pytest.raises(ValueError):
        headers.vti("a.vti", b'<VTKFile type="ImageData"></VTKFile>')


def test_point_data_image(spark, tmp_path, cube):
    head = '<VTKFile type="ImageData" byte_order="LittleEndian"><ImageData WholeExtent="0 3 0 2 0 4" Spacing="1 1 2" Origin="0 0 0"><Piece Extent="0 3 0 2 0 4"><PointData><DataArray type="UInt16" Name="a" format="appended" offset="0"/><DataArray type="UInt16" Name="b" format="appended" offset="124"/></PointData></Piece></ImageData><AppendedData encoding="raw">\n_'
    block = struct.pack("<I", 120) + cube.tobytes()
    (tmp_path / "p.vti").write_bytes(head.encode() + block + struct.pack("<I", 120) + (cube + 1).astype("<u2").tobytes() + b"</AppendedData></VTKFile>")
    _same(volumes.read_volumes(spark, [str(tmp_path / "p.vti")]), cube)
    _same(volumes.read_volumes(spark, [str(tmp_path / "p.vti")], name="b"), cube + 1)


def test_url_bruker_and_ensemble(spark, tmp_path, cube):
    scan = tmp_path / "15" / "pdata" / "1"
    scan.mkdir(parents=True)
    (scan / "2dseq").write_bytes(cube.astype("<i2").tobytes())
    (scan / "reco").write_text("##TITLE=x\n##$RECO_byte_order=littleEndian\n##$RECO_size=( 2 )\n4 3\n##$RECO_wordtype=_16BIT_SGN_INT\n##END=\n")
    _same(volumes.read_url(spark, f"{scan}/2dseq?volumeId=0&preferredReader=BrukerVolumeReader"), cube)
    with pytest.raises(ValueError):
        volumes.read_url(spark, f"{scan}/2dseq?preferredReader=OtherReader")
    for member in ("a", "b"):
        (tmp_path / "e" / member).mkdir(parents=True)
        for step in (3, 7):
            (tmp_path / "e" / member / f"rho_{step}.mhd").write_text("NDims = 3\nDimSize = 4 3 5\nElementType = MET_USHORT\nElementDataFile = ../../a.raw\n")
    rows = volumes.read_ensemble(spark, str(tmp_path / "e")).groupBy("member", "time", "field").count().collect()
    assert sorted(map(tuple, rows)) == [(m, t, "rho", 60) for m in "ab" for t in (0, 1)]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        volumes.read_ensemble(spark, str(tmp_path / "none"))


def test_header_of_any_length(spark, tmp_path):
    """A list of 3000 slab files, far beyond the first 64 KiB."""
    for i in range(3000):
        (tmp_path / f"a-rather-long-name-of-a-slab-file-{i:06}.raw").write_bytes(bytes([i % 251]))
    names = "\n".join(f"a-rather-long-name-of-a-slab-file-{i:06}.raw" for i in range(3000))
    (tmp_path / "a.nhdr").write_text(f"NRRD0004\ntype: uchar\ndimension: 3\nsizes: 1 1 3000\nendian: little\nencoding: raw\ndata file: LIST\n{names}\n")
    (tmp_path / "a.mhd").write_text(f"NDims = 3\nDimSize = 1 1 3000\nElementType = MET_UCHAR\nElementDataFile = LIST\n{names}\n")
    for name in ("a.nhdr", "a.mhd"):
        assert len(volumes.header(str(tmp_path / name)).files) == 3000
    got = volumes.read_volumes(spark, [str(tmp_path / "a.nhdr")], zmin="2900").collect()
    assert sorted((r.z, r.v) for r in got) == [(z, float(z % 251)) for z in range(2900, 3000)]
    (tmp_path / "b.mhd").write_text("NDims = 3\nDimSize = 1 1 5\nElementType = MET_UCHAR\nElementDataFile = LIST\na\nb\nc\nd\n")
    with pytest.raises(Exception, match="do not divide"):
        volumes.read_volumes(spark, [str(tmp_path / "b.mhd")]).count()


def test_time_frames(spark, tmp_path, cube):
    both = np.stack([cube, cube + 100]).astype("<u2")
    (tmp_path / "t.nrrd").write_bytes(b"NRRD0004\ntype: ushort\ndimension: 4\nsizes: 4 3 5 2\nkinds: space space space time\nspacings: 1 1 1 0.5\nendian: little\nencoding: raw\n\n" + both.tobytes())
    _same(volumes.read_url(spark, f"{tmp_path}/t.nrrd?timeframe=1&preferredReader=NrrdVolumeReader"), both[1])
    _same(volumes.read_url(spark, f"{tmp_path}/t.nrrd"), both[0])
    with pytest.raises(Exception, match="no time frame"):
        volumes.read_url(spark, f"{tmp_path}/t.nrrd?timeframe=2").count()


@pytest.mark.parametrize("encoding", ["gzip", "text"])
def test_encoded_nrrd(spark, tmp_path, cube, monkeypatch, encoding):
    import gzip

    payload = gzip.compress(cube.tobytes()) if encoding == "gzip" else " ".join(map(str, cube.ravel().tolist())).encode()
    head = f"NRRD0004\ntype: ushort\ndimension: 3\nsizes: 4 3 5\nendian: little\nencoding: {encoding}\n".encode()
    (tmp_path / "b.nrrd").write_bytes(head + b"\n" + payload)
    (tmp_path / "c.gz").write_bytes(payload)
    (tmp_path / "c.nhdr").write_bytes(head + b"data file: c.gz\n")
    for name in ("b.nrrd", "c.nhdr"):
        _same(volumes.read_volumes(spark, [str(tmp_path / name)]), cube)
    assert volumes.read_volumes(spark, [str(tmp_path / "b.nrrd")], zmin="1", zmax="2").select(F.min("z"), F.max("z"), F.min("v")).first() == (1, 2, 12.0)
    monkeypatch.setattr(volumes, "ENCODED_BYTES", 7)
    volume = volumes.header(str(tmp_path / "b.nrrd"))
    assert [s.tolist() for s in volumes._slices(volume, volume.files[0], 3, 2)] == cube[3:].reshape(2, 12).tolist()


def test_headers_with_carriage_returns_and_local_payloads(spark, tmp_path, cube):
    head = "NRRD0004\r\ntype: ushort\r\ndimension: 3\r\nsizes: 4 3 5\r\nendian: little\r\nencoding: raw\r\n"
    (tmp_path / "a.nrrd").write_bytes(head.encode() + b"\r\n" + cube.tobytes())
    (tmp_path / "a.nhdr").write_bytes(head.encode() + b"datafile: ./a.raw\r\n")
    for i, end in enumerate(("\n", "\r\n")):
        head = end.join(["ObjectType = Image", "NDims = 3", "DimSize = 4 3 5", "ElementType = MET_USHORT", "ElementDataFile = LOCAL", ""])
        (tmp_path / f"{i}.mhd").write_bytes(head.encode() + cube.tobytes())
    for name in ("a.nrrd", "a.nhdr", "0.mhd", "1.mhd"):
        _same(volumes.read_volumes(spark, [str(tmp_path / name)]), cube)
