"""Volume files as cell tables: a Python data source that plans from headers and reads slabs, and slab-wise writers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from urllib.parse import parse_qs

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom import storage

from . import headers
from .headers import Volume, read_header

#: Bytes of a header that are read at a time, bytes from which on a file cannot be all header, and bytes of a slab of
#: slices that one task reads.
HEADER_BYTES, HEADER_LIMIT, SLAB_BYTES = 1 << 16, 1 << 30, 32 << 20
#: Bytes of slab files that are joined at a time, and of a compressed or text payload that are decoded at a time.
JOIN_BYTES, ENCODED_BYTES = 8 << 20, 1 << 20
#: Where the header ends in formats whose payload may follow in the same file; others are all header.
HEADER_ENDS = {"nrrd": headers.NRRD_END, "nhdr": headers.NRRD_END, "mhd": headers.MHD_LOCAL, "vti": re.compile(rb"<AppendedData[^>]*>[^_]*_")}
#: Formats whose header is a struct of fixed size within the first bytes.
STRUCTS = ("nii", "hdr", "vol", "tuv")


def _head(source, kind: str) -> bytes:
    """A file's bytes as far as its header goes."""
    data = bytearray()
    while chunk := source.read(HEADER_BYTES):
        data += chunk
        if kind in STRUCTS or (kind in HEADER_ENDS and HEADER_ENDS[kind].search(data, max(0, len(data) - len(chunk) - 4096))):
            break
        if len(data) > HEADER_LIMIT:
            raise ValueError(f"no end of the header within {HEADER_LIMIT} bytes")
    return bytes(data)


def header(path: str, reader: str | None = None, name: str | None = None) -> Volume:
    if (reader or path.rpartition("/")[2]) == "2dseq":
        with storage.open_random(path) as source:
            return headers.bruker(path, storage.read_bytes(path.rpartition("/")[0] + "/reco"), source.size())
    with storage.open_random(path) as source:
        return read_header(path, _head(source, reader or headers.extension(path)[1].lower()), reader, name)


def files_of(path: str) -> list[str]:
    """The volume files behind a path: itself, or the parts that a partitioned or multiblock file lists."""
    if headers.extension(path)[1].lower() not in ("pvti", "vtm"):
        return [path]
    return [file for part in headers.parts(path, storage.read_bytes(path)) for file in files_of(part)]


class Slab(InputPartition):
    def __init__(self, path: str, volume: Volume, first: int, last: int):
        self.path, self.volume, self.first, self.last = path, volume, first, last


class VolumeReader(DataSourceReader):
    """Partitions are slabs of z slices; a file may consist of several payload files of equal slices."""

    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.format, self.name = options.get("reader"), options.get("name")
        self.first = int(options.get("zmin", 0))
        self.last = int(options["zmax"]) + 1 if "zmax" in options else None
        self.mapped = options.get("realworld", "true").lower() == "true"
        self.frame = int(options.get("timeframe", 0))

    def partitions(self) -> list[Slab]:
        out = []
        for path in [file for p in self.paths for file in files_of(p)]:
            volume = header(path, self.format, self.name)
            step = max(1, SLAB_BYTES // max(1, volume.slice_bytes))
            per_file = -(-volume.shape[2] // len(volume.files))
            if -(-volume.shape[2] // per_file) != len(volume.files):
                raise ValueError(f"{path}: {volume.shape[2]} slices do not divide into {len(volume.files)} files")
            if not 0 <= self.frame < volume.frames:
                raise ValueError(f"{path} has no time frame {self.frame}")
            volume.offset += self.frame * volume.slice_bytes * volume.shape[2] if volume.encoding == "raw" else 0
            volume.skip = self.frame * volume.shape[2]
            if volume.encoding != "raw":  # such files are read from their start: one task each
                step = per_file
            last = min(volume.shape[2], self.last - volume.start[2] if self.last is not None else volume.shape[2])
            z = max(0, self.first - volume.start[2])
            while z < last:
                end = min(last, z + step, (z // per_file + 1) * per_file)
                out.append(Slab(path, volume, z, end))
                z = end
        return out

    def read(self, slab: Slab) -> Iterator[pa.RecordBatch]:
        v = slab.volume
        nx, ny, nz = v.shape
        per_file = -(-nz // len(v.files))
        for i, cells in enumerate(_slices(v, v.files[slab.first // per_file], slab.first % per_file, slab.last - slab.first)):
            cells = cells.astype(np.float64)
            if self.mapped:
                cells = cells * v.scale + v.shift
            n = nx * ny * v.channels
            place = np.arange(n) // v.channels
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([slab.path] * n, pa.string()),
                    pa.array((v.start[0] + place % nx).astype(np.int32)),
                    pa.array((v.start[1] + place // nx).astype(np.int32)),
                    pa.array(np.full(n, v.start[2] + slab.first + i, np.int32)),
                    pa.array((np.arange(n) % v.channels).astype(np.int32)),
                    pa.array(cells),
                ],
                names=["volume", "x", "y", "z", "c", "v"],
            )


def _slices(v: Volume, file: str, first: int, count: int) -> Iterator[np.ndarray]:
    """The cells of ``count`` slices of a payload file from slice ``first`` on."""
    size = v.slice_bytes // np.dtype(v.dtype).itemsize
    with storage.open_random(file) as source:
        if v.encoding == "raw":
            source.seek(v.offset + first * v.slice_bytes)
            data = np.frombuffer(source.read(count * v.slice_bytes), v.dtype)
            yield from (data[i * size : (i + 1) * size] for i in range(count))
            return
        source.seek(v.offset)
        first += v.skip
        held = np.zeros(0, v.dtype)
        number = 0
        for block in _decoded(source, v):
            held = np.concatenate([held, block])
            while len(held) >= size:
                if first <= number < first + count:
                    yield held[:size]
                held = held[size:]
                number += 1
            if number >= first + count:
                return
    raise ValueError(f"{file} ends in slice {number}")


def _decoded(source, v: Volume) -> Iterator[np.ndarray]:
    """The cells of a compressed or text payload, some MB at a time."""
    unpack = zlib.decompressobj(wbits=31) if v.encoding == "gzip" else None
    rest = b""
    while chunk := bytes(source.read(ENCODED_BYTES)):
        if unpack:
            while chunk:
                data = rest + unpack.decompress(chunk, 8 * ENCODED_BYTES)
                chunk = unpack.unconsumed_tail
                whole = len(data) // np.dtype(v.dtype).itemsize * np.dtype(v.dtype).itemsize
                yield np.frombuffer(data[:whole], v.dtype)
                rest = data[whole:]
        else:
            *numbers, rest = re.split(rb"[\s,]+", rest + chunk)
            yield np.array([n for n in numbers if n], float).astype(v.dtype)
    if rest and not unpack:
        yield np.array([rest], float).astype(v.dtype)


class VolumeSource(DataSource):
    """``spark.read.format("gridloom_volume")``: NRRD, MHD, VVD, DAT, NIfTI/Analyze, Synth2D, TUV,
    VTI and Bruker.

    Options: path (several separated by commas), zmin, zmax (slices that need not be read are not), realworld, reader (a
    format instead of the extension), name (the array of a file with several), timeframe (the volume of a file with
    several, from 0).
    """

    @classmethod
    def name(cls) -> str:
        return "gridloom_volume"

    def schema(self) -> str:
        return "volume string, x int, y int, z int, c int, v double"

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(self.options)


def read_volumes(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    spark.dataSource.register(VolumeSource)
    return spark.read.format("gridloom_volume").options(path=",".join(paths), **options).load()


def read_volume_list(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A text file with one volume path on each line, relative to it."""
    base = path.rpartition("/")[0]
    names = [line.strip() for line in storage.read_bytes(path).decode().splitlines() if line.strip()]
    return read_volumes(spark, [n if n.startswith("/") or "://" in n else f"{base}/{n}" for n in names], **options)


def read_url(spark: SparkSession, url: str) -> DataFrame:
    """A volume by URL: ``path?preferredReader=...&timeframe=...&channel=...&name=...``.

    The reader named in the query part decides, else the extension; a channel that is absent or -1 stands for all, a time
    frame that is absent for the first. Asking for a frame that the file lacks raises.
    """
    path, _, query = url.partition("?")
    wanted = {k: v[-1] for k, v in parse_qs(query).items()}
    options = {k: wanted[k] for k in ("name", "timeframe") if k in wanted}
    if "preferredReader" in wanted:
        if wanted["preferredReader"] not in headers.READER_NAMES:
            raise ValueError(f"no reader {wanted['preferredReader']}")
        options["reader"] = headers.READER_NAMES[wanted["preferredReader"]]
    cells = read_volumes(spark, [path], **options)
    channel = int(wanted.get("channel", -1))
    return cells if channel < 0 else cells.where(F.col("c") == channel)


def read_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of a folder tree of volumes, one folder per member and in it one file per time step, in order of names.

    Adds member, time (number of the step in its member) and field (the stem of the file up to its last underscore).
    """
    files = sorted(storage.list_files(folder))
    known = [f for f in files if headers.extension(f)[1].lower() in (*headers.READERS, "pvti")]
    steps: dict[tuple[str, str], int] = {}
    rows = []
    for file in known:
        member, name = file.rsplit("/", 2)[-2:]
        field = headers.extension(name)[0].rpartition("_")[0] or headers.extension(name)[0]
        steps[member, field] = steps.get((member, field), -1) + 1
        rows += [(part, member, steps[member, field], field) for part in files_of(file)]
    if not rows:
        raise ValueError(f"{folder} has no volumes")
    places = spark.createDataFrame(rows, "volume string, member string, time int, field string")
    return read_volumes(spark, known).join(places, "volume").drop("volume")


def metadata(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per volume from its header alone."""
    rows = [(p, *v.shape, v.dtype[1:], v.channels, *map(float, v.spacing), float(v.scale), float(v.shift)) for p, v in ((p, header(p)) for p in paths)]
    return spark.createDataFrame(rows, "volume string, nx int, ny int, nz int, type string, channels int, sx double, sy double, sz double, scale double, shift double")


def write_volume(cells: DataFrame, path: str, shape: tuple[int, int, int], dtype: str = "f4", fmt: str = "nrrd", spacing=(1.0, 1.0, 1.0), slab: int = 16, value: str = "v") -> list[str]:
    """Write a field as slab files of raw cells with one header that lists them (nhdr or mhd), as pieces of an image with
    their own headers (pvti), or in a format that has all cells in one file (nii, vvd, dat); cells that lack are 0.

    Each slab is one group of bounded size. For formats of one file a task joins the slab files, some MB at a time.
    Returns the slab files in order, or the one file of cells.
    """
    nx, ny, nz = shape
    stem = path.rsplit(".", 1)[0]
    slab = -(-nz // -(-nz // slab))  # readers take all files but the last to be equally long
    numbered = cells.select("x", "y", "z", F.col(value).cast("double").alias("v"), F.floor(F.col("z") / slab).cast("int").alias("slab"))
    slabs = cells.sparkSession.range(-(-nz // slab)).select(F.col("id").cast("int").alias("slab"), F.lit(None).cast("int").alias("x"), F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("z"), F.lit(None).cast("double").alias("v"))

    def write(key, block):
        first = int(key[0]) * slab
        data = np.zeros((min(slab, nz - first), ny, nx), np.dtype("<" + dtype))
        block = block[block["x"].notna()]
        data[block["z"].to_numpy(int) - first, block["y"].to_numpy(int), block["x"].to_numpy(int)] = block["v"].to_numpy()
        file = f"{stem}-{int(key[0]):05d}.{'vti' if fmt == 'pvti' else 'raw'}"
        storage.write_bytes(file, _vti_piece(data, first, shape, value, spacing) if fmt == "pvti" else data.tobytes())
        import pandas as pd

        return pd.DataFrame({"slab": [int(key[0])], "file": [file]})

    done = numbered.unionByName(slabs).groupBy("slab").applyInPandas(write, "slab int, file string").orderBy("slab").collect()
    files = [r.file for r in done]
    names = "\n".join(f.rpartition("/")[2] for f in files)
    if fmt in ("nii", "vvd", "dat"):
        whole = path if fmt == "nii" else f"{stem}.raw"
        _join(cells.sparkSession, files, headers.nifti_header(shape, dtype, spacing) if fmt == "nii" else b"", whole)
        if fmt == "nii":
            return [whole]
        raw = whole.rpartition("/")[2]
        if fmt == "vvd":
            kind = next(k for k, v in headers.VVD_TYPES.items() if v == dtype)
            axes = lambda values: " ".join(f'{a}="{v}"' for a, v in zip("xyz", values, strict=True))
            text = f'<?xml version="1.0"?><VolumeData version="1"><Volumes><Volume><RawData filename="{raw}" format="{kind}"><dimensions {axes(shape)}/></RawData><MetaData><MetaItem name="Spacing"><value {axes(spacing)}/></MetaItem></MetaData></Volume></Volumes></VolumeData>'
        else:
            kind = next(k for k, v in headers.DAT_TYPES.items() if v == dtype)
            text = f"ObjectFileName:\t{raw}\nResolution:\t{nx} {ny} {nz}\nSliceThickness:\t{' '.join(map(str, spacing))}\nFormat:\t{kind}\n"
        storage.write_bytes(path, text.encode())
        return [whole]
    if fmt == "mhd":
        kind = {v: k for k, v in (("MET_UCHAR", "u1"), ("MET_SHORT", "i2"), ("MET_USHORT", "u2"), ("MET_INT", "i4"), ("MET_FLOAT", "f4"), ("MET_DOUBLE", "f8"))}[dtype]
        text = f"ObjectType = Image\nNDims = 3\nDimSize = {nx} {ny} {nz}\nElementSpacing = {' '.join(map(str, spacing))}\nElementType = {kind}\nElementDataFile = LIST\n{names}\n"
    elif fmt == "pvti":
        kind = next(k for k, v in headers.VTK_TYPES.items() if v == dtype)
        pieces = "".join(f'<Piece Extent="0 {nx} 0 {ny} {i * slab} {min(nz, (i + 1) * slab)}" Source="{f.rpartition("/")[2]}"/>' for i, f in enumerate(files))
        text = f'<VTKFile type="PImageData" version="1.0" byte_order="LittleEndian"><PImageData WholeExtent="0 {nx} 0 {ny} 0 {nz}" GhostLevel="0" Origin="0 0 0" Spacing="{" ".join(map(str, spacing))}"><PCellData><PDataArray type="{kind}" Name="{value}"/></PCellData>{pieces}</PImageData></VTKFile>'
    else:
        kind = {"u1": "uchar", "i2": "short", "u2": "ushort", "i4": "int", "f4": "float", "f8": "double"}[dtype]
        text = f"NRRD0004\ntype: {kind}\ndimension: 3\nsizes: {nx} {ny} {nz}\nspacings: {' '.join(map(str, spacing))}\nendian: little\nencoding: raw\ndata file: LIST\n{names}\n"
    storage.write_bytes(path, text.encode())
    return files


def _join(spark: SparkSession, files: list[str], head: bytes, path: str) -> None:
    """One file of a header and the slab files, written by one task; the slab files go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        list(batches)
        with storage.atomic_output(path) as sink:
            sink.write(head)
            for file in files:
                with storage.open_random(file) as source:
                    while block := source.read(JOIN_BYTES):
                        sink.write(block)
        yield pa.RecordBatch.from_pylist([{"file": path}])

    spark.range(1).coalesce(1).mapInArrow(run, "file string").collect()
    for file in files:
        storage.delete(file)


def _vti_piece(data: np.ndarray, first: int, shape: tuple[int, int, int], value: str, spacing) -> bytes:
    """A slab as an image file of its own: header, length of the payload, raw cells."""
    nx, ny, nz = shape
    kind = next(k for k, v in headers.VTK_TYPES.items() if v == data.dtype.str[1:])
    head = (
        f'<?xml version="1.0"?><VTKFile type="ImageData" version="1.0" byte_order="LittleEndian" header_type="UInt64">'
        f'<ImageData WholeExtent="0 {nx} 0 {ny} 0 {nz}" Origin="0 0 0" Spacing="{" ".join(map(str, spacing))}">'
        f'<Piece Extent="0 {nx} 0 {ny} {first} {first + len(data)}"><CellData><DataArray type="{kind}" Name="{value}" format="appended" offset="0"/></CellData></Piece>'
        f'</ImageData><AppendedData encoding="raw">_'
    )
    payload = data.tobytes()
    return head.encode() + len(payload).to_bytes(8, "little") + payload + b"</AppendedData></VTKFile>"


def raw_values(spark: SparkSession, path: str, tasks: int = 10_000) -> DataFrame:
    """Bytes of raw files of any size as (path, i, value), read in ranges by up to ``tasks`` tasks."""
    step = 1 << 20
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("at"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with storage.open_random(name) as source:
                    source.seek(at)
                    part = np.frombuffer(source.read(step), np.uint8).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part)], names=["path", "i", "value"])

    return ranges.repartition(min(tasks, max(1, ranges.count()))).mapInArrow(read, "path string, i long, value int")
