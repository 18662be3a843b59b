"""Headers of volume formats: what a plan needs to know before any voxel is read."""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Volume:
    """Layout of a raw payload: cells in x-fastest order, ``channels`` interleaved."""

    shape: tuple[int, int, int]
    dtype: str
    files: list[str]
    offset: int = 0
    channels: int = 1
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    scale: float = 1.0
    shift: float = 0.0
    start: tuple[int, int, int] = (0, 0, 0)
    frames: int = 1
    encoding: str = "raw"
    skip: int = 0
    meta: dict[str, str] = field(default_factory=dict)

    @property
    def slice_bytes(self) -> int:
        return self.shape[0] * self.shape[1] * self.channels * np.dtype(self.dtype).itemsize


#: Type names of the formats (fixed by them) as numpy types.
NRRD_TYPES = {"uchar": "u1", "unsigned char": "u1", "uint8": "u1", "signed char": "i1", "int8": "i1", "short": "i2", "int16": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "float": "f4", "double": "f8"}
NRRD_ENCODINGS = {"raw": "raw", "gz": "gzip", "gzip": "gzip", "txt": "text", "text": "text", "ascii": "text"}
MET_TYPES = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
VVD_TYPES = {"uint8": "u1", "int8": "i1", "uint16": "u2", "int16": "i2", "uint32": "u4", "int32": "i4", "float": "f4", "double": "f8"}
DAT_TYPES = {"UCHAR": "u1", "USHORT": "u2", "FLOAT": "f4", "UINT8": "u1", "UINT16": "u2"}
VTK_TYPES = {"Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Float32": "f4", "Float64": "f8"}
BRUKER_TYPES = {"_8BIT_UNSGN_INT": "u1", "_16BIT_SGN_INT": "i2", "_32BIT_SGN_INT": "i4", "_32BIT_FLOAT": "f4"}
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def _beside(path: str, name: str) -> str:
    return name if name.startswith("/") or "://" in name else f"{path.rpartition('/')[0]}/{name.removeprefix('./')}"


def _three(values, fill=1) -> tuple:
    values = list(values)[:3]
    return tuple(values + [fill] * (3 - len(values)))


#: The empty line that ends a header, and the line after which the payload follows in the same file.
NRRD_END, MHD_LOCAL = re.compile(rb"\n\r?\n"), re.compile(rb"^ElementDataFile[ \t]*=[ \t]*LOCAL[ \t]*\r?\n", re.M | re.I)


def nrrd(path: str, data: bytes) -> Volume:
    """Attached or detached NRRD with raw, gzip or text encoding; detached lists of slab files are supported."""
    end = NRRD_END.search(data)
    head, payload = (data[: end.start()], end.end()) if end else (data, len(data))
    lines = head.decode("latin-1").splitlines()
    if not lines[0].startswith("NRRD"):
        raise ValueError(f"{path} is no NRRD file")
    keys: dict[str, str] = {}
    files: list[str] = []
    listed = False
    for line in lines[1:]:
        if listed:
            files.append(_beside(path, line.strip()))
        elif not line.startswith("#") and ":" in line:
            key, _, value = line.partition(":")
            keys[key.strip().lower().replace(" ", "")] = value.lstrip("= ").strip()
            listed = key.strip().lower().replace(" ", "") == "datafile" and value.strip().startswith("LIST")
    encoding = NRRD_ENCODINGS.get(keys.get("encoding", "raw").lower())
    if encoding is None:
        raise ValueError(f"{path}: encoding {keys['encoding']} is not read")
    sizes = list(map(int, keys["sizes"].split()))
    frames = sizes.pop() if len(sizes) > 3 and keys.get("kinds", "").lower().split()[-1:] == ["time"] else 1
    channels = sizes.pop(0) if len(sizes) == 4 else 1
    order = ">" if keys.get("endian") == "big" else "<"
    spacing = [float(s) for s in keys.get("spacings", "").split() if s.lower() != "nan"]
    name = keys.get("datafile")
    if not files:
        files = [_beside(path, name)] if name else [path]
    return Volume(_three(sizes), order + NRRD_TYPES[keys["type"].lower()], files, 0 if name else payload, channels, _three(spacing[:3] if frames > 1 else spacing[-3:], 1.0), frames=frames, encoding=encoding, meta=keys)


def mhd(path: str, data: bytes) -> Volume:
    """MetaIO header with a payload file of its own, a list of slab files, or the payload behind it."""
    local = MHD_LOCAL.search(data)
    data = data[: local.end()] if local else data
    keys: dict[str, str] = {}
    files: list[str] = []
    for line in data.decode("latin-1").splitlines():
        key, eq, value = line.partition("=")
        if eq:
            keys[key.strip()] = value.strip()
        elif line.strip():
            files.append(_beside(path, line.strip()))
    order = ">" if keys.get("ElementByteOrderMSB", keys.get("BinaryDataByteOrderMSB", "False")).lower() == "true" else "<"
    if not files:
        files = [path if local else _beside(path, keys["ElementDataFile"])]
    return Volume(_three(map(int, keys["DimSize"].split())), order + MET_TYPES[keys["ElementType"]], files, local.end() if local else int(keys.get("HeaderSize", 0)), int(keys.get("ElementNumberOfChannels", 1)), _three(map(float, keys.get("ElementSpacing", "").split()), 1.0), _three(map(float, keys.get("Offset", "").split()), 0.0), meta=keys)


def vvd(path: str, data: bytes) -> Volume:
    """XML header with a raw payload beside it; real-world mapping in the header."""
    root = ET.fromstring(data)
    raw = root.find(".//RawData")
    dims = raw.find("dimensions")
    spacing, mapping = root.find(".//spacing"), root.find(".//RealWorldMapping")
    form = raw.get("format", "uint8")
    vector = re.fullmatch(r"Vector(\d)\((\w+)\)", form)
    axes = lambda node, default: tuple(float(node.get(a, default)) for a in "xyz") if node is not None else (float(default),) * 3
    return Volume(tuple(int(dims.get(a)) for a in "xyz"), "<" + VVD_TYPES[vector[2] if vector else form], [_beside(path, raw.get("filename"))], int(raw.get("offset", 0)), int(vector[1]) if vector else 1, axes(spacing, 1), axes(root.find(".//offset"), 0), float(mapping.get("scale", 1)) if mapping is not None else 1.0, float(mapping.get("offset", 0)) if mapping is not None else 0.0)


def dat(path: str, data: bytes) -> Volume:
    """``Key: value`` header naming a raw file."""
    keys = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in data.decode("latin-1").splitlines()) if v}
    spacing = keys.get("SliceThickness", "1 1 1").split()
    return Volume(_three(map(int, keys["Resolution"].split())), "<" + DAT_TYPES[keys.get("Format", "UCHAR").upper()], [_beside(path, keys["ObjectFileName"])], 0, 1, _three(map(float, spacing)), meta=keys)


def nifti(path: str, data: bytes) -> Volume:
    """NIfTI-1 single file, or the header of an Analyze pair."""
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    dim = struct.unpack(order + "8h", data[40:56])
    kind = struct.unpack(order + "h", data[70:72])[0]
    spacing = struct.unpack(order + "8f", data[76:108])[1:4]
    start, slope, inter = struct.unpack(order + "3f", data[108:120])
    single = data[344:348] == b"n+1\0"
    return Volume(_three(dim[1 : dim[0] + 1]), order + NIFTI_TYPES[kind], [path if single else path.rsplit(".", 1)[0] + ".img"], int(start) if single else 0, 1, tuple(map(float, spacing)), scale=slope or 1.0, shift=inter if slope else 0.0, frames=max(1, dim[4]) if dim[0] > 3 else 1)


def synth2d(path: str, data: bytes) -> Volume:
    """Fixed struct header: magic[4], version, name[256], wrap, size, channels, bytes per channel."""
    magic, _, _, _, size, channels, width = struct.unpack("<4si256s?3xiii", data[:280])
    if not magic.strip(b"\0"):
        raise ValueError(f"{path} has no magic number")
    return Volume((size, size, size), {1: "<u1", 2: "<u2", 4: "<f4"}[width], [path], 280, channels)


def tuv(path: str, data: bytes) -> Volume:
    """Three 16-bit sizes, then 16-bit cells."""
    return Volume(struct.unpack("<3H", data[:6]), "<u2", [path], 6)


def nifti_header(shape: tuple[int, int, int], dtype: str, spacing: tuple[float, float, float]) -> bytes:
    """The header of a NIfTI-1 single file; cells follow at byte 352."""
    head = bytearray(352)
    kind = next(k for k, v in NIFTI_TYPES.items() if v == dtype)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, kind, 8 * np.dtype(dtype).itemsize)
    struct.pack_into("<8f", head, 76, 1, *spacing, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head)


def vti(path: str, data: bytes, name: str | None = None) -> Volume:
    """Image data with raw appended payload: the named array, or the first one; cells keep their place in the whole extent."""
    head, marker, _ = data.partition(b"<AppendedData")
    if not marker:
        raise ValueError(f"{path}: only appended data is read")
    root = ET.fromstring(head + b"</VTKFile>")
    payload = data.index(b"_", data.index(b">", len(head))) + 1
    if root.get("compressor"):
        raise ValueError(f"{path}: compressed data is not read")
    if b'encoding="raw"' not in data[len(head) : payload]:
        raise ValueError(f"{path}: only raw encoding is read")
    image, piece = root.find("ImageData"), root.find(".//Piece")
    for kind, points in (("CellData", 0), ("PointData", 1)):
        for array in piece.findall(f"{kind}/DataArray"):
            if name in (None, array.get("Name")):
                extent = list(map(int, piece.get("Extent").split()))
                shape = tuple(high - low + points for low, high in zip(extent[::2], extent[1::2], strict=True))
                order = ">" if root.get("byte_order") == "BigEndian" else "<"
                length = 8 if root.get("header_type") == "UInt64" else 4
                axes = lambda key, default: tuple(map(float, image.get(key, default).split()))
                return Volume(shape, order + VTK_TYPES[array.get("type")], [path], payload + int(array.get("offset")) + length, int(array.get("NumberOfComponents", 1)), axes("Spacing", "1 1 1"), axes("Origin", "0 0 0"), start=tuple(extent[::2]))
    raise ValueError(f"{path} has no array {name}")


def parts(path: str, data: bytes) -> list[str]:
    """Files that a partitioned image (pvti) or a multiblock file (vtm) consists of, in order."""
    root = ET.fromstring(data)
    found = root.iter("Piece") if extension(path)[1].lower() == "pvti" else root.iter("DataSet")
    key = "Source" if extension(path)[1].lower() == "pvti" else "file"
    return [_beside(path, node.get(key)) for node in found]


def bruker(path: str, reco: bytes, size: int) -> Volume:
    """Reconstructed scanner data: sizes and type from the parameter file beside it, slices from the length."""
    keys = dict(re.findall(r"##\$(\w+)=(?:\([^)]*\)\s*)?([^\n#]*)", reco.decode("latin-1")))
    flat = _three(map(int, keys["RECO_size"].split()))
    order = ">" if keys.get("RECO_byte_order", "").strip() == "bigEndian" else "<"
    kind = order + BRUKER_TYPES[keys["RECO_wordtype"].strip()]
    return Volume((flat[0], flat[1], size // (flat[0] * flat[1] * np.dtype(kind).itemsize)), kind, [path], meta=keys)


READERS = {"nrrd": nrrd, "nhdr": nrrd, "mhd": mhd, "vvd": vvd, "dat": dat, "nii": nifti, "hdr": nifti, "vol": synth2d, "tuv": tuv, "vti": vti}
#: Reader names of URLs and the formats they stand for.
READER_NAMES = {"NrrdVolumeReader": "nrrd", "MhdVolumeReader": "mhd", "VvdVolumeReader": "vvd", "DatVolumeReader": "dat", "AnalyzeVolumeReader": "nii", "Synth2dReader": "vol", "TUVVolumeReader": "tuv", "VTIVolumeReader": "vti", "BrukerVolumeReader": "2dseq"}


def extension(name: str) -> tuple[str, str]:
    """(stem, extension) about the last dot; without a dot the extension is empty."""
    stem, dot, ext = name.rpartition(".")
    return (stem, ext) if dot else (name, "")


def read_header(path: str, data: bytes, reader: str | None = None, name: str | None = None) -> Volume:
    """The layout of a file, by its extension or a given reader; ``name`` picks an array where a file has several."""
    ext = reader or extension(path)[1].lower()
    if ext not in READERS:
        raise ValueError(f"no reader for .{ext}")
    return vti(path, data, name) if ext == "vti" else READERS[ext](path, data)
