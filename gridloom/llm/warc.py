"""WARC archives of individually compressed records that share a Zstandard dictionary.

A file starts with a skippable frame that holds a dictionary built from the first records of the file; each record is a
Zstandard frame of its own, compressed with it, so that a record can be read at its offset. Pages with equal payloads
become one response and revisit records that refer to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from struct import pack, unpack
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom import storage
from gridloom.session import materialize, new_folder

from .batches import BATCH_BYTES

#: Magic number of the skippable frame with the dictionary (fixed by the format).
DICTIONARY_MAGIC = 0x184D2A5D
#: Payloads shorter than this are always responses.
REVISIT_BYTES = 1000
#: Size of a dictionary, bytes of the records that it is built from, and compression level.
DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 64 << 10, 4 << 20, 3
#: Date of all records: archives of the same pages are then the same files.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes read from an archive at a time, payload bytes of a batch of records, and most tasks that read archives.
READ_BYTES, OUT_BYTES, READ_TASKS = 1 << 16, 8 << 20, 20_000

MANIFEST = T.StructType([T.StructField("file", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row; return the manifest (file, records, bytes).

    The payload is the html in UTF-8 (null: empty). Of payloads of REVISIT_BYTES and more that are equal (same SHA-1 and
    length), rows with the largest id are responses and the others revisit it; null ids are smaller than all others.
    Rows that repeat an id and payload get records of the same kind. Null urls give records without a target URI; very
    long payloads are one record each; an empty table gives no file; other columns are ignored. Files lie in the folder that all executors share.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.length("payload").alias("size"), F.sha1("payload").alias("digest"))
    copies = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = materialize(copies, "page-copies")
    typed = rows.join(copies, ["digest", "size"], "left")
    revisits = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    typed = typed.select("page_id", "url", "digest", F.when(~revisits, F.col("payload")).alias("payload"), F.col("size").cast("long").alias("size"), F.when(revisits, F.col("original")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = f"{folder}/pages-{storage.task_number():06d}.warc.zst"
        records = (_record(*row) for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        first: list[bytes] = []
        size = 0
        for record in records:
            first.append(record)
            size += len(record)
            if size >= SAMPLE_BYTES:
                break
        if not first:
            return
        shared = _dictionary(first)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        count = written = 0
        with storage.atomic_output(file) as sink:
            content = shared.as_bytes()
            sink.write(pack("<II", DICTIONARY_MAGIC, len(content)) + content)
            for group in (first, records):
                for record in group:
                    frame = compressor.compress(record)
                    sink.write(frame)
                    count += 1
                    written += len(frame)
        yield pa.RecordBatch.from_pylist([{"file": file, "records": count, "bytes": written}], pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    # One row for each file, gathered before they are written: not as many small files again.
    return materialize(typed.mapInArrow(write, MANIFEST).repartition(1), "warc-manifest")


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records: trained where they suffice for that, else their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.rstrip(">").rpartition(":")[2]
    return None if number == "none" else int(number)


def _record(page_id: int | None, url: str | None, digest: str, payload: bytes | None, size: int, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; revisits keep the HTTP header, and so the length, of the full payload."""
    kind = "response" if payload is not None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~%|^{}<>\"")))
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block) + len(payload or b"")))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + (payload or b"") + b"\r\n\r\n"


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per record of the files in ``manifest``: RECORDS; the payload of a revisit is null.

    A response's digest and length are computed from its payload and must be those in its headers. There is a task for
    each file, up to READ_TASKS.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                held, size = [], 0
                for record in _frames(file):
                    held.append(_parse(record))
                    size += len(record)
                    if size >= OUT_BYTES:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    files = manifest.select("file")
    return files.repartition(min(READ_TASKS, max(1, files.count()))).mapInArrow(read, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=RECORDS.names)


def _frames(file: str) -> Iterator[bytes]:
    """The records of an archive, one after another."""
    with storage.open_random(file) as source:
        magic, length = unpack("<II", source.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{file} does not start with a dictionary")
        content = source.read(length)
        trained = content[:4] == b"\x37\xa4\x30\xec"
        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
        decompressor = zstandard.ZstdDecompressor(dict_data=shared)
        data = b""
        frame = parts = None
        while True:
            if not data:
                data = source.read(READ_BYTES)
                if not data:
                    break
            if frame is None:
                frame, parts = decompressor.decompressobj(), []
            parts.append(frame.decompress(data))
            data = b""
            if frame.eof:
                data = frame.unused_data
                yield b"".join(parts)
                frame = None
        if frame is not None:
            raise ValueError(f"{file} ends within a record")


def _parse(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what its header says")
    refers_to = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, refers_to, size, digest, payload if kind == "response" else None
