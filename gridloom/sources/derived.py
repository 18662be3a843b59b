"""Derived data of volumes: results kept under the hash of a volume and their kind, found again and computed once.

A result lies as Parquet in the shared folder. Whoever asks first claims it by creating a file, which file systems do for
one only; others wait for the result instead of computing it too, in other threads and other applications.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gridloom.session import shared_dir

#: Seconds between looks at a result that someone else computes.
LOOK = 0.2


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(context._jsc.hadoopConfiguration()), found


def files_hash(spark: SparkSession, paths: Sequence[str]) -> str:
    """A hash of a volume's files without reading them: names, lengths and times of change of all files below the paths."""
    found = []
    for path in paths:
        system, root = _file_system(spark, path)
        if system.getFileStatus(root).isFile():
            status = system.getFileStatus(root)
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
            continue
        files = system.listFiles(root, True)
        while files.hasNext():
            status = files.next()
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


def _folder(spark: SparkSession, volume: str, kind: str) -> str:
    return f"{shared_dir(spark)}/gridloom/derived/{hashlib.sha256(json.dumps([volume, kind]).encode()).hexdigest()}"


def _read(spark: SparkSession, folder: str) -> DataFrame | None:
    system, at = _file_system(spark, f"{folder}/_schema")
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return spark.read.schema(T.StructType.fromJson(json.loads(text))).parquet(folder)


def derived(spark: SparkSession, volume: str, kind: str, compute: Callable[[], DataFrame], patience: float = 3600.0) -> DataFrame:
    """The result of a kind for the volume of a hash: read where it is known, else computed and kept.

    ``kind`` says all that the result depends on beside the volume, parameters included. A known result costs no job until
    it is used, and then no scan of the volume. If the one who claimed a result neither finishes nor gives up within
    ``patience`` seconds it is computed here. An error in ``compute`` frees the claim.
    """
    folder = _folder(spark, volume, kind)
    known = _read(spark, folder)
    if known is not None:
        return known
    system, claim = _file_system(spark, f"{folder}.claim")
    system.mkdirs(claim.getParent())
    until = time.monotonic() + patience
    while not system.createNewFile(claim):
        time.sleep(LOOK)
        known = _read(spark, folder)
        if known is not None:
            return known
        if time.monotonic() > until:
            break
    try:
        # Someone may have finished between the first look and the claim.
        known = _read(spark, folder)
        if known is not None:
            return known
        result = compute()
        result.write.mode("overwrite").parquet(folder)
        # The schema comes last, and under its name only when it is written: a folder without it is not a result yet.
        written, final = (_file_system(spark, f"{folder}/{name}")[1] for name in ("_schema.part", "_schema"))
        stream = system.create(written, True)
        try:
            stream.write(bytearray(result.schema.json().encode()))
        finally:
            stream.close()
        system.rename(written, final)
    finally:
        system.delete(claim, False)
    return _read(spark, folder)


def forget(spark: SparkSession, volume: str, kind: str) -> None:
    """Take a result away again."""
    system, folder = _file_system(spark, _folder(spark, volume, kind))
    system.delete(folder, True)
