"""Whole-file access from Spark tasks through Arrow's file systems (local, HDFS, object stores)."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path within it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@contextmanager
def atomic_output(uri: str):
    """A binary sink whose file appears under ``uri`` only when it is complete.

    Each attempt writes to a name of its own and moves it at the end, so retried and speculative tasks never mix.
    """
    system, path = resolve(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with system.open_output_stream(attempt, compression=None) as sink:
            yield sink
        system.move(attempt, path)
    except BaseException:
        if system.get_file_info(attempt).type == fs.FileType.File:
            system.delete_file(attempt)
        raise


def open_random(uri: str):
    """A seekable source: memory-mapped where the file system is local."""
    system, path = resolve(uri)
    if isinstance(system, fs.LocalFileSystem):
        import pyarrow as pa

        return pa.memory_map(path, "r") if system.get_file_info(path).size else pa.BufferReader(b"")
    return system.open_input_file(path)


def write_bytes(uri: str, data: bytes) -> None:
    with atomic_output(uri) as sink:
        sink.write(data)


def delete(uri: str) -> None:
    system, path = resolve(uri)
    system.delete_file(path)


def read_bytes(uri: str) -> bytes:
    system, path = resolve(uri)
    with system.open_input_stream(path, compression=None) as source:
        return source.read()


def list_files(uri: str) -> list[str]:
    """All files below a folder, as paths that the other functions take."""
    system, path = resolve(uri)
    root = uri[: -len(path)] if uri.endswith(path) else ""
    return [root + f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File]


def task_number() -> int:
    """The partition number of the running task (0 outside of Spark)."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


