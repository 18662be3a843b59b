"""Plot tables, points, geometry and other records: readers and writers over Spark's own formats."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "`group` string, id long, x double, y double, z double"


def export_table(df: DataFrame, path: str, fmt: str = "csv", sep: str = ";", brackets: bool = False, precision: int | None = None) -> None:
    """CSV, TXT, XML or HTML, one file per partition; values optionally in brackets or with fixed decimals."""

    def shown(c: str) -> Column:
        text = F.format_number(c, precision) if precision is not None and dict(df.dtypes)[c] == "double" else F.col(c).cast("string")
        return F.concat(F.lit("("), text, F.lit(")")) if brackets else text

    if fmt == "xml":
        df.write.format("xml").option("rowTag", "row").save(path)
    elif fmt == "html":
        df.select(F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *[F.coalesce(shown(c), F.lit("")) for c in df.columns]), F.lit("</td></tr>")).alias("value")).write.text(path)
    elif fmt == "txt":
        df.select(F.concat_ws(sep, *[F.coalesce(shown(c), F.lit("")) for c in df.columns]).alias("value")).write.text(path)
    else:
        df.select(*[shown(c).alias(c) for c in df.columns]).write.option("sep", sep).option("header", True).csv(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of interest; the schema is given, so nothing is scanned to infer it."""
    return spark.read.schema(POINTS).option("header", True).csv(path)


def write_points(points: DataFrame, path: str, only: Column | None = None) -> None:
    (points if only is None else points.where(only)).select("group", "id", "x", "y", "z").write.option("header", True).csv(path)


def save_series(df: DataFrame, path: str, *partitions: str) -> None:
    """Field plots, time series, similarity matrices, ensembles: Parquet, partitioned by member, step or level."""
    df.write.partitionBy(*partitions).parquet(path)


def load_series(spark: SparkSession, path: str, least: tuple[str, ...] = ()) -> DataFrame:
    """A stored table; columns that must not be empty are checked before it is used."""
    df = spark.read.parquet(path)
    for column in least:
        if df.select(column).isEmpty():
            raise ValueError(f"{path} has no {column}")
    return df


#: Categories of sample points: a name, a default position, and the file of its texture.
SAMPLE_POINTS = "name string, position struct<x: double, y: double, z: double>, texture string"


def read_sample_points(spark: SparkSession, path: str) -> DataFrame:
    """Categories of sample points from JSON lines; a record that does not fit raises."""
    return spark.read.schema(SAMPLE_POINTS).option("mode", "FAILFAST").json(path)


def point_info(template: str, *columns: Column) -> Column:
    """A line of text about each point: a format string (%s, %d, %.2f, ...) over its columns; null values read "null"."""
    return F.format_string(template, *columns)


def save_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def constant_text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "value string")


def not_yet_written(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without an output: makes a conversion that was broken off continue where it stopped."""
    return inputs.join(outputs.select(key), key, "left_anti")


def file_name(name: Column, step: Column, block: Column) -> Column:
    """name_iT0000012_iC00003."""
    return F.concat(name, F.lit("_iT"), F.lpad(step.cast("string"), 7, "0"), F.lit("_iC"), F.lpad(block.cast("string"), 5, "0"))


def stem_and_extension(path: Column) -> tuple[Column, Column]:
    """Text before and after the last dot; the extension is empty without one."""
    dotted = path.contains(".")
    return F.when(dotted, F.regexp_extract(path, r"^(.*)\.[^.]*$", 1)).otherwise(path), F.when(dotted, F.regexp_extract(path, r"\.([^.]*)$", 1)).otherwise("")


def packed_cells(value: Column) -> Column:
    """A field's values as text for XML payloads."""
    return F.base64(value.cast("binary"))


def read_vortices(spark: SparkSession, path: str) -> DataFrame:
    """Binary corelines as (path, line, i, x, y, z): per line an int32 count and that many float32 triples."""
    files = spark.read.format("binaryFile").load(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = line = 0
                while at < len(data):
                    (count,) = struct.unpack_from("<i", data, at)
                    points = struct.iter_unpack("<3f", data[at + 4 : at + 4 + 12 * count])
                    rows += [{"path": name, "line": line, "i": i, "x": p[0], "y": p[1], "z": p[2]} for i, p in enumerate(points)]
                    at += 4 + 12 * count
                    line += 1
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("line", pa.int32()), ("i", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())]))

    return files.select("path", "content").mapInArrow(decode, "path string, line int, i int, x double, y double, z double")
