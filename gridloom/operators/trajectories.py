"""Tracks, corelines and sampled series in long form: one row per point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import CELL, cell_components, track_statistics


def step_durations(tracks: DataFrame, track: str, time: str, out: str = "lasts") -> DataFrame:
    """Time from each point of a track to its next one; null at the last."""
    return tracks.withColumn(out, F.lead(time).over(Window.partitionBy(track).orderBy(time)) - F.col(time))


def migration_scores(tracks: DataFrame, track: str, time: str, coordinates: Sequence[str] = CELL) -> DataFrame:
    """Per track its statistics, the mean speed, and directness: displacement over path length (null without a path)."""
    stats = track_statistics(tracks, track, time, coordinates)
    return stats.withColumns({"speed": F.try_divide("length", "duration"), "directness": F.try_divide("displacement", "length")})


def track_points(lines: DataFrame, line: str, points: str = "points") -> DataFrame:
    """An array of points per line as rows (line, i, the point's fields)."""
    return lines.select(line, F.posexplode(points).alias("i", "p")).select(line, "i", "p.*")


def corelines(points: DataFrame, least: int = 2, diagonal: bool = True) -> DataFrame:
    """Solution cells linked to lines: (x, y, z, line) of the components of at least ``least`` cells."""
    labelled = cell_components(points, diagonal).withColumnRenamed("label", "line")
    long = labelled.groupBy("line").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("line")
    return labelled.join(long, "line", "left_semi").select(*CELL, "line")


def sample_series(field: DataFrame, points: DataFrame, point: str, time: str, value: str) -> DataFrame:
    """(point, time, value) of a time-dependent field at sample points, each at its nearest cell.

    Points are keyed by cell, so the field is joined once for all time steps.
    """
    at = points.select(point, *[F.rint(c).cast("int").alias(c) for c in CELL])
    return field.join(at, list(CELL)).select(point, time, value)
