"""Transfer between particles and cells with a smoothing kernel: every particle has a radius of its own."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import materialize

from .combine import CELL

#: Weights that a task holds at a time (one particle's at least).
HELD = 2_000_000


def cubic_spline(q: np.ndarray) -> np.ndarray:
    """The cubic spline of distance over radius, without its norm: positive below 2."""
    return np.where(q <= 1, 1 - 1.5 * q * q + 0.75 * q**3, np.where(q < 2, 0.25 * (2 - q) ** 3, 0.0))


def footprints(at: np.ndarray, radius: np.ndarray, shape: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells that particles (rows x 3) reach: numbers of particles, cells (rows x 3), and weights that sum to 1 for each.

    A cell stands for its whole coordinates. A kernel that reaches no cell gives all to the nearest one (halves up). With
    ``shape`` only cells of that grid count, and a particle that reaches none of them has no footprint.
    """
    wide = np.maximum(radius, 0.0)[:, None]
    low, high = np.ceil(at - 2 * wide).astype(np.int64), np.floor(at + 2 * wide).astype(np.int64)
    near = np.floor(at + 0.5).astype(np.int64)
    if shape:
        low, high = np.maximum(low, 0), np.minimum(high, np.array(shape) - 1)
    sizes = np.maximum(high - low + 1, 0)
    count = sizes.prod(axis=1)
    owner = np.repeat(np.arange(len(at)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    cells = np.empty((len(owner), 3), np.int64)
    for axis in (2, 1, 0):
        cells[:, axis] = low[owner, axis] + place % sizes[owner, axis]
        place //= sizes[owner, axis]
    with np.errstate(all="ignore"):
        weight = cubic_spline(np.sqrt(((at[owner] - cells) ** 2).sum(axis=1)) / radius[owner])
    reached = (weight > 0) & (radius[owner] > 0)
    owner, cells, weight = owner[reached], cells[reached], weight[reached]
    alone = np.bincount(owner, minlength=len(at)) == 0
    if shape:
        alone &= ((near >= 0) & (near < np.array(shape))).all(axis=1)
    owner, cells, weight = np.concatenate([owner, np.flatnonzero(alone)]), np.concatenate([cells, near[alone]]), np.concatenate([weight, np.ones(alone.sum())])
    total = np.bincount(owner, weights=weight, minlength=len(at))
    return owner, cells, weight / total[owner]


def _spread(particles: DataFrame, radius: str, shape: Sequence[int] | None, keep: Sequence[str]) -> DataFrame:
    """(*keep, x, y, z, _w): a row for each cell that a particle reaches; nothing is shuffled."""
    rows = particles.select(*[F.col(c).cast("double").alias(c) for c in (*CELL, radius)], *keep)
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(c, T.IntegerType()) for c in CELL] + [T.StructField("_w", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            box = np.cumsum((4 * np.maximum(given[:, 3], 0) + 1) ** 3)
            first = 0
            while first < len(given):
                last = max(first + 1, int(np.searchsorted(box, (box[first - 1] if first else 0) + HELD, "right")))
                owner, cells, weight = footprints(given[first:last, :3], given[first:last, 3], shape)
                kept = [batch.column(4 + i).slice(first, last - first).take(pa.array(owner)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(cells[:, k].astype(np.int32)) for k in range(3)], pa.array(weight)], names=schema.names)
                first = last

    return rows.mapInArrow(run, schema)


def to_cells(particles: DataFrame, values: Sequence[str], radius: str, shape: Sequence[int] | None = None) -> DataFrame:
    """(x, y, z, particles, *values): what particles at (x, y, z) leave in each cell; the sum over all cells is kept.

    Sums are partial before the shuffle, so a crowded cell costs each task one row. Particles with a missing
    value leave nothing in the sums of that value; without coordinates or a radius they are left out.
    """
    known = particles.dropna(subset=[*CELL, radius]).select(*CELL, F.col(radius).alias("_radius"), *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])
    spread = _spread(known, "_radius", shape, [f"_v{i}" for i in range(len(values))])
    return spread.groupBy(*CELL).agg(F.count("*").alias("particles"), *[F.sum(F.col(f"_v{i}") * F.col("_w")).alias(v) for i, v in enumerate(values)])


def from_cells(particles: DataFrame, field: DataFrame, values: Sequence[str], key: str, radius: str) -> DataFrame:
    """(key, *values): the field around each particle, averaged with its kernel over the cells that exist; particles
    without such a cell are left out. ``key`` is unique. Particles meet cells by equal coordinates.

    The field is written first, so that Spark knows its size, not that of its source: where it is small, the cells that
    particles reach (dozens each) meet it without a shuffle and are summed where they are, a row for each particle."""
    field = materialize(field.select(*CELL, *values), "field")
    known = particles.dropna(subset=[*CELL, radius]).select(F.col(key).alias("_key"), *CELL, F.col(radius).alias("_radius"))
    met = _spread(known, "_radius", None, ["_key"]).join(field, list(CELL))
    total = F.sum("_w")
    return met.groupBy("_key").agg(*[(F.sum(F.col(v) * F.col("_w")) / total).alias(v) for v in values]).withColumnRenamed("_key", key)
