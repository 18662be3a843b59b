"""Exact Euclidean distance transform, one axis at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import materialize

from .combine import CELL


def lower_envelope(cost: np.ndarray, at: np.ndarray, to: np.ndarray | None = None) -> np.ndarray:
    """min over j of (to[i] - at[j])^2 + cost[j], in linear time over ascending positions; without ``to`` at the same ones."""
    to = at if to is None else to
    finite = np.flatnonzero(np.isfinite(cost))
    if not len(finite):
        return np.full(len(to), np.inf)
    hull: list[int] = []
    breaks: list[float] = []
    for j in finite:
        while hull:
            i = hull[-1]
            cross = ((cost[j] + at[j] ** 2) - (cost[i] + at[i] ** 2)) / (2.0 * (at[j] - at[i]))
            if breaks and cross <= breaks[-1]:
                hull.pop()
                breaks.pop()
                continue
            breaks.append(cross)
            break
        hull.append(j)
    best = np.array(hull)[np.searchsorted(np.array(breaks), to)] if breaks else np.full(len(to), hull[0])
    return (to - at[best]) ** 2 + cost[best]


def distance_transform(field: DataFrame, background: Column, out: str = "distance") -> DataFrame:
    """(x, y, z, distance) of every cell to the nearest background cell, infinite where there is none.

    Each axis is one shuffle by lines: a line is as long as the volume's extent along that axis, never the volume. Cells
    may be missing: lines of background are carried over the whole extent along x, then y, so that distances pass
    through gaps; these rows are at most the volume's bounding box.
    """
    cells = materialize(field.select(*CELL, F.coalesce(background, F.lit(False)).alias("_b")), "cells")
    ends = cells.agg(*[f(c).alias(f"{c}{i}") for c in ("x", "y") for i, f in enumerate((F.min, F.max))]).first()
    rows = cells.where("_b").select(*CELL).distinct().withColumn("_d", F.lit(0.0))
    for axis, others in (("x", ("y", "z")), ("y", ("x", "z"))):
        rows = rows.groupBy(*others).applyInPandas(_carried(axis, ends[f"{axis}0"], ends[f"{axis}1"]), "x int, y int, z int, _d double")
    met = rows.withColumn("_cell", F.lit(False)).unionByName(cells.select(*CELL, F.lit(None).cast("double").alias("_d"), F.lit(True).alias("_cell")))
    return met.groupBy("x", "y").applyInPandas(_met, "x int, y int, z int, _d double").select(*CELL, F.sqrt("_d").alias(out))


def _carried(axis: str, first: int, last: int):
    """A line's distances at every position of the extent."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(axis)
        to = np.arange(first, last + 1)
        near = lower_envelope(block["_d"].to_numpy(), block[axis].to_numpy().astype(float), to.astype(float))
        return pd.DataFrame({c: to if c == axis else block[c].iloc[0] for c in CELL} | {"_d": near})

    return run


def _met(block: pd.DataFrame) -> pd.DataFrame:
    """The cells of a line along z, with their distances from what was carried there."""
    cells, carried = block[block["_cell"]].copy(), block[~block["_cell"]].sort_values("z")
    cells["_d"] = lower_envelope(carried["_d"].to_numpy(), carried["z"].to_numpy().astype(float), cells["z"].to_numpy().astype(float))
    return cells[[*CELL, "_d"]]
