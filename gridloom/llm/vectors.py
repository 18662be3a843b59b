"""Vector columns as fixed-point integers, and their blocks as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import named


def fixed_point(vectors: DataFrame, vector_col: str, scale: int, out: str = "x") -> DataFrame:
    """The rows whose vector is neither null nor holds null or non-finite entries, with floor(scale * entry) as longs.

    Products beyond the range of a long stay at its end. An empty vector stays an empty array.
    """
    entries = named(vector_col).cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(entries.isNotNull() & finite).withColumn(out, F.transform(entries, lambda c: _floored(c * float(scale))))


def _floored(product: Column) -> Column:
    """The floor as a long; an overflow to infinity or beyond the longs gives the nearest one."""
    top = float(1 << 63)
    return F.when(product >= top, F.lit((1 << 63) - 1)).when(product < -top, F.lit(-(1 << 63))).otherwise(F.floor(product).cast("long"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list<int64> column as a matrix; shorter ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    sizes, values = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    if (sizes == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return out


def widest(vectors: DataFrame, column: str = "x") -> int:
    """Entries of the longest vector; 0 for an empty table."""
    return vectors.agg(F.max(F.size(column))).first()[0] or 0


def exact(values: np.ndarray, bound: int) -> np.ndarray:
    """Integers on which sums and products below ``bound`` in magnitude are exact: Python's where longs do not hold them."""
    return values if bound < 1 << 63 else values.astype(object)


def as_longs(values: np.ndarray) -> pa.Array:
    """Longs; null where a Python integer does not fit."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([v if -(1 << 63) <= v < 1 << 63 else None for v in values.tolist()], pa.int64())
