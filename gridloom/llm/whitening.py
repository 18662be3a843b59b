"""Embedding whitening: Chan's merging of counts, means and centred scatters, then principal components.

Each partition computes count, mean and centred scatter of its rows; pairs of them are merged by

    n = m + k, d = mean_k - mean_m, scatter = scatter_m + scatter_k + d d' m k / n

in a tree of Spark tasks. The driver gets one such triple (a matrix as large as the dimension squared), takes eigenvalues
and eigenvectors, and a second pass over the same rows verifies that their whitened covariance is the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import discard, materialize

from .batches import named
from .vectors import as_longs, exact, fixed_point, matrix, widest

#: Components that rows are projected on; share of the largest eigenvalue below which a direction has no variance.
COMPONENTS, FLAT = 4, 1e-12
#: Merges of a partition's triples on their way to the driver.
DEPTH = 3


class Moments(NamedTuple):
    """Count, mean and centred scatter of some rows, and the exact sums of their integers, in two halves."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int]


def moments(rows: np.ndarray, sums: bool = True) -> Moments:
    """Of one block of rows, centred before multiplying."""
    mean = rows.mean(axis=0, dtype=np.float64)
    centred = rows - mean
    whole = []
    if sums:
        high, low = rows >> 32, rows & 0xFFFFFFFF  # sums of either half of up to 2^31 rows fit a long
        whole = [(int(h) << 32) + int(k) for h, k in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]
    return Moments(len(rows), mean, centred.T @ centred, whole)


def merge(a: Moments, b: Moments) -> Moments:
    """Chan's pairwise formula."""
    if not a.n or not b.n:
        return a if a.n else b
    n = a.n + b.n
    d = b.mean - a.mean
    return Moments(n, a.mean + d * (b.n / n), a.scatter + b.scatter + np.outer(d, d) * (a.n * b.n / n), [x + y for x, y in zip(a.sums, b.sums, strict=True)])


_TRIPLE = T.StructType([T.StructField("n", T.LongType()), T.StructField("mean", T.BinaryType()), T.StructField("scatter", T.BinaryType()), T.StructField("sums", T.ArrayType(T.StringType()))])


def gather(rows: DataFrame, width: int, project: tuple[np.ndarray, np.ndarray] | None = None, column: str = "x") -> Moments:
    """Moments of all rows of a vector column; with ``project`` = (mean, matrix) those of their projections."""
    size = width if project is None else project[1].shape[1]
    none = Moments(0, np.zeros(size), np.zeros((size, size)), [0] * size if project is None else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = none
        for batch in batches:
            if batch.num_rows:
                block = matrix(batch.column(0), width)
                own = merge(own, moments(block) if project is None else moments((block - project[0]) @ project[1], sums=False))
        if own.n:
            yield pa.RecordBatch.from_arrays([pa.array([own.n]), pa.array([own.mean.tobytes()]), pa.array([own.scatter.tobytes()]), pa.array([[str(x) for x in own.sums]], pa.list_(pa.string()))], names=["n", "mean", "scatter", "sums"])

    def read(row) -> Moments:
        return Moments(row.n, np.frombuffer(row.mean), np.frombuffer(row.scatter).reshape(size, size), [int(x) for x in row.sums])

    # One small row from each partition; only these leave the DataFrame, for the tree of merges.
    return rows.select(column).mapInArrow(run, _TRIPLE).rdd.map(read).treeAggregate(none, merge, merge, depth=DEPTH)


class Whitening(NamedTuple):
    """A fitted whitening: rows and exact sums of the fit list, components by falling eigenvalue, and the check."""

    width: int
    n: int
    sums: list[int]
    #: Columns are unit eigenvectors; eigenvalues; their shares of the trace.
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def scales(self) -> np.ndarray:
        """What projections are multiplied by: not a number for directions without variance."""
        with np.errstate(all="ignore"):
            return np.where(self._varied, 1 / np.sqrt(self.values), np.nan)

    @property
    def _varied(self) -> np.ndarray:
        return self.values > FLAT * max(self.values[:1].max(initial=0.0), 1e-300)


def fit(vectors: DataFrame, vector_col: str = "embedding", scale: int = 256) -> Whitening:
    """Fit on every distinct integer vector x = floor(scale * entry) of the table, each once.

    Rows with a null vector, or with null or non-finite entries, take no part. Vectors of different lengths are filled up
    with zeros to the longest. An empty table gives a model of no rows. The verification uses all directions that have
    variance; those without count neither as components with a whitened value nor in the error.
    """
    rows = fixed_point(vectors, vector_col, scale)
    width = widest(rows)
    # Equal after filling up is equal: trailing zeros of shorter vectors are written before rows are told apart.
    full = rows.select(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("x"))
    distinct = materialize(full.distinct(), "whitening-fit")
    try:
        return _fitted(distinct, width)
    finally:
        discard(distinct)


def _fitted(distinct: DataFrame, width: int) -> Whitening:
    total = gather(distinct, width)
    if not total.n or not width:
        return Whitening(width, total.n, total.sums, np.zeros((width, 0)), np.zeros(0), np.zeros(0), 0.0)
    covariance = total.scatter / total.n
    values, axes = np.linalg.eigh(covariance)
    values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1]
    trace = np.trace(covariance)
    model = Whitening(width, total.n, total.sums, axes, values, values / trace if trace > 0 else np.zeros(width), 0.0)
    varied = model._varied
    error = 0.0
    if varied.any():
        mean = np.array([s / total.n for s in total.sums])
        check = gather(distinct, width, (mean, axes[:, varied] * model.scales[varied]))
        error = float(np.abs(check.scatter / check.n - np.eye(int(varied.sum()))).max())
    return model._replace(identity_error=error)


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, components: int = COMPONENTS) -> DataFrame:
    """Per row that takes part and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    ``deviation`` is the exact sum over dimensions of (n x - S)^2, null where it is no long. A component without variance
    has a null ``whitened`` and explains 0. Rows that repeat an id or a vector all stay, null ids too. Where all vectors
    are empty there are no components. The table that is whitened must not hold longer vectors than the one that was fitted.
    """
    width, n, sums = model.width, model.n, model.sums
    count = min(components, len(model.values))
    mean = np.array([s / n for s in sums]) if n else np.zeros(width)
    axes, scales, explained = model.vectors[:, :count], model.scales[:count], model.explained[:count]
    largest = max([abs(s) for s in sums], default=0)
    rows = fixed_point(vectors.select(named(id_col).alias("vec_id"), named(vector_col).alias("vector")), "vector", scale).select("vec_id", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not count:
                continue
            x = matrix(batch.column(1), width)
            top = n * max(int(x.max()), -int(x.min())) + largest
            own = exact(x, max(top * top * width, 1))
            off = own * n - np.array(sums, own.dtype)
            deviation = as_longs((off * off).sum(axis=1))
            projected = (x - mean) @ axes * scales
            for k in range(count):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.full(batch.num_rows, k + 1, np.int32)),
                        pa.array(np.full(batch.num_rows, n, np.int64)),
                        deviation,
                        pa.array(projected[:, k], mask=np.isnan(projected[:, k])),
                        pa.array(np.full(batch.num_rows, explained[k])),
                        pa.array(np.full(batch.num_rows, model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
