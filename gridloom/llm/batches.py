"""Passing text columns through Python in Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch that goes to a Python worker; long texts then come few at a time.
BATCH_BYTES = 4 << 20


def named(column: str) -> Column:
    """A top-level column by its exact name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def release() -> None:
    """Give freed memory back to the system: an idle Python worker lives on beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_texts(
    docs: DataFrame,
    columns: dict[str, str],
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, object]]],
    added: T.StructType,
    keep: list[str],
) -> DataFrame:
    """Add columns that a Python function computes from Arrow batches.

    ``columns`` maps the names that the function sees to columns of ``docs``; ``keep`` lists columns of ``docs`` that
    pass through unseen; an added column takes the place of a kept one of the same name (in any case of letters).
    ``make`` is called once per task and returns the function from a batch to the new columns; what it holds goes with
    the task.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    added_names = [f.name for f in added.fields]
    lower = {n.lower() for n in added_names}
    keep = [c for c in keep if c.lower() not in lower]
    seen = docs.select(*[named(c).alias(f"k{i}") for i, c in enumerate(keep)], *[named(c).alias(f"t{i}") for i, c in enumerate(columns.values())])
    schema = T.StructType([docs.schema[c] for c in keep] + added.fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        try:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                given = pa.RecordBatch.from_arrays([batch.column(len(keep) + i) for i in range(len(columns))], names=list(columns))
                new = function(given)
                arrays = [batch.column(i) for i in range(len(keep))]
                arrays += [x if isinstance(x := new[c], pa.Array) else pa.array(x) for c in added_names]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        finally:
            function = None
            release()

    return seen.mapInArrow(run, schema)


def strings(column: pa.Array) -> list[str]:
    """The texts of a column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]
