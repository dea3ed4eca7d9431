"""What workers get and give back: Arrow batches in bounds, memory after a task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch on its way to a worker, however many rows the session would allow: neither side holds much.
BATCH_BYTES = 4 << 20
_PER_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns memory to the system that a worker, which serves many tasks, has no use for."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of the session by BATCH_BYTES, unless it has a bound of its own."""
    if spark.conf.get(_PER_BATCH) == _DEFAULT:
        spark.conf.set(_PER_BATCH, str(BATCH_BYTES))


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    try:
        yield from run(batches)
    finally:
        give_back()


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` in small batches, after which the worker gives its memory back."""
    small_batches(df.sparkSession)
    return df.mapInArrow(partial(tidied, run), schema)


def sliced(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of up to ``most`` bytes, given each row's size; a larger row is alone."""
    ends, start = np.cumsum(sizes.astype(np.int64)), 0
    while start < batch.num_rows:
        used = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, used + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def byte_sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each string or binary; null has none."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
