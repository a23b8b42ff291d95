"""Memory of Python workers, which live on after a task and serve other stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of rows in an Arrow batch, about. The JVM holds one beside its heap for each task, in buffers that double, and the worker another.
#: Buffers up to 4 MB come from the JVM's pool and are used again; larger ones are allocated and freed each time.
BATCH_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at BATCH_BYTES, whatever their rows; a smaller limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Give what this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batch: pa.RecordBatch, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into slices of ``size`` bytes at most, in order; a longer row is a slice of its own."""
    if batch.nbytes <= size or batch.num_rows < 2:
        yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half), size)
    yield from pieces(batch.slice(half), size)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, whose batches go to the JVM in pieces; at its end what it has freed is given back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in run(batches):
                yield from pieces(batch)
        finally:
            release()

    return wrapped


def parts(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts of so many rows and bytes of text, so that a batch is never turned into Python objects as a whole; a longer row is a part of its own."""
    for batch in batches:
        width = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                width += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(width)
        i = 0
        while i < batch.num_rows:
            fits = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, side="right"))
            n = max(1, min(rows, fits - i))
            yield batch.slice(i, n)
            i += n
