"""Memory of Python workers, which outlive their tasks and share an executor with its JVM."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch on its way to a worker.
BATCH_BYTES = 8 << 20
#: The largest array that freed memory is kept for.
KEPT_BYTES = 32 << 20
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs run meanwhile hand texts to workers in batches of bounded size, however long they are."""
    before = spark.conf.get(_BYTES)
    spark.conf.set(_BYTES, str(most))
    try:
        yield
    finally:
        spark.conf.set(_BYTES, before)


def give_back() -> None:
    """Return freed memory to the system, as far as the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def keep_freed() -> None:
    """Have the C library keep freed memory of this worker, some dozen MB at most, until it is given back.

    Otherwise it may return an array of numbers as soon as it is freed, and to get the next one page by
    page then takes longer than to fill it.
    """
    allow = getattr(ctypes.CDLL(None), "mallopt", None)
    if allow:
        allow(_MMAP_THRESHOLD, KEPT_BYTES)
        allow(_TRIM_THRESHOLD, 2 * KEPT_BYTES)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow that gives memory back when its task ends."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
