"""Python workers' memory: small Arrow batches, and memory that is given back."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession

from .shipping import ship

#: Rows in one Arrow batch: texts may be long, so batches are small.
ARROW_ROWS = 512


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches small, whatever the rows weigh, and see that workers have this package. Plans
    are lazy and the setting is the session's, so no operator makes it larger than another asked for."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on for other jobs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable) -> Callable:
    """A function over batches that gives its memory back when it has seen all of them."""

    @functools.wraps(run)
    def wrapped(batches, *args):
        try:
            yield from run(batches, *args)
        finally:
            release_memory()

    return wrapped
