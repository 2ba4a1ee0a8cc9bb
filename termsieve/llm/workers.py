"""Memory of the Python workers and of the Arrow batches that go to them."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS, DEFAULT_ROWS = "1000", "10000"
_held: dict[str, object] = {}


def small_batches(spark: SparkSession) -> None:
    """Batches of texts of 1,000 rows instead of Spark's 10,000, unless the session has a number of its own."""
    if spark.conf.get(BATCH, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(BATCH, ROWS)


def hold(name: str, make: Callable[[], object]) -> object:
    """What make gives, made once in this worker and kept until something else is held or let go."""
    if name not in _held:
        let_go()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """Give back what is held, and what the allocators keep for later: workers outlive their tasks."""
    if _held:
        _held.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)
