"""Compressed columns of numbers, so that a shuffle moves few large rows instead of many small ones."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import SparkSession


def pack(values: np.ndarray) -> bytes:
    """A numpy array as zstandard bytes; the reader knows its type."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(blob: bytes, dtype: type | str) -> np.ndarray:
    """The array that ``pack`` was given."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype)


def partitions(spark: SparkSession, units: int, per_task: int) -> int:
    """Buckets for ``units`` of work at ``per_task`` each, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(units) // per_task), 1)


def run_starts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


#: Rows of an Arrow batch while jobs over whole texts run; Spark's default lets a batch of them grow beyond a task's memory.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs run inside use Arrow batches of at most ``rows`` rows; the session's own setting comes back after them."""
    before = spark.conf.get(_ROWS)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, so that few texts at once become Python objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
