"""Shared helpers of the operations: scratch tables and column checks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import delete, drop, materialise, new_path, release, shared_dir, ship, unsent

__all__ = ["SMALL_ROWS", "delete", "drop", "few", "lean", "materialise", "new_path", "release", "remainder", "shared_dir", "ship", "table", "unsent"]

#: Short rows that are broadcast at most; larger tables are joined by a shuffle.
SMALL_ROWS = 1 << 19


def few(df: DataFrame) -> DataFrame:
    """A written table of at most ``SMALL_ROWS`` short rows as the side that a join broadcasts; a larger one as it is."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def lean(run):
    """The Arrow function ``run``, giving what it has freed back to the system at the end of a partition.

    Workers are kept and used again, and several share an executor.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, mod n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
