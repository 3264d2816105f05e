"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"))), F.lit(0)).cast("long")


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies on a path of the driver only."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give memory that this worker has freed back to the system: idle workers are kept, and count as their executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def lean(run: Callable, rows: int) -> Callable:
    """A function of batches that sees at most so many rows at once and leaves no freed memory behind."""
    def of_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batch.slice(a, rows) for batch in batches for a in range(0, batch.num_rows, rows))
        finally:
            release()
    return of_slices


def tidy(run: Callable) -> Callable:
    """A function of a group's tables that leaves no freed memory behind."""
    def of_group(*tables: pa.Table) -> pa.Table:
        try:
            return run(*tables)
        finally:
            release()
    if run.__code__.co_argcount == 1:  # Spark counts the arguments
        return lambda part: of_group(part)
    return lambda left, right: of_group(left, right)
