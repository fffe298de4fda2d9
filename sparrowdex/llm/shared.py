"""Session helpers of the operators: the session's own ones, batch sizes, tables and parallelism."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import discard, fresh_path, shared_dir, written
from ..session import ship as _ship

__all__ = ["discard", "fresh_path", "give_back", "parallel", "shared_dir", "ship", "table", "written"]

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, which take batches of a size that their memory bears.

    Smaller ones than Spark's 64 MB: what both sides make of a batch is several times its size, and
    they share an executor's memory.
    """
    if spark.conf.get(_BATCH_BYTES) in ("67108864", "67108864b", "64m", "64MB"):
        spark.conf.set(_BATCH_BYTES, "8m")
    _ship(spark)


def give_back() -> None:
    """Give memory that this process has freed back to the system, where its C library can do that.

    A worker outlives its task, and what it keeps then is missing from its executor's next stages.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallel(spark: SparkSession) -> int:
    """Shuffle partitions to use: what the session asks for, or its cores if that is more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
