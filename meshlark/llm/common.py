"""Shared helpers of the training-data operators: tables and the shared folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from meshlark.plans.shared import discard, held, join_counted, materialize, shared_dir

__all__ = ["cleanup", "enter", "held", "holds", "trim", "discard", "join_counted", "materialize", "shared_dir", "shared_path", "table"]


_CACHES: dict[str, Callable[[], object]] = {}


def holds(name: str, clear: Callable[[], object]) -> None:
    """Say how the cache that ``name`` keeps in a Python worker is cleared."""
    _CACHES[name] = clear


def enter(name: str | None) -> None:
    """A task of ``name`` begins in this worker, which other operators may have used: their caches go, and freed memory goes back to the system."""
    for other, clear in _CACHES.items():
        if other != name:
            clear()
    trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/meshlark/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def cleanup(spark: SparkSession) -> None:
    """Delete what this application's operators wrote to the shared folder (results read from there go too)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/meshlark/{spark.sparkContext.applicationId}")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
