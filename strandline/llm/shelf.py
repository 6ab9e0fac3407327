"""What the operators share: tables between steps, the test tables, batches of texts for Python."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shelf import Shelf, free_name, shared_dir, spread

__all__ = ["Shelf", "free_name", "kept_columns", "lean", "shared_dir", "table", "text_batches"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that fewer tasks than cores would read is dealt to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole documents go to Python in batches of ``rows``, not of Spark's 10,000, unless the session has a setting of its own."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, rows)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, giving memory back to the system after a task: Python workers stay for later tasks and stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return wrapped


def kept_columns(df: DataFrame, made: list[str], keep: list[str] | None = None) -> list[str]:
    """The columns of ``df`` (or ``keep``) without those named like a new one in any case: Spark doesn't tell such names apart."""
    new = {c.lower() for c in made}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
