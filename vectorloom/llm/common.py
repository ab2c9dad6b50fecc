"""What the training-data operators share: word rules, shared storage and small column helpers."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space and word classes of the operators' contracts.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_RUN = r"[^\x20\x09-\x0D]+"

MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a fresh local one only where that is unset (tests)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isEmpty() and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="vectorloom-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results, wherever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and keep it in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def as_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def count_words(text: Column) -> Column:
    """Number of words (runs of anything but ASCII white space); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RUN)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signed(x: int) -> int:
    """A 64-bit pattern as the signed value Spark's LONG holds."""
    return x - (1 << 64) if x >> 63 else x


def private_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has, for columns added for a while."""
    prefix = "_loom"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def release_memory() -> None:
    """Give memory that is free back to the system: Python workers live on, and share a machine with the executor."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where there is no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A task's function over batches that gives memory back at the task's end."""

    @wraps(run)
    def tidied(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidied
