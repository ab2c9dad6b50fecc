"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder that is set already; a fresh local one only where Spark itself runs locally."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="vectorloom-")
    if current.isEmpty():
        sc.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that ends with ``name``."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}-{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed and kept below the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is computed inside hands Python tasks at most so many rows at a time: for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
