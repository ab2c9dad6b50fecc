"""Whole files as single texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.types import put, empty_metadata


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """(content, source, metadata), one row per file."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("source"))
    return rows.select("content", "source", put(empty_metadata(), "path", F.col("source")).alias("metadata"))


def extracted(df: DataFrame, content: str, source: str) -> DataFrame:
    """Any rows as extracted documents with no metadata."""
    return df.select(F.col(content).alias("content"), F.col(source).alias("source"), empty_metadata().alias("metadata"))
