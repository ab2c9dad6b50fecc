"""Row types: documents, extracted documents, queries and results; and column constructors for documents."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())
METADATA = T.MapType(T.StringType(), T.StringType())

DOCUMENT = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("metadata", METADATA, False),
        T.StructField("embedding", VECTOR, True),
    ]
)
EXTRACTED = T.StructType(
    [T.StructField("content", T.StringType(), False), T.StructField("source", T.StringType(), False), T.StructField("metadata", METADATA, False)]
)
SAVED = T.StructType(DOCUMENT.fields[:3])
QUERY = T.StructType([T.StructField("query_id", T.LongType(), False), T.StructField("query_vec", VECTOR, False)])


class DistanceMetric(Enum):
    """Similarities; for each of them higher is more alike."""

    COSINE = "cosine"
    EUCLIDEAN = "euclidean"
    DOT_PRODUCT = "dot_product"
    MANHATTAN = "manhattan"


def empty_metadata() -> Column:
    return F.create_map().cast(METADATA)


def put(metadata: Column, key: str, value: str | Column) -> Column:
    """``metadata`` with a key set; a key that is there is replaced. Independent of the session's duplicate-key policy."""
    value = value if isinstance(value, Column) else F.lit(value)
    return F.map_concat(F.map_filter(metadata, lambda k, _: k != key), F.create_map(F.lit(key), value))


def documents(df: DataFrame, content: str = "content", id_col: str | None = None, metadata: Column | None = None, embedding: str | None = None) -> DataFrame:
    """Rows as documents: a random UUID where no id is given, no metadata and no embedding unless given."""
    return df.select(
        (F.col(id_col).cast("string") if id_col else F.expr("uuid()")).alias("id"),
        F.col(content).alias("content"),
        (metadata if metadata is not None else empty_metadata()).alias("metadata"),
        (F.col(embedding) if embedding else F.lit(None)).cast(VECTOR).alias("embedding"),
    )
