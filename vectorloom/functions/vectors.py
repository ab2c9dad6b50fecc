"""Similarities and norms of FLOAT arrays as columns.

Sums run in single precision from left to right, so a score is what a sequential evaluation in that precision gives.
Cosine needs equal lengths and is 0 otherwise; the others compare the common prefix. Distances become similarities as
1 / (1 + distance).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.errors import EmbeddingError
from vectorloom.types import VECTOR, DistanceMetric



def vector(values: list[float]) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(v)) for v in values]).cast(VECTOR) if len(values) else F.array().cast(VECTOR)


def _sum(parts: Column, kind: str) -> Column:
    return F.aggregate(parts, F.lit(0.0).cast(kind), lambda total, x: (total + x).cast(kind))


def _paired(a: Column, b: Column, step, kind: str) -> Column:
    """Sum of step(x, y) over the common prefix."""
    n = F.least(F.size(a), F.size(b))
    return _sum(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: step(x.cast(kind), y.cast(kind)).cast(kind)), kind)


def dot_product(a: Column, b: Column, kind: str = "float") -> Column:
    return _paired(a, b, lambda x, y: x * y, kind)


def norm(v: Column, kind: str = "float") -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: (x.cast(kind) * x.cast(kind)).cast(kind)), kind)).cast(kind)


def cosine_similarity(a: Column, b: Column, kind: str = "float") -> Column:
    """0 for vectors of different lengths or of no length."""
    na, nb, zero = norm(a, kind), norm(b, kind), F.lit(0.0).cast(kind)
    return F.when(F.size(a) != F.size(b), zero).when((na == 0) | (nb == 0), zero).otherwise((dot_product(a, b, kind) / (na * nb).cast(kind)).cast(kind))


def euclidean_distance(a: Column, b: Column, kind: str = "float") -> Column:
    return F.sqrt(_paired(a, b, lambda x, y: (x - y) * (x - y), kind)).cast(kind)


def manhattan_distance(a: Column, b: Column, kind: str = "float") -> Column:
    return _paired(a, b, lambda x, y: F.abs(x - y), kind)


def similarity(metric: DistanceMetric, a: Column, b: Column, kind: str = "float") -> Column:
    """The metric's score of two vectors; higher is more alike. ``kind`` is the precision, FLOAT unless DOUBLE is asked for."""
    if metric is DistanceMetric.COSINE:
        return cosine_similarity(a, b, kind)
    if metric is DistanceMetric.DOT_PRODUCT:
        return dot_product(a, b, kind)
    distance = euclidean_distance if metric is DistanceMetric.EUCLIDEAN else manhattan_distance
    return (F.lit(1.0) / (F.lit(1.0) + distance(a, b, kind))).cast(kind)


def l2_normalize(v: Column, kind: str = "float") -> Column:
    """The vector at length one; a zero vector as it is."""
    n = norm(v, kind)
    return F.when(n > 0, F.transform(v, lambda x: (x.cast(kind) / n).cast(kind))).otherwise(v.cast(f"array<{kind}>"))


def validate_dimensions(df: DataFrame, vector_col: str, order_col: str) -> int:
    """The common dimension of a batch of vectors; raises at the first row, in order, that differs from the first of all."""
    sized = df.select(F.col(order_col).alias("at"), F.size(vector_col).alias("d"))
    first = sized.agg(F.min_by("d", "at").alias("d"), F.count("*").alias("n")).first()
    if not first["n"]:
        raise EmbeddingError("Empty vector batch")
    odd = sized.filter(F.col("d") != first["d"]).agg(F.min("at").alias("at"), F.min_by("d", "at").alias("d")).first()
    if odd["at"] is not None:
        place = sized.filter(F.col("at") < F.lit(odd["at"])).count()
        raise EmbeddingError(f"Vector {place} has dimension {odd['d']} (expected {first['d']})")
    return first["d"]
