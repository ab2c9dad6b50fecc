import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectorloom.errors import EmbeddingError
from vectorloom.functions.vectors import l2_normalize, similarity, validate_dimensions
from vectorloom.types import DistanceMetric as M

PAIR = "a array<float>, b array<float>"


def scores(spark, metric, pairs, kind="float"):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, " + PAIR)
    return [r["s"] for r in rows.select("i", similarity(metric, F.col("a"), F.col("b"), kind).alias("s")).orderBy("i").collect()]


def expected(metric, a, b):
    n = min(len(a), len(b))
    x, y = np.array(a[:n], float), np.array(b[:n], float)
    if metric is M.COSINE:
        if len(a) != len(b):
            return 0.0
        size = math.sqrt(sum(v * v for v in a)) * math.sqrt(sum(v * v for v in b))
        return float(x @ y) / size if size else 0.0
    if metric is M.DOT_PRODUCT:
        return float(x @ y)
    return 1 / (1 + (math.sqrt(((x - y) ** 2).sum()) if metric is M.EUCLIDEAN else float(np.abs(x - y).sum())))


@pytest.mark.parametrize("metric", list(M))
def test_fixed_cases(spark, metric):
    pairs = [([1, 0, 0], [1, 0, 0]), ([1, 0, 0], [0, 1, 0]), ([1, 2, 3], [4, 5, 6]), ([], [1]), ([], []), ([0, 0], [1, 1]), ([1, 2, 3], [1, 2]), ([100, 0], [1, 0])]
    pairs = [([float(v) for v in a], [float(v) for v in b]) for a, b in pairs]
    assert scores(spark, metric, pairs) == pytest.approx([expected(metric, a, b) for a, b in pairs], abs=1e-6)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.lists(st.floats(-10, 10, width=16), max_size=6)] * 2), min_size=10, max_size=30))
def test_against_model(spark, pairs):
    for metric in M:
        got = scores(spark, metric, pairs, "double")
        assert got == pytest.approx([expected(metric, a, b) for a, b in pairs], abs=1e-6)


def test_nan_stays_nan(spark):
    assert math.isnan(scores(spark, M.DOT_PRODUCT, [([float("nan")], [1.0])])[0])


def test_single_precision_like_sequential_evaluation(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=64).astype(np.float32), rng.normal(size=64).astype(np.float32)
    total = np.float32(0)
    for x, y in zip(a, b, strict=True):
        total = np.float32(total + np.float32(x * y))
    assert scores(spark, M.DOT_PRODUCT, [(a.tolist(), b.tolist())])[0] == float(total)


def test_normalize(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0, 0.0],)], "v array<float>")
    got = [r[0] for r in rows.select(l2_normalize(F.col("v"))).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0, 0, 0]


def test_dimensions(spark):
    frame = lambda sizes: spark.createDataFrame([(i, [1.0] * n) for i, n in enumerate(sizes)], "i int, v array<float>")
    assert validate_dimensions(frame([128] * 3), "v", "i") == 128
    with pytest.raises(EmbeddingError, match=r"Vector 1 has dimension 64 \(expected 128\)"):
        validate_dimensions(frame([128, 64]), "v", "i")
    with pytest.raises(EmbeddingError, match="Empty vector batch"):
        validate_dimensions(frame([]), "v", "i")
