import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.errors import InvalidConfig
from vectorloom.operators import graph, search
from vectorloom.operators.graph import NeighbourGraph
from vectorloom.types import DistanceMetric as M

SMALL = "/root/testdata/sf0.001/embeddings.parquet"


def recall(spark, docs, queries, found, k, metric):
    told = {(r["query_id"], r["id"]) for r in search.top_k_scan(docs, queries, k, metric).collect()}
    return len(told & {(r["query_id"], r["id"]) for r in found.collect()}) / len(told)


@pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the driver's tables")
def test_recall_over_the_embeddings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "ENTRIES", 8)  # far from most vectors, so that walks have to walk
    docs = spark.read.parquet(SMALL).select(F.col("vec_id").alias("id"), "embedding")
    index = NeighbourGraph.build(docs, str(tmp_path / "graph"))
    queries = docs.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    assert recall(spark, docs, queries, index.search_batch(queries, 10), 10, M.COSINE) >= 0.9
    degrees = index.links.select(F.size("near")).agg(F.max("size(near)"), F.min("size(near)")).first()
    assert degrees[0] <= 2 * graph.DEGREE and degrees[1] >= 1


@pytest.mark.parametrize("metric", [M.EUCLIDEAN, M.MANHATTAN])
def test_odd_vectors_hubs_and_equal_ones(spark, tmp_path, metric):
    """Equal vectors, one in the middle of all, odd lengths, parts that are no numbers, none at all; odd queries."""
    rng = np.random.default_rng(4)
    vectors = [[float(x) for x in rng.normal(size=6)] for _ in range(500)] + [[0.0] * 6] + [[2.0] * 6] * 150 + [[1.0, 2.0], None, [math.nan] * 6]
    docs = spark.createDataFrame(list(enumerate(vectors)), "id long, embedding array<float>").repartition(3)
    index = NeighbourGraph.build(docs, str(tmp_path / "graph"), metric, degree=8, rounds=2)
    assert index.vectors.count() == 651 and index.others.count() == 2
    assert index.links.agg(F.max(F.size("near"))).first()[0] <= 16
    asked = [vectors[7], [0.1] * 6, [2.0, 2.0, 2.0, 2.0, 2.0, 2.1], [1.0, 2.0]]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query_vec array<float>")
    found = index.search_batch(queries, 5)
    assert recall(spark, docs, queries, found, 5, metric) >= 0.7  # of 150 equal ones any five will do
    rows = {(r["query_id"], r["rank"]): r for r in found.collect()}
    assert rows[0, 1]["id"] == 7 and rows[0, 1]["score"] == 1.0 and rows[2, 1]["id"] >= 501
    with pytest.raises(InvalidConfig):
        index.search_batch(queries, -1)
    with pytest.raises(InvalidConfig):
        NeighbourGraph.build(docs, str(tmp_path / "none"), degree=0)


def test_rounds_send_no_table_through_the_driver(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)], "id long, embedding array<float>")
    plans, keep = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    index = NeighbourGraph.build(docs, str(tmp_path / "graph"), rounds=1)
    monkeypatch.setattr(graph.search, "asked_vectors", lambda queries: pytest.fail("the batch came to the driver"))
    index.search_batch(docs.limit(5).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec")), 3).collect()
    assert len(plans) > 5 and not any("BroadcastHashJoin" in p for p in plans)


def test_estimates_are_not_squared_from_round_to_round(spark, tmp_path, monkeypatch):
    """Spark estimates a plan's size in a number of any length, on the driver: a state joined with itself doubles its digits."""
    rng = np.random.default_rng(7)
    docs = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)], "id long, embedding array<float>")
    index = NeighbourGraph.build(docs, str(tmp_path / "graph"), rounds=0)
    monkeypatch.setattr(graph, "OPENED", 1)
    monkeypatch.setattr(graph, "MOST_ROUNDS", 8)
    bits, keep = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: bits.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()) or keep(df))
    queries = docs.limit(5).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    assert index.search_batch(queries, 3).count() == 15
    assert len(bits) == 11 and max(bits) < 200 * len(bits), bits


def test_an_empty_graph(spark, tmp_path):
    index = NeighbourGraph.build(spark.createDataFrame([], "id long, embedding array<float>"), str(tmp_path / "graph"))
    assert not index.search_batch(spark.createDataFrame([(0, [1.0])], "query_id long, query_vec array<float>"), 3).collect()
