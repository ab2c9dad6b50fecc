import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.errors import InvalidConfig
from vectorloom.operators import ivf, search
from vectorloom.operators.ivf import InvertedLists, IvfIndex
from vectorloom.types import DistanceMetric as M

SMALL = "/root/testdata/sf0.001/embeddings.parquet"
DOCS = "id string, content string, metadata map<string,string>, embedding array<float>"


def clustered(n=600, d=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d)) * 3
    return [[float(x) for x in centres[i % 12] + rng.normal(size=d) * 0.4] for i in range(n)]


def frame(spark, vectors):
    return spark.createDataFrame([(f"{i:04}", f"text {i}", {}, v) for i, v in enumerate(vectors)], DOCS).repartition(3)


def found(rows):
    return {(r["query_id"], r["rank"]): (r["id"], None if math.isnan(r["score"]) else round(r["score"], 9)) for r in rows.collect()}


@pytest.mark.parametrize("metric", list(M))
def test_exact_mode_finds_what_a_full_search_finds(spark, tmp_path, metric):
    """With odd vectors among the others, ties, a crowded list of equal vectors, and odd queries."""
    vectors = clustered() + [[0.0] * 8, [math.nan] + [1.0] * 7, [1.0, 2.0], None] + [[1.0] * 8] * 300
    docs = frame(spark, vectors)
    lists = InvertedLists.build(docs, str(tmp_path / "ivf"), metric, lists=15)
    assert len(lists) == len(vectors) - 1
    asked = [*clustered(6, seed=2), [1.0] * 8, [0.0] * 8, [2.0, 1.0], [5.0] * 9, [math.nan] + [1.0] * 7, vectors[5]]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query_vec array<float>")
    for k in (1, 7, 2000):
        told = found(search.top_k_scan(docs, queries, k, metric, "double"))
        got = found(lists.search_batch(queries, k, kind="double"))
        assert got == told
    assert found(lists.search_batch(queries, 5, probes=1000, kind="double")) == found(search.top_k_scan(docs, queries, 5, metric, "double"))


@pytest.mark.parametrize("metric", list(M))
def test_exact_mode_prunes(spark, tmp_path, metric):
    docs = frame(spark, clustered(3000))
    lists = InvertedLists.build(docs, str(tmp_path / "ivf"), metric, lists=40)
    vectors = [np.array(v) for v in clustered(20, seed=1)]
    wanted, floors, spared = lists.plan_exact(vectors, 5)
    assert spared > 0.5 and min(floors) > -math.inf  # share of the pairs that lie in lists out of reach


@pytest.mark.parametrize("metric", list(M))
def test_no_vector_scores_above_its_bound(metric):
    rng = np.random.default_rng(3)
    for scale in (1e-3, 1.0, 1e4):
        x, c, q = rng.normal(size=(50, 6)) * scale, rng.normal(size=6) * scale, rng.normal(size=6) * scale
        if metric is M.COSINE:
            x, q = ivf._unit(x), ivf._unit(q)
        d = ivf.distance_to(metric, x, c)
        for near in (x, x[:1]):
            dn = ivf.distance_to(metric, near, c)
            bound = ivf.highest_score(metric, q, c, dn.min(), dn.max())
            assert (search.exact_scores(metric, near, q) <= bound).all()
        assert d.shape == (50,)


@pytest.mark.parametrize("metric", list(M))
def test_bounds_and_lists_of_many_queries_at_once(spark, tmp_path, metric):
    rng = np.random.default_rng(5)
    q, c = (rng.normal(size=(n, 6)) if metric is not M.COSINE else ivf._unit(rng.normal(size=(n, 6))) for n in (30, 7))
    q[3] = c[2]
    least = rng.random(7) / 2
    most = least + rng.random(7) * 1e-3
    bounds = ivf.highest_scores(metric, q, c, least, most)
    for i in range(30):
        for j in range(7):
            one = ivf.highest_score(metric, q[i], c[j], least[j], most[j])
            assert one - 1e-12 * abs(one) <= bounds[i, j] <= one + 1e-6 * max(1, abs(one))
    lists = InvertedLists.build(frame(spark, clustered()), str(tmp_path / "ivf"), metric, lists=9)
    asked = [np.array(v) for v in clustered(20, seed=3)] + [np.array([1.0])]
    near = lists.nearest(asked, 2, 0)
    assert near.shape == (21, len(lists.sizes)) and (near.sum(1)[:20] == 2).all() and near[20].all()
    assert (lists.nearest(asked, None, 100)[:20] @ np.array([lists.sizes[i][0] for i in lists._real()]) >= 100).all()


@pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("metric", list(M))
def test_recall_of_probes_over_the_embeddings(spark, tmp_path, metric):
    e = spark.read.parquet(SMALL).select(F.col("vec_id").alias("id"), "embedding")
    lists = InvertedLists.build(e, str(tmp_path / "ivf"), metric)
    queries = e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    probes = lists.probes_for()
    assert probes < len(lists.sizes)
    told = {(r["query_id"], r["id"]) for r in search.top_k_scan(e, queries, 10, metric).collect()}
    got = {(r["query_id"], r["id"]) for r in lists.search_batch(queries, 10, probes).collect()}
    assert len(got & told) / len(told) >= 0.9


def test_lists_out_of_reach_are_not_opened(spark, tmp_path):
    docs = frame(spark, clustered())
    lists = InvertedLists.build(docs, str(tmp_path / "ivf"), M.EUCLIDEAN, lists=12)
    plan = lists.frame([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list#\d+ IN \(1,2\)", plan)
    files = lambda df: set(df.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
    assert all("list=1/" in f or "list=2/" in f for f in files(lists.frame([1, 2]))) and len(files(lists.frame())) >= 12


def test_index_that_changes(spark):
    index = IvfIndex(frame(spark, clustered(200)), M.EUCLIDEAN, lists=6)
    far = [50.0] * 8
    row = spark.createDataFrame([("new", "new text", {"a": "b"}, far)], DOCS).first()
    index.add(row)
    assert [r["id"] for r in index.search(far, 1).collect()] == ["new"] and len(index) == 201 and index.dimension() == 8
    index.add_batch(spark.createDataFrame([("0003", "moved", {}, far)], DOCS))
    assert [(r["id"], r["content"]) for r in index.search(far, 2).collect()] == [("0003", "moved"), ("new", "new text")] and len(index) == 201
    assert index.remove("0003") and not index.remove("0003") and len(index) == 200
    again = lambda: [(r["id"], round(r["score"], 6)) for r in index.search(clustered(200)[3], 5).collect()]
    before = again()
    assert "0003" not in dict(before)
    index.rebuild()
    assert again() == before and len(index) == 200
    index.clear()
    assert index.is_empty() and not index.search(far, 3).collect()
    with pytest.raises(InvalidConfig):
        index.search(far, -1)
