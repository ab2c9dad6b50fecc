import json
import math
import os
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vectorloom.errors import DocumentNotFound, EmbeddingError, InvalidConfig
from vectorloom.functions.metadata import MetadataFilter
from vectorloom.functions.vectors import similarity
from vectorloom.operators import search
from vectorloom.operators import store as store_module
from vectorloom.operators.ivf import InvertedLists
from vectorloom.operators.shared import shared_path
from vectorloom.operators.store import DataFrameStore, FlatIndex
from vectorloom.types import DOCUMENT
from vectorloom.types import DistanceMetric as M


def doc(id, vector=None, content=None, **metadata):
    return Row(id=id, content=content or id, metadata=metadata, embedding=vector)


def filled(spark, docs, metric=M.COSINE):
    store = DataFrameStore(spark, metric)
    store.add_batch(docs)
    return store


def ids(found):
    return [r["id"] for r in found.collect()]


TRI = [doc("1", [1.0, 0.0, 0.0]), doc("2", [0.0, 1.0, 0.0]), doc("3", [0.9, 0.1, 0.0])]


def test_search_and_edges(spark):
    store = filled(spark, [*TRI, doc("none")])
    assert ids(store.search([1.0, 0.0, 0.0], 2)) == ["1", "3"]
    assert ids(store.search([1.0, 0.0, 0.0], 0)) == []
    assert len(ids(store.search([1.0, 0.0, 0.0], 100))) == 3  # without an embedding: not found, but counted and listed
    assert store.count() == 4 and len(ids(store.list(10))) == 4
    assert store.dimension() is None and store.metric is M.COSINE
    with pytest.raises(InvalidConfig):
        store.search([1.0], -1)


@pytest.mark.parametrize(("metric", "first"), [(M.COSINE, ["A", "D"]), (M.EUCLIDEAN, ["A", "D", "C"]), (M.DOT_PRODUCT, ["A", "C"])])
def test_metric_rankings(spark, metric, first):
    docs = [doc("A", [1.0, 0.0, 0.0]), doc("B", [0.0, 1.0, 0.0]), doc("C", [1.0, 1.0, 0.0]), doc("D", [0.9, 0.1, 0.0])]
    assert ids(filled(spark, docs, metric).search([1.0, 0.0, 0.0], len(first))) == first


def test_ties_by_id_and_nan_last(spark):
    docs = [doc("b", [1.0]), doc("a", [1.0]), doc("n", [math.nan]), doc("z", [-1.0])]
    assert ids(filled(spark, docs, M.DOT_PRODUCT).search([1.0], 9)) == ["a", "b", "z", "n"]


def test_filters(spark):
    docs = [doc("r", [1.0, 0.0, 0.0], category="programming", language="Rust"), doc("p", [0.0, 1.0, 0.0], category="programming", language="Python"), doc("ai", [0.0, 0.0, 1.0], category="AI")]
    store, q = filled(spark, docs), [1.0, 0.0, 0.0]
    found = lambda *pairs: ids(store.search_with_filter(q, 5, MetadataFilter(pairs)))
    assert found(("category", "programming")) == ["r", "p"]
    assert found(("language", "Rust")) == ["r"]
    assert found(("category", "programming"), ("language", "Python")) == ["p"]
    assert found(("no", "x")) == [] and len(found()) == 3
    assert found(("language", "Rust"), ("language", "Python")) == []


def test_filter_comes_after_the_overfetch(spark):
    docs = [doc(f"{i:02}", [1.0 - i / 100, i / 100], kind="a" if i < 8 else "b") for i in range(12)]
    store, b = filled(spark, docs), MetadataFilter().add("kind", "b")
    assert ids(store.search_with_filter([1.0, 0.0], 2, b)) == []  # the eight best are all a
    assert ids(store.search_with_filter([1.0, 0.0], 3, b)) == ["08", "09", "10"]
    assert ids(store.search_with_filter([1.0, 0.0], 2, b, prefilter=True)) == ["08", "09"]


def test_substring(spark):
    docs = [doc("m", [1.0], k="special one"), doc("n", [0.9], k="plain"), doc("bare", [0.8])]
    frame = filled(spark, docs).frame
    assert ids(search.top_k_containing(frame, [1.0], 3, "special")) == ["m"]
    assert sorted(ids(search.top_k_containing(frame, [1.0], 3, ""))) == ["m", "n"]


def test_upsert_delete_clear(spark):
    store = filled(spark, TRI)
    store.add_batch([doc("1", [0.0, 0.0, 1.0], "old"), doc("1", [0.0, 0.0, 1.0], "new")])
    assert store.count() == 3 and store.get("1")["content"] == "new" and store.get("x") is None
    assert store.delete("2") and not store.delete("2")
    assert store.delete_batch(["1", "1", "x"]) == 1 and store.count() == 1
    store.clear()
    assert store.is_empty() and ids(store.search([1.0], 3)) == []


def test_pages(spark):
    store = filled(spark, [doc(f"d{i}", [i / 10, 0.0, 0.0]) for i in range(10)])
    pages = [ids(store.list(3, o)) for o in (0, 3, 6, 9)]
    assert [len(p) for p in pages] == [3, 3, 3, 1] and sum(pages, []) == [f"d{i}" for i in range(10)]


def test_many_changes(spark):
    store = DataFrameStore(spark)
    for i in range(10):
        store.add(doc(str(i), [float(i)]))
    assert store.count() == 10 and ids(store.list(2, 4)) == ["4", "5"]


@pytest.mark.parametrize("metric", list(M))
def test_batch_equals_single_and_blocks(spark, metric):
    docs = [doc(f"{i:04}", [math.cos(i), math.sin(i), i / 500]) for i in range(1100)]
    store = filled(spark, docs, metric)
    asked = [[math.cos(q), math.sin(q * 2), 0.3] for q in range(6)]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query_vec array<float>")
    one = {(q, r["id"]) for q, v in enumerate(asked[:2]) for r in store.search(v, 4).collect()}
    batch = {(r["query_id"], r["id"]) for r in store.search_batch(queries, 4).collect()}
    blocks = {(r["query_id"], r["id"]) for r in search.top_k_blocks(store.frame, queries, 4, metric, block_rows=300, query_rows=2).collect()}
    scan = {(r["query_id"], r["id"]) for r in search.top_k_scan(store.frame, queries, 4, metric).collect()}
    assert batch == blocks == scan and len(batch) == 24 and {p for p in batch if p[0] < 2} == one


@pytest.mark.parametrize("metric", list(M))
def test_ragged_batches(spark, metric):
    docs = [doc(f"{i:02}", [math.sin(i + j) for j in range(1 + i % 4)]) for i in range(40)] + [doc("n", [math.nan]), doc("none")]
    queries = spark.createDataFrame([(0, [1.0, -0.5]), (1, [0.3]), (2, [0.1] * 6)], "query_id long, query_vec array<float>")
    frame = filled(spark, docs, metric).frame
    ways = [search.top_k_batch(frame, queries, 50, metric, "double"), search.top_k_scan(frame, queries, 50, metric, "double")]
    one, two = ({(r["query_id"], r["id"]): r["score"] for r in w.collect()} for w in ways)
    assert one.keys() == two.keys() and len(one) == 3 * 41
    assert all(two[k] == pytest.approx(v, abs=1e-9, nan_ok=True) for k, v in one.items())


@pytest.mark.parametrize("metric", list(M))
def test_batches_give_the_same_rows_whatever_their_size(spark, monkeypatch, metric):
    docs = [doc(f"{i:02}", [round(math.sin(i % 7 + j), 3) for j in range(1 + i % 3)], f"text {i}", kind=str(i % 2)) for i in range(50)] + [doc("n", [math.nan]), doc("none")]
    queries = spark.createDataFrame([(0, [1.0, -0.5]), (1, [0.3]), (2, [0.1] * 6)], "query_id long, query_vec array<float>")
    frame = filled(spark, docs, metric).frame

    def rows(found):
        return {(r["query_id"], r["rank"], r["id"], r["content"], str(r["metadata"]), str(r["embedding"]), round(r["score"], 5) if not math.isnan(r["score"]) else None) for r in found.collect()}

    for k in (4, 60):
        ways = [search.top_k_batch(frame, queries, k, metric, "double"), search.top_k_documents(frame, queries, k, metric, "double")]
        columns, told = ways[0].columns, [rows(w) for w in ways]
        with monkeypatch.context() as m:
            m.setattr(search, "BROADCAST_QUERY_VALUES", 3)
            m.setattr(search, "_QUERY_RUN", 2)
            for way in (search.top_k_batch, search.top_k_documents):
                found = way(frame, queries, k, metric, "double")
                assert found.columns == columns
                told.append(rows(found))
        assert all(t == told[0] for t in told) and len(told[0]) == 3 * min(k, 51)


@pytest.mark.parametrize("scale", [1.0, 1e4])
def test_equal_vectors_are_at_distance_zero(spark, scale):
    docs = [doc(f"{i:03}", [scale * math.sin(i * 7 + j) for j in range(16)]) for i in range(200)]
    store = filled(spark, docs, M.EUCLIDEAN)
    queries = store.frame.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    ways = [search.top_k_scan(store.frame, queries, 3, M.EUCLIDEAN, "double"), search.top_k_blocks(store.frame, queries, 3, M.EUCLIDEAN, 50, 30, "double"), search.top_k_batch(store.frame, queries, 3, M.EUCLIDEAN, "double")]
    told = [{(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in w.collect()} for w in ways]
    for rows in told:
        assert all(id == q and score == 1.0 for (q, rank), (id, score) in rows.items() if rank == 1)
        assert all(rows[at][0] == id and rows[at][1] == pytest.approx(score, rel=1e-13) for at, (id, score) in told[2].items())
    assert all(r["score"] == 1.0 for r in store.search_batch(queries, 1).collect())


@pytest.mark.parametrize("metric", list(M))
def test_scores_that_round_to_the_same_are_ranked_by_id(spark, metric):
    """The later a document, the better its score, by less than six places show; every way keeps the least ids of equals."""
    rows = [(i, [60.0 - i * 1e-5 if metric in (M.EUCLIDEAN, M.MANHATTAN) else 0.5 + i * 1e-9, 0.0 if metric is not M.COSINE else 1.0 - i * 1e-9]) for i in range(400)]
    docs = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query_vec array<double>")
    found = spark.createDataFrame([(i, v) for i, v in rows], "id long, v array<double>").select("id", F.round(similarity(metric, F.col("v"), F.array(F.lit(1.0), F.lit(0.0)), "double"), 6).alias("score"))
    told = [(r["id"], r["score"]) for r in found.orderBy(F.desc("score"), "id").limit(5).collect()]
    lists = InvertedLists.build(docs, shared_path(spark, "lists"), metric, lists=4)
    ways = [w(docs, queries, 5, metric, kind="double", places=6) for w in (search.top_k_batch, search.top_k_scan, search.top_k_blocks, search.top_k_documents)] + [lists.search_batch(queries, 5, kind="double", places=6)]
    for way in ways:
        assert [(r["id"], r["score"]) for r in way.orderBy("rank").collect()] == told
    assert [(r["id"], r["score"]) for r in search.top_k(docs, [1.0, 0.0], 5, metric, "double", 6).collect()] == told


def test_batches_score_no_pair_in_a_join(spark):
    """Only k rows a query leave a task; in single precision too they are what single queries give."""
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(500, 16)).astype(np.float32))], "id long, embedding array<float>")
    queries = docs.filter("id < 4").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    for metric in M:
        found = search.top_k_batch(docs, queries, 3, metric)
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
        got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in found.collect()}
        for q in queries.collect():
            assert [got[q["query_id"], n] for n in (1, 2, 3)] == [(r["id"], r["score"]) for r in search.top_k(docs, q["query_vec"], 3, metric).collect()]


@pytest.mark.parametrize("metric", list(M))
def test_memory_of_a_block_is_bounded(metric):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(20_000, 8)).astype(np.float32), list(rng.normal(size=(600, 8)))
    series, kept = pd.Series(list(x)), search.KeptBest(5, metric, list(range(600)), q)
    tracemalloc.start()
    kept.offer(np.arange(20_000), series)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6


def test_copies_keep_the_least_ids():
    kept = search.KeptBest(3, M.COSINE, ["a", "b"], [np.array([1.0, 0.0]), np.array([0.0, 1.0])])
    for part in (range(5000, 9000), range(5000)):
        kept.offer(np.array(list(part)), pd.Series([np.array([1.0, 1.0])] * len(part)))
    rows = pd.concat(list(kept.frames()))
    assert rows["id"].tolist() == [0, 1, 2, 0, 1, 2]


def test_many_queries_bring_their_documents(spark):
    store = filled(spark, TRI)
    queries = spark.createDataFrame([(i, [1.0, i / 100, 0.0]) for i in range(70)], "query_id long, query_vec array<float>")
    rows = store.search_batch(queries, 2).collect()
    assert len(rows) == 140 and {r["content"] for r in rows} <= {"1", "2", "3"}


def test_save_and_load(spark, tmp_path):
    store = filled(spark, [doc(f"doc_{i}", [1.0], doc_id=str(i)) for i in range(3)])
    path = str(tmp_path / "s.json")
    store.save_to_file(path)
    assert [sorted(d) for d in json.load(open(path))] == [["content", "id", "metadata"]] * 3
    loaded = DataFrameStore.load_from_file(spark, path)
    assert loaded.count() == 3 and loaded.get("doc_1")["metadata"] == {"doc_id": "1"}
    assert ids(loaded.search([1.0], 3)) == []  # embeddings are not kept
    open(path, "w").write("[]")
    assert DataFrameStore.load_from_file(spark, path).count() == 0
    store.save_parquet(str(tmp_path / "p"))
    assert len(ids(DataFrameStore.load_parquet(spark, str(tmp_path / "p")).search([1.0], 3))) == 3


def test_a_saved_array_is_read_by_several_tasks_in_order(spark, tmp_path):
    odd = 'quote " back \\ line\n, comma ,{ [ ] é 𝒳 \t'
    docs = [doc(f"{i:04}", None, f"{odd}{i}", kind=odd, none=None) for i in range(400)]
    store = DataFrameStore(spark)
    store.add_batch(docs)
    path, folder = str(tmp_path / "one.json"), str(tmp_path / "parts.json")
    store.save_to_file(path)
    store.save_to_file(folder, parts=True)
    told = [{"id": d.id, "content": d.content, "metadata": d.metadata} for d in docs]
    assert json.load(open(path)) == told
    assert json.loads("".join(open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if not f.startswith("."))) == told
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for saved in (path, folder):
            loaded = DataFrameStore.load_from_file(spark, saved)
            assert [(r["id"], r["content"], r["metadata"]) for r in loaded.list(1000).collect()] == [(d.id, d.content, d.metadata) for d in docs]
            assert spark.read.text(saved).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "other.json").write_text(json.dumps([*told[:3], told[0] | {"content": "later"}], indent=1))
    assert [(r["id"], r["content"]) for r in DataFrameStore.load_from_file(spark, str(tmp_path / "other.json")).list(9).collect()] == [("0001", docs[1].content), ("0002", docs[2].content), ("0000", "later")]
    DataFrameStore(spark).save_to_file(str(tmp_path / "none.json"))
    assert json.load(open(tmp_path / "none.json")) == [] and DataFrameStore.load_from_file(spark, str(tmp_path / "none.json")).count() == 0


def test_deep_pages_open_their_part_only(spark, monkeypatch):
    monkeypatch.setattr(store_module, "PAGED", 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = filled(spark, [doc(f"{i * 7 % 500:03}", None, f"text {i}") for i in range(500)])
        order = [f"{i * 7 % 500:03}" for i in range(500)]
        for limit, offset in ((5, 0), (9, 0), (10, 120), (300, 100), (20, 490), (5, 500), (0, 30)):
            assert ids(store.list(limit, offset)) == order[offset : offset + limit]
        page = store.list(4, 251)
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
        assert page.select(F.input_file_name()).distinct().count() == 1 < store._listing._rows.select(F.input_file_name()).distinct().count()
        store.delete("007")
        assert ids(store.list(9, 0)) == [i for i in order if i != "007"][:9]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_index(spark):
    index = FlatIndex(spark, M.EUCLIDEAN, capacity=10)
    for d in [doc("A", [0.0, 0.0, 0.0]), doc("B", [0.1, 0.1, 0.1]), doc("C", [10.0, 10.0, 10.0])]:
        index.add(d)
    assert ids(index.search([0.0, 0.0, 0.0], 2)) == ["A", "B"] and ids(index.search([5.0, 5.0, 5.0], 1)) == ["B"]
    assert index.remove("A") and not index.remove("A") and len(index) == 2 and index.dimension() is None
    index.clear()
    assert index.is_empty() and index.metric is M.EUCLIDEAN


def test_errors_show_their_prefix():
    assert str(EmbeddingError("x")) == "Embedding API error: x"
    assert str(InvalidConfig("x")) == "Invalid configuration: x"
    assert str(DocumentNotFound("x")) == "Document not found: x"


def test_topk_plan_has_no_full_sort(spark):
    plan = search.top_k(spark.createDataFrame(TRI, DOCUMENT), [1.0, 0.0, 0.0], 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
