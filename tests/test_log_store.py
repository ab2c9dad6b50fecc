import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vectorloom.errors import InvalidConfig
from vectorloom.functions.metadata import MetadataFilter
from vectorloom.operators import log_store
from vectorloom.operators.log_store import LogStore
from vectorloom.operators.store import DataFrameStore
from vectorloom.types import DistanceMetric as M


def doc(id, content="", vector=None, **metadata):
    return Row(id=id, content=content, metadata=metadata, embedding=vector)


def rows(store):
    return sorted((r["id"], r["content"]) for r in store.frame.collect())


def files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_random_changes_agree_with_a_dictionary(spark, tmp_path):
    rng, told = random.Random(7), {}
    store = LogStore(spark, str(tmp_path / "log"), buckets=4, compact_after=5)
    for step in range(14):
        names = [f"d{rng.randrange(30)}" for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.65:
            store.add_batch([doc(n, f"{step}.{i}") for i, n in enumerate(names)])
            told |= {n: f"{step}.{i}" for i, n in enumerate(names)}
        else:
            assert store.delete_batch(names) == len({n for n in names if n in told})
            told = {n: c for n, c in told.items() if n not in names}
        if step % 4 == 3:
            assert rows(store) == sorted(told.items()) and store.count() == len(told)
    store.compact()
    assert rows(store) == sorted(told.items())
    again = LogStore(spark, str(tmp_path / "log"))
    assert again.buckets == 4 and rows(again) == sorted(told.items())
    assert again.vacuum() > 0 and rows(again) == sorted(told.items())


def test_a_change_writes_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "log")
    store = LogStore(spark, path, buckets=16)
    store.add_batch(spark.range(2000).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("text "), 20).alias("content"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(None).cast("array<float>").alias("embedding")))
    store.compact()
    store.vacuum()
    before = files(path)
    store.add(doc("7", "seven"))
    change = {f: n for f, n in files(path).items() if f not in before}
    assert len(change) == 1 and sum(change.values()) < sum(before.values()) / 10
    bucket = next(iter(change)).split("/bucket=")[1].split("/")[0]
    store.compact()
    compacted = [f for f in files(path) if f not in before and f not in change]
    assert compacted and all(f"/bucket={bucket}/" in f for f in compacted)
    assert store.get("7")["content"] == "seven" and store.count() == 2000
    assert store.vacuum() == 1  # the change; the old base still has the other buckets
    assert store.get("7")["content"] == "seven" and store.get("8")["content"].startswith("text") and store.count() == 2000


def test_get_reads_one_bucket(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"), buckets=8)
    store.add_batch([doc(str(i), f"text {i}") for i in range(100)])
    held = store._rows(store._segments(), [3])
    assert all("/bucket=3/" in r[0] for r in held.select(F.input_file_name()).distinct().collect())
    assert store.get("5")["content"] == "text 5" and store.get("nobody") is None
    assert store.delete("5") and not store.delete("5") and store.get("5") is None and store.count() == 99


def test_what_a_failed_writer_left_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "log")
    store = LogStore(spark, path, buckets=2)
    store.add(doc("a", "one"))
    other = LogStore(spark, path)
    segments, version = other._segments(), other.version() + 1
    left = other._written(store._merged(segments).withColumn("content", F.lit("lost")), version, False)  # written, never committed
    os.makedirs(f"{path}/versions/{version + 5}")  # a version without its mark
    assert rows(store) == [("a", "one")] and rows(LogStore(spark, path)) == [("a", "one")]
    store.add(doc("b", "two"))
    with pytest.raises(Exception, match="(?i)exists"):  # another writer took this version's number
        other._commit(version, [*segments, left])
    assert rows(other) == [("a", "one"), ("b", "two")]


def test_it_is_a_store_like_the_other(spark, tmp_path):
    docs = [doc(f"{i:02}", f"text {i}", [float(i % 5), 1.0], kind=str(i % 2)) for i in range(20)] + [doc("none", "no vector")]
    stores = [LogStore(spark, str(tmp_path / "log"), M.EUCLIDEAN, buckets=4), DataFrameStore(spark, M.EUCLIDEAN)]
    queries = spark.createDataFrame([(0, [1.0, 1.0]), (1, [4.0, 0.0])], "query_id long, query_vec array<float>")
    told = []
    for store in stores:
        store.add_batch(docs)
        store.add(doc("03", "changed", [9.0, 9.0]))
        found = [r.asDict() for r in store.search([1.0, 1.0], 4).collect()], [r["id"] for r in store.search_with_filter([1.0, 1.0], 3, MetadataFilter([("kind", "0")])).collect()]
        told.append((found, sorted(map(str, store.search_batch(queries, 3).collect())), [r["id"] for r in store.list(5, 17).collect()], store.get("03"), store.count(), store.metric, store.dimension()))
        store.clear()
        assert store.is_empty() and store.count() == 0 and not store.list(3).collect()
        store.add(doc("new", "again"))
        assert [r["id"] for r in store.list(3).collect()] == ["new"]
    assert told[0] == told[1]
    with pytest.raises(InvalidConfig):
        stores[0].list(-1)
    with pytest.raises(InvalidConfig):
        LogStore(spark, str(tmp_path / "x"), buckets=0)


def test_many_changes_shuffle_instead_of_a_broadcast(spark, tmp_path, monkeypatch):
    store = LogStore(spark, str(tmp_path / "log"), buckets=2)
    store.add_batch([doc(str(i), "a") for i in range(50)])
    store.compact()
    store.add_batch([doc(str(i), "b") for i in range(0, 50, 3)])
    told = rows(store)
    monkeypatch.setattr(log_store, "BROADCAST_ROWS", 3)
    assert rows(store) == told and sum(c == "b" for _, c in told) == 17
