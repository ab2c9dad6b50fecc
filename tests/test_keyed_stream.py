import json
from datetime import datetime, timedelta

from vectorloom.functions.chunkers import FixedSizeChunker
from vectorloom.operators.embedders import LetterEmbedder
from vectorloom.operators.store import DataFrameStore
from vectorloom.streaming.ingest import apply_changes, latest_chunks

START = datetime(2024, 1, 1)
SCHEMA = "id string, content string, version long, at timestamp"


class Feed:
    """A folder that texts arrive in, a file a micro-batch, and a stream from it into a store, run until it has nothing left."""

    def __init__(self, spark, folder, expiry=timedelta(days=10)):
        self.spark, self.folder, self.store, self.expiry, self.n = spark, folder, DataFrameStore(spark), expiry, 0
        (folder / "in").mkdir()

    def put(self, *rows):
        self.n += 1
        lines = [json.dumps({"id": i, "content": t, "version": v, "at": (START + timedelta(hours=h)).isoformat()}) for i, t, v, h in rows]
        (self.folder / "in" / f"{self.n:03}.json").write_text("\n".join(lines))

    def run(self):
        texts = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(self.folder / "in"))
        changes = latest_chunks(texts, FixedSizeChunker(2, 0), watermark="2 hours", expiry=self.expiry)
        apply_changes(changes, self.store, LetterEmbedder(), str(self.folder / "checkpoint")).awaitTermination()
        return {r["id"]: r["content"] for r in self.store.frame.collect()}


def test_versions_replays_and_late_texts(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.put(("a", "one two three four five", 3, 0), ("b", "bee", 1, 0), ("a", "older in the same batch", 2, 0), (None, "nobody", 1, 0))
    feed.put(("a", "one two three four five", 3, 1), ("a", "came after a newer one", 2, 1), ("b", None, 0, 1))  # replayed, and older
    assert feed.run() == {"a#0": "one two", "a#1": "three four", "a#2": "five", "b#0": "bee"}
    feed.put(("a", "six seven", 4, 2), ("b", "bee is again now x", 2, 2))
    assert feed.run() == {"a#0": "six seven", "b#0": "bee is", "b#1": "again now", "b#2": "x"}  # stale chunks are gone
    feed.put(("b", None, 3, 3), ("c", "later", 1, 30))
    assert feed.run() == {"a#0": "six seven", "c#0": "later"}
    feed.put(("a", "too late", 9, 5))  # behind the watermark
    assert feed.run() == {"a#0": "six seven", "c#0": "later"}
    feed.put(("a", "eight", 9, 31))
    assert feed.run() == {"a#0": "eight", "c#0": "later"}


def test_what_is_known_of_an_id_expires(spark, tmp_path):
    feed = Feed(spark, tmp_path, timedelta(hours=24))
    feed.put(("a", "first", 5, 0), ("b", "bee", 5, 0))
    feed.put(("b", "bee", 5, 20))
    feed.put(("x", "x", 1, 40))  # the watermark passes the expiry of a, not of b
    feed.put(("x", "x", 2, 41))
    feed.put(("a", "anew", 1, 42), ("b", "old", 1, 42))
    held = feed.run()
    assert held["a#0"] == "anew" and held["b#0"] == "bee"
