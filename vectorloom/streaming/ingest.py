"""Streams of texts into stored chunks: the batch operators over Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vectorloom.functions.chunkers import Chunker
from vectorloom.operators.embedders import Embedder
from vectorloom.operators.retriever import chunk_rows
from vectorloom.operators.shared import checkpointed
from vectorloom.operators.store import DataFrameStore, VectorStore


def chunk_stream(texts: DataFrame, chunker: Chunker, model: Embedder, text_col: str = "content", id_col: str = "id") -> DataFrame:
    """Chunked and embedded rows of a stream of texts; no state, so every output mode will do."""
    return chunk_rows(texts, chunker, model, text_col, id_col)


def write_stream(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the chunks to Parquet exactly once, for as much as has arrived."""
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(chunks: DataFrame, store: DataFrameStore, checkpoint: str) -> StreamingQuery:
    """Upsert the chunks into a store, a micro-batch at a time; a batch that is replayed overwrites its own rows."""

    def put(batch: DataFrame, _: int) -> None:
        rows = batch.select("id", "content", "metadata", "embedding", F.col("pos").cast("long").alias("seq"))
        store.add_batch(checkpointed(rows))  # the batch is gone once this returns

    return chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# A keyed stream: each text's chunks change once for each of its versions, whatever is replayed or comes late.

_CHANGES = "id string, version long, chunks array<string>, stale int"
_SEEN = "version long, chunks int"


class _Latest(StatefulProcessor):
    """Of each id the newest version and how many chunks it had. Passes a version on if it is newer than all before."""

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", _SEEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, latest = None, 0
        for batch in rows:
            at = batch["version"].to_numpy().argmax()
            latest = max(latest, int(batch["at_ms"].max()))
            if newest is None or batch["version"].iloc[at] > newest[0]:
                newest = (int(batch["version"].iloc[at]), list(batch["chunks"].iloc[at]))
        before = self.seen.get() if self.seen.exists() else (-(1 << 63), 0)
        for timer in list(self.handle.listTimers()):
            latest = max(latest, timer - self.expiry_ms)
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + self.expiry_ms)
        if newest is not None and newest[0] > before[0]:
            self.seen.update((newest[0], len(newest[1])))
            yield pd.DataFrame({"id": [key[0]], "version": [newest[0]], "chunks": [newest[1]], "stale": [max(0, before[1] - len(newest[1]))]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_chunks(texts: DataFrame, chunker: Chunker, text_col: str = "content", id_col: str = "id", version_col: str = "version", time_col: str = "at", watermark: str = "1 hour", expiry: timedelta = timedelta(days=30)) -> DataFrame:
    """A stream of changes (``id``, ``version``, ``chunks``, ``stale``) of a stream of texts: one for each version of a text that is
    newer than all before, where ``stale`` says how many chunks the text has lost at its end.

    Versions that are replayed, or come after a newer one, change nothing. Texts later than the watermark are dropped; what is
    known of an id is forgotten once the watermark is ``expiry`` past its last text, and a text of that id counts as new then.
    State is one row an id. Null ids are left out, null texts have no chunks.
    """
    rows = texts.filter(F.col(id_col).isNotNull()).withWatermark(time_col, watermark)
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(version_col).cast("long").alias("version"), F.unix_millis(time_col).alias("at_ms"), F.col(time_col), F.coalesce(chunker.chunks(F.col(text_col)), F.array().cast("array<string>")).alias("chunks"))
    texts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy("id").transformWithStateInPandas(_Latest(int(expiry.total_seconds() * 1000)), _CHANGES, "Update", "EventTime")


def apply_changes(changes: DataFrame, store: VectorStore, model: Embedder, checkpoint: str) -> StreamingQuery:
    """Bring the changes of :func:`latest_chunks` into a store, a micro-batch at a time: chunks ``<id>#<pos>`` are put, and those
    that a shorter version no longer has are deleted. A batch that is replayed does the same again.
    """

    def put(batch: DataFrame, _: int) -> None:
        batch = checkpointed(batch)  # the batch is gone once this returns
        name = lambda pos: F.concat("id", F.lit("#"), pos.cast("string"))
        stale = batch.filter("stale > 0").select(F.explode(F.sequence(F.size("chunks"), F.size("chunks") + F.col("stale") - 1)).alias("pos"), "id")
        gone = stale.select(name(F.col("pos")).alias("id"))
        chunks = batch.select("id", F.posexplode("chunks").alias("pos", "content"))
        meta = F.create_map(F.lit("document"), F.col("id"))
        rows = chunks.select(name(F.col("pos")).alias("id"), "content", meta.alias("metadata"), model.column(F.col("content")).alias("embedding"), F.col("pos").cast("long").alias("seq"))
        store.add_batch(checkpointed(rows))
        if not gone.isEmpty():
            store.delete_batch(gone)

    return changes.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
