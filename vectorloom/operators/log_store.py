"""A document store as a log of changes over a base, in files that all executors share.

Rows live in buckets by the hash of their id. A change appends a segment: the new rows, or tombstones for ids that go, in the
folders of their buckets and nothing else, so it costs what it brings and not what is there. Of rows that repeat an id within a
change the last counts; that too is settled when they are read. Reading merges: base rows whose
id no later segment has, and of the rest the last version that is not a tombstone. :meth:`compact` writes the merged rows of
the buckets that changed as new base rows and leaves the other buckets' files as they are.

What counts is said by a version: a small folder, written whole after its segment, that lists the segments and which of their
buckets are current. A reader sees the newest complete version; what a failed writer leaves is in no version. Two
writers that start from the same version cannot both commit: the second finds its number taken. :meth:`vacuum` deletes the
files that the newest version does not name.
"""

from __future__ import annotations

import random
import threading
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vectorloom.errors import InvalidConfig
from vectorloom.functions.metadata import MetadataFilter
from vectorloom.operators import search
from vectorloom.operators.store import VectorStore
from vectorloom.types import DOCUMENT, DistanceMetric

BUCKETS = 64
COMPACT_AFTER = 16  # segments of changes
BROADCAST_ROWS = 1_000_000  # ids of changed rows that are sent to every task; beyond that base rows are shuffled by id
_ROW = "id string, content string, metadata map<string,string>, embedding array<float>, version long, seq long, deleted boolean"
_SEGMENT = "segment long, version long, base boolean, buckets array<int>, n long, of int"


class Segment(NamedTuple):
    """Rows written together: ``version`` wrote them, ``buckets`` are those of it that still count, ``n`` rows in all, ``of`` so
    many buckets."""

    segment: int
    version: int
    base: bool
    buckets: list[int]
    n: int
    of: int


class LogStore(VectorStore):
    """The store below ``path``; made there if there is none. ``buckets`` is fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, metric: DistanceMetric = DistanceMetric.COSINE, buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER):
        if buckets < 1 or compact_after < 1:
            raise InvalidConfig("there must be a bucket, and a segment before each compaction")
        self.spark, self.path, self._metric, self.compact_after = spark, path.rstrip("/"), metric, compact_after
        self._lock = threading.RLock()
        if self.version() < 0:
            self._commit(0, [Segment(-1, 0, True, [], 0, buckets)])
        self.buckets = self._segments()[0].of

    @property
    def metric(self) -> DistanceMetric:
        return self._metric

    def dimension(self) -> int | None:
        """No dimension is enforced, so none is known."""
        return None

    # Versions and segments

    def _names(self, folder: str, mark: str = "") -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/*{mark}")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where)
        return [(f.getPath().getParent() if mark else f.getPath()).getName() for f in found or []]

    def version(self) -> int:
        """The newest complete version; -1 where there is no store."""
        return max((int(name) for name in self._names("versions", "/_SUCCESS")), default=-1)

    def _segments(self) -> list[Segment]:
        rows = self.spark.read.schema(_SEGMENT).json(f"{self.path}/versions/{self.version()}").collect()
        return sorted((Segment(*r) for r in rows), key=lambda s: (s.version, s.segment))

    def _commit(self, version: int, segments: list[Segment]) -> None:
        rows = self.spark.createDataFrame([tuple(s) for s in segments], _SEGMENT)
        rows.coalesce(1).write.json(f"{self.path}/versions/{version}")  # fails if another writer has taken the number

    def _bucket(self, id: Column) -> Column:
        return F.pmod(F.xxhash64(id), F.lit(self.buckets)).cast("int")

    def _written(self, rows: DataFrame, version: int, base: bool) -> Segment:
        """``rows`` (of _ROW) as a segment; large buckets become several files, small ones share a task."""
        number = random.getrandbits(62)
        target = f"{self.path}/rows/segment={number}"
        rows.withColumn("bucket", self._bucket(F.col("id"))).hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(target)
        counts = self.spark.read.schema(f"{_ROW}, bucket int").parquet(target).groupBy("bucket").count().collect()  # a row a bucket
        return Segment(number, version, base, sorted(r["bucket"] for r in counts), sum(r["count"] for r in counts), self.buckets)

    def _rows(self, segments: list[Segment], only: Iterable[int] | None = None) -> DataFrame:
        """The current rows of some segments, in all buckets or some; folders of others are not read."""
        wanted = None if only is None else set(only)
        here = F.lit(False)
        for s in segments:
            buckets = [b for b in s.buckets if wanted is None or b in wanted]
            if buckets:
                here = here | ((F.col("segment") == s.segment) & F.col("bucket").isin(buckets))
        if not self._names("rows"):
            return self.spark.createDataFrame([], f"{_ROW}, segment long, bucket int")
        return self.spark.read.schema(f"{_ROW}, segment long, bucket int").parquet(f"{self.path}/rows").filter(here)

    def _merged(self, segments: list[Segment], only: Iterable[int] | None = None) -> DataFrame:
        """Rows (of _ROW) as they are, in all buckets or some."""
        names = [c.split()[0] for c in _ROW.split(", ")]
        changes = [s for s in segments if not s.base]
        base = self._rows([s for s in segments if s.base], only).select(*names)
        if not changes:
            return base
        later = self._rows(changes, only)
        last = later.groupBy("id").agg(F.max_by(F.struct(*names), F.struct("version", "seq")).alias("row")).select("row.*")
        ids = later.select("id").distinct()
        ids = F.broadcast(ids) if sum(s.n for s in changes) <= BROADCAST_ROWS else ids
        return base.join(ids, "id", "left_anti").unionByName(last.filter("not deleted"))

    @property
    def frame(self) -> DataFrame:
        """The documents as they are now."""
        return self._merged(self._segments()).select(*DOCUMENT.names)

    # Changes

    def add(self, document: Row) -> None:
        self.add_batch([document])

    def add_batch(self, documents: DataFrame | Iterable[Row]) -> None:
        """Insert or overwrite by id. Within the batch the last row of an id wins: the last of the given rows, or of a
        DataFrame that with the highest ``seq`` if it has such a column (else any one).
        """
        if not isinstance(documents, DataFrame):
            rows = [r.asDict() for r in documents]
            documents = self.spark.createDataFrame([(r["id"], r["content"], r.get("metadata") or {}, r.get("embedding"), i) for i, r in enumerate(rows)], "id string, content string, metadata map<string,string>, embedding array<float>, seq long")
        new = documents if "seq" in documents.columns else documents.withColumn("seq", F.monotonically_increasing_id())
        self._append(new.select("id", "content", "metadata", "embedding", F.col("seq").cast("long").alias("seq"), F.lit(False).alias("deleted")))

    def _append(self, new: DataFrame) -> None:
        with self._lock:
            segments, version = self._segments(), self.version() + 1
            new = new.withColumn("version", F.lit(version).cast("long"))
            segment = self._written(new.select(*[c.split()[0] for c in _ROW.split(", ")]), version, False)
            if not any(s.buckets for s in segments):  # a first load whose ids differ is a base as it is
                ids = self._rows([segment]).groupBy("id").count()
                segment = segment._replace(base=ids.filter("count > 1").isEmpty())
            if segment.n:
                self._commit(version, [*segments, segment])
            if sum(not s.base for s in [*segments, segment]) >= self.compact_after:
                self.compact()

    def delete(self, id: str) -> bool:
        return self.delete_batch([id]) > 0

    def delete_batch(self, ids: DataFrame | Iterable[str]) -> int:
        """Remove rows by id; the number of rows that were there. Only the buckets of these ids are read."""
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(i,) for i in ids], "id string")
        ids = ids.select("id").distinct()
        with self._lock:
            buckets = [r[0] for r in ids.select(self._bucket(F.col("id"))).distinct().collect()]
            before, segments = self.version(), self._segments()
            gone = self._merged(segments, buckets).select("id").join(ids, "id", "left_semi")
            nothing = [F.lit("").alias("content"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(None).cast("array<float>").alias("embedding")]
            self._append(gone.select("id", *nothing, F.lit(0).cast("long").alias("seq"), F.lit(True).alias("deleted")))
            return sum(s.n for s in self._history(before))

    def _history(self, before: int) -> list[Segment]:
        """The segment that the version after ``before`` brought, if there is one."""
        rows = self.spark.read.schema(_SEGMENT).json(f"{self.path}/versions/{before + 1}") if self.version() > before else None
        return [Segment(*r) for r in rows.filter(F.col("version") == before + 1).collect()] if rows is not None else []

    def clear(self) -> None:
        with self._lock:
            self._commit(self.version() + 1, [Segment(-1, 0, True, [], 0, self.buckets)])

    def compact(self) -> None:
        """Merge the changes into the base, in the buckets that have changes."""
        with self._lock:
            segments, version = self._segments(), self.version() + 1
            touched = {b for s in segments if not s.base for b in s.buckets}
            if not touched:
                return
            merged = self._written(self._merged(segments, touched), version, True)
            kept = [s._replace(buckets=[b for b in s.buckets if b not in touched]) for s in segments if s.base]
            self._commit(version, [*(s for s in kept if s.buckets or s.segment == -1), merged])

    def vacuum(self) -> int:
        """Delete the segments that the newest version does not name, and older versions; how many segments went. Readers of older
        versions lose their files.
        """
        with self._lock:
            newest, named = self.version(), {f"segment={s.segment}" for s in self._segments()}
            gone = [n for n in self._names("rows") if n.startswith("segment=") and n not in named]
            for name in [f"rows/{n}" for n in gone] + [f"versions/{v}" for v in self._names("versions") if int(v) < newest]:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            return len(gone)

    # Reading

    def search(self, query: list[float], k: int) -> DataFrame:
        return self.search_with_filter(query, k, MetadataFilter())

    def search_with_filter(self, query: list[float], k: int, where: MetadataFilter, prefilter: bool = False) -> DataFrame:
        return search.top_k_filtered(self.frame, query, k, where, self._metric, prefilter)

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        return search.top_k_documents(self.frame, queries, k, self._metric)

    def get(self, id: str) -> Row | None:
        """One document: the files of its bucket are read, and of these the row groups that may have the id."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(id))).first()[0]
        row = self._rows(self._segments(), [bucket]).filter(F.col("id") == id).orderBy(F.desc("version"), F.desc("seq")).head()
        return None if row is None or row["deleted"] else Row(**{n: row[n] for n in DOCUMENT.names})

    def list(self, limit: int, offset: int = 0) -> DataFrame:
        """A page in order of the last change, then of the place in its batch, then id."""
        if limit < 0 or offset < 0:
            raise InvalidConfig("limit and offset must not be negative")
        return self._merged(self._segments()).orderBy("version", "seq", "id").offset(offset).limit(limit).select(*DOCUMENT.names)

    def count(self) -> int:
        return self._merged(self._segments()).count()

    def is_empty(self) -> bool:
        return self._merged(self._segments()).isEmpty()
