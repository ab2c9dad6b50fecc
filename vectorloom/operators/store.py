"""A keyed collection of documents over DataFrames.

The store holds one immutable DataFrame and swaps it on each change, under a lock, so a reader sees a change whole or
not at all. Rows keep the number of their insertion, so pages are stable. A change joins the rows there are with the new
ones, so many documents are best added in one batch; every eighth change is written to the shared checkpoint folder, so that
plans stay short. A lazy DataFrame is computed anew by each search until then: what is dear to compute (a model's vectors)
is to be written first, as the retriever does.
"""

from __future__ import annotations

import threading
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterable

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.errors import InvalidConfig
from vectorloom.functions.metadata import MetadataFilter
from vectorloom.functions.vectors import cosine_similarity  # noqa: F401
from vectorloom.operators import search
from vectorloom.operators.shared import checkpointed, shared_path
from vectorloom.types import DOCUMENT, SAVED, DistanceMetric

CHECKPOINT_EVERY = 8
PAGED = 10_000  # rows from the start that a page may reach to without a listing
_SEQ, _PART, _PLACE = "_seq", "_part", "_place"
ONE_A_LINE = "[\t\n"  # how an array begins that has one element a line


class VectorStore(ABC):
    """What a store of documents can do."""

    @abstractmethod
    def add(self, document: Row) -> None: ...

    @abstractmethod
    def add_batch(self, documents: DataFrame | Iterable[Row]) -> None: ...

    @abstractmethod
    def search(self, query: list[float], k: int) -> DataFrame: ...

    @abstractmethod
    def search_with_filter(self, query: list[float], k: int, where: MetadataFilter) -> DataFrame: ...

    @abstractmethod
    def search_batch(self, queries: DataFrame, k: int) -> DataFrame: ...

    @abstractmethod
    def get(self, id: str) -> Row | None: ...

    @abstractmethod
    def delete(self, id: str) -> bool: ...

    @abstractmethod
    def delete_batch(self, ids: DataFrame | Iterable[str]) -> int: ...

    @abstractmethod
    def clear(self) -> None: ...

    @abstractmethod
    def list(self, limit: int, offset: int = 0) -> DataFrame: ...

    @abstractmethod
    def count(self) -> int: ...


class Listing:
    """Rows in an order, written as parts by range, with the number of rows before each part."""

    def __init__(self, rows: DataFrame, order: list[str], path: str):
        self._columns, spark = rows.columns, rows.sparkSession
        place = F.monotonically_increasing_id()
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumns({_PART: F.shiftright(place, 33), _PLACE: place.bitwiseAND(F.lit((1 << 33) - 1))})
        placed.write.partitionBy(_PART).parquet(path)
        self._rows = spark.read.schema(placed.schema).parquet(path)
        self._starts, self.total = [], 0
        for part, n in sorted(tuple(r) for r in self._rows.groupBy(_PART).count().collect()):  # a row a part
            self._starts.append((part, self.total, n))
            self.total += n

    def page(self, limit: int, offset: int) -> DataFrame:
        """``limit`` rows from the ``offset``-th on, in order: of the other parts no file is opened, and of these only the row
        groups that hold such places.
        """
        here = F.lit(False)
        for part, start, n in self._starts:
            first, last = max(0, offset - start), min(n, offset + limit - start)
            if first < last:
                here = here | ((F.col(_PART) == part) & (F.col(_PLACE) >= first) & (F.col(_PLACE) < last))
        return self._rows.filter(here).orderBy(_PART, _PLACE).limit(limit).select(*self._columns)


class DataFrameStore(VectorStore):
    """A store whose rows are a DataFrame. The metric is chosen when the store is made."""

    def __init__(self, spark: SparkSession, metric: DistanceMetric = DistanceMetric.COSINE, capacity: int | None = None):
        self.spark, self._metric, self._lock = spark, metric, threading.RLock()
        self._empty()

    def _empty(self) -> None:
        self._rows = self.spark.createDataFrame([], DOCUMENT).withColumn(_SEQ, F.lit(0).cast("long"))
        self._next, self._changes, self._listing = 0, 0, None

    def _swap(self, rows: DataFrame) -> None:
        self._changes += 1
        if self._changes % CHECKPOINT_EVERY == 0:
            rows = checkpointed(rows)
        self._rows, self._listing = rows, None

    @property
    def metric(self) -> DistanceMetric:
        return self._metric

    @property
    def frame(self) -> DataFrame:
        """The documents as they are now."""
        return self._rows.drop(_SEQ)

    def dimension(self) -> int | None:
        """No dimension is enforced, so none is known."""
        return None

    def add(self, document: Row) -> None:
        self.add_batch([document])

    def add_batch(self, documents: DataFrame | Iterable[Row]) -> None:
        """Insert or overwrite by id. Within the batch the last row of an id wins: the last of the given rows, or of a
        DataFrame that with the highest ``seq`` if it has such a column (else any one).
        """
        if not isinstance(documents, DataFrame):
            rows = [r.asDict() | {"seq": i} for i, r in enumerate(documents)]
            documents = self.spark.createDataFrame([(r["id"], r["content"], r.get("metadata") or {}, r.get("embedding"), r["seq"]) for r in rows], "id string, content string, metadata map<string,string>, embedding array<float>, seq long")
        new = documents if "seq" in documents.columns else documents.withColumn("seq", F.monotonically_increasing_id())
        last = Window.partitionBy("id").orderBy(F.desc("seq"))
        new = new.withColumn("_n", F.row_number().over(last)).filter("_n = 1")
        with self._lock:
            new = new.select("id", "content", "metadata", "embedding", (F.col("seq") + self._next).alias(_SEQ))
            self._swap(upsert(self._rows, new))
            self._next += 1 << 48  # above any row number within the batch

    def search(self, query: list[float], k: int) -> DataFrame:
        return self.search_with_filter(query, k, MetadataFilter())

    def search_with_filter(self, query: list[float], k: int, where: MetadataFilter, prefilter: bool = False) -> DataFrame:
        return search.top_k_filtered(self.frame, query, k, where, self._metric, prefilter)

    def search_batch(self, queries: DataFrame, k: int, places: int | None = None) -> DataFrame:
        """The k best rows of each query, with their documents: sums in double precision, whatever the batch's size. ``places``:
        scores are rounded to so many places before they are ranked.
        """
        return search.top_k_documents(self.frame, queries, k, self._metric, places=places)

    def get(self, id: str) -> Row | None:
        return self.frame.filter(F.col("id") == id).head()

    def delete(self, id: str) -> bool:
        return self.delete_batch([id]) > 0

    def delete_batch(self, ids: DataFrame | Iterable[str]) -> int:
        """Remove rows by id; the number of rows that were there."""
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(i,) for i in ids], "id string")
        with self._lock:
            gone = self._rows.join(ids.select("id"), "id", "left_semi").count()
            if gone:
                self._swap(remove(self._rows, ids))
            return gone

    def clear(self) -> None:
        with self._lock:
            self._empty()

    def list(self, limit: int, offset: int = 0) -> DataFrame:
        """A page in order of insertion, then id. The first PAGED rows come from a top-k; for a deeper page the rows are listed
        once, and each page then opens the parts of the listing it lies in.
        """
        if limit < 0 or offset < 0:
            raise InvalidConfig("limit and offset must not be negative")
        if offset + limit <= PAGED:
            return self._rows.orderBy(_SEQ, "id").offset(offset).limit(limit).drop(_SEQ)
        with self._lock:
            if self._listing is None:
                self._listing = Listing(self._rows, [_SEQ, "id"], shared_path(self.spark, "listing"))
            return self._listing.page(limit, offset).drop(_SEQ)

    def count(self) -> int:
        return self._rows.count()

    def is_empty(self) -> bool:
        return self._rows.isEmpty()

    def save_to_file(self, path: str, parts: bool = False) -> None:
        """All documents as one JSON array in order; embeddings and metric are not kept. Tasks write the elements, one a line; then
        the parts are joined to a single file, byte by byte. With ``parts`` they stay a folder, whose files in the order of
        their names are the array: nothing passes through one place then.
        """
        element = F.to_json(F.struct("id", "content", "metadata"), {"ignoreNullFields": "false"})
        ordered = self._rows.orderBy(_SEQ, "id")
        first = ordered.head()
        rows = ordered if first is None else ordered.filter(F.col("id") != first["id"])
        folder = path if parts else f"{path}.parts-{uuid.uuid4().hex}"
        rows.select(F.concat(F.lit(","), element).alias("value")).write.text(folder)
        files = _Files(self.spark)
        opening = "" if first is None else self._rows.filter(F.col("id") == first["id"]).select(element).first()[0] + "\n"
        files.write(f"{folder}/a-opening", ONE_A_LINE + opening)  # names in order: opening, part-…, then the end
        files.write(f"{folder}/z-end", "]")
        files.delete(f"{folder}/_SUCCESS")
        if not parts:
            files.join(files.list(folder), path)
            files.delete(folder)

    @classmethod
    def load_from_file(cls, spark: SparkSession, path: str) -> DataFrameStore:
        """A store from a JSON array: no embeddings, the default metric; of rows that repeat an id the last stays.

        What :meth:`save_to_file` wrote, file or folder, is split between tasks at its lines; any other array is one record.
        """
        store, files = cls(spark), _Files(spark)
        head = next((f for f in files.list(path) if f.endswith("/a-opening")), path)
        if files.start(head, len(ONE_A_LINE)) == ONE_A_LINE:
            rows = _lines(spark, path)
        else:
            rows = spark.read.schema(SAVED).option("multiLine", True).json(path)
        store.add_batch(rows.filter(F.col("id").isNotNull()).withColumn("embedding", F.lit(None).cast("array<float>")))
        return store

    def save_parquet(self, path: str) -> None:
        """All documents with their embeddings, in parallel."""
        self._rows.write.mode("overwrite").parquet(path)

    @classmethod
    def load_parquet(cls, spark: SparkSession, path: str, metric: DistanceMetric = DistanceMetric.COSINE) -> DataFrameStore:
        store = cls(spark, metric)
        store._swap(spark.read.parquet(path))
        store._next = (store._rows.agg(F.max(_SEQ)).first()[0] or 0) + 1
        return store


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The elements of an array with one a line, with their order as ``seq``. A split's place is told by its file and first byte."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = sorted(tuple(r) for r in lines.select("file", "start").distinct().collect())  # a row a split
    numbered = spark.createDataFrame([(file, start, n) for n, (file, start) in enumerate(splits)], "file string, start long, split long")
    rows = lines.join(F.broadcast(numbered), ["file", "start"])
    seq = F.shiftleft("split", 33) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    element = F.from_json(F.ltrim(F.col("value"), F.lit(",")), SAVED)
    return rows.filter(F.col("value").rlike("^,?[{]")).select(element.alias("row"), seq.alias("seq")).select("row.*", "seq")


class _Files:
    """Whole files by way of Hadoop's file systems: small ones, and the joining of parts."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf, self._gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def write(self, path: str, text: str) -> None:
        files, where = self._at(path)
        out = files.create(where, True)
        out.write(bytearray(text.encode()))
        out.close()

    def start(self, path: str, size: int) -> str:
        """Up to ``size`` ASCII characters."""
        files, where = self._at(path)
        file = files.open(where)
        read = [file.read() for _ in range(size)]
        file.close()
        return "".join(chr(b) for b in read if b >= 0)

    def list(self, path: str) -> list[str]:
        """The files of a folder in the order of their names; a file itself."""
        files, where = self._at(path)
        return sorted(f.getPath().toString() for f in files.listStatus(where) if f.isFile())

    def join(self, parts: list[str], path: str) -> None:
        files, where = self._at(path)
        out = files.create(where, True)
        for part in parts:
            file = files.open(self._jvm.org.apache.hadoop.fs.Path(part))
            self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(file, out, 1 << 20, False)
            file.close()
        out.close()
        if is_instance_of(self._gateway, files, "org.apache.hadoop.fs.ChecksumFileSystem"):  # others may edit the file, who know nothing of its checksums
            files.getRawFileSystem().delete(files.getChecksumFile(where), False)

    def delete(self, path: str) -> None:
        files, where = self._at(path)
        files.delete(where, True)


# Other names under which a store, and the cosine beside it, may be asked for.
InMemoryStore = DataFrameStore
MinimalStore = DataFrameStore


def upsert(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with those of ``new`` in place of rows with the same key."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new)


def remove(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


class Index(ABC):
    """What an index over documents can do; other indexes than the exact one may stand behind it."""

    @abstractmethod
    def add(self, document: Row) -> None: ...

    @abstractmethod
    def remove(self, id: str) -> bool: ...

    @abstractmethod
    def search(self, query: list[float], k: int) -> DataFrame: ...

    @abstractmethod
    def search_batch(self, queries: DataFrame, k: int) -> DataFrame: ...

    @abstractmethod
    def clear(self) -> None: ...

    @abstractmethod
    def __len__(self) -> int: ...

    def is_empty(self) -> bool:
        return len(self) == 0

    def dimension(self) -> int | None:
        return None


class FlatIndex(Index):
    """Exact index: adding, removing and searching documents, by way of a store. ``capacity`` is a hint and not needed."""

    def __init__(self, spark: SparkSession, metric: DistanceMetric = DistanceMetric.COSINE, capacity: int | None = None):
        self.store = DataFrameStore(spark, metric, capacity)

    def add(self, document: Row) -> None:
        self.store.add(document)

    def remove(self, id: str) -> bool:
        return self.store.delete(id)

    def search(self, query: list[float], k: int) -> DataFrame:
        return search.top_k(self.store.frame, query, k, self.store.metric)

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        return self.store.search_batch(queries, k)

    def clear(self) -> None:
        self.store.clear()

    def __len__(self) -> int:
        return self.store.count()

    def is_empty(self) -> bool:
        return self.store.is_empty()

    @property
    def metric(self) -> DistanceMetric:
        return self.store.metric
