"""Inverted-list index: vectors are kept by the nearest of a set of centroids, and a search reads only some of the lists.

Centroids come from k-means over a bounded sample (SAMPLE_PER_LIST rows a list); all vectors are then dealt to their lists. The
index is a Parquet table partitioned by list and sorted by the distance to the centroid, so the lists a search does not need
are not read: they fall to partition pruning. A crowded list is only more files of the same folder.

A search is asked for a number of lists (``probes``), or for exact results (``probes=None``). Exact results take two passes:
the nearest lists give each query a score that k vectors reach; then the triangle inequality, from the query's distance to a
centroid and the least and greatest distance of a list's vectors to it, says which lists can hold a better one, and inside
a task the same for each batch of a list. What cannot beat the k-th score is neither read nor scored, and nothing is
shuffled but the k best rows of each task.

Vectors that have no place among the others (another length, zero length under the cosine, parts that are not numbers) are in
a list of their own that every search reads; rows without an embedding are not in the index. A query with such a vector
reads all lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vectorloom.errors import InvalidConfig
from vectorloom.operators import search
from vectorloom.operators.shared import checkpointed, shared_path
from vectorloom.operators.store import Index, remove, upsert
from vectorloom.types import DOCUMENT, DistanceMetric

SAMPLE_PER_LIST = 256
MOST_LISTS = 1 << 16
CENTROID_VALUES = 16_000_000  # of all centroids together, which every task gets
SAMPLE_QUERIES = 200  # indexed vectors by which the number of lists for a recall is measured
OTHERS = -1  # the list of vectors that are compared with every query
_SLACK = 1e-9
_ROUNDING = 1e-6  # of scores, by their precision
_RUN_VALUES = 1_000_000  # distances of a run of vectors to all centroids
LISTS_OF_QUERIES = 64_000_000  # (query, list) pairs of which the driver and each task know at once whether the list is read


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def distances(metric: DistanceMetric, x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """From each row of ``x`` (of unit length under the cosine) to each centroid: Manhattan for that metric, else Euclidean."""
    if metric is DistanceMetric.MANHATTAN:
        return np.stack([np.abs(x - c).sum(1) for c in centroids], axis=1)
    square = (x**2).sum(1)[:, None] + (centroids**2).sum(1)[None, :] - 2 * (x @ centroids.T)
    return np.sqrt(np.maximum(square, 0))


def distance_to(metric: DistanceMetric, x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """The same to one centroid by differences, without loss of digits."""
    return np.abs(x - centroid).sum(-1) if metric is DistanceMetric.MANHATTAN else np.sqrt(((x - centroid) ** 2).sum(-1))


def highest_score(metric: DistanceMetric, query: np.ndarray, centroid: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """What no vector between ``least`` and ``most`` from the centroid scores above. ``query``: of unit length under the cosine."""
    if metric is DistanceMetric.DOT_PRODUCT:
        size = np.linalg.norm(query)
        return query @ centroid + size * most + _SLACK * size * (np.linalg.norm(centroid) + most)
    way = distance_to(metric, query, centroid)
    gap = np.maximum(np.maximum(way - most, least - way) - _SLACK * (way + most), 0)
    return (1 - gap**2 / 2 + _SLACK) if metric is DistanceMetric.COSINE else 1 / (1 + gap) * (1 + _SLACK)


def highest_scores(metric: DistanceMetric, queries: np.ndarray, centroids: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The same for rows of queries and of centroids, by matrix products; where digits cancel out a little higher."""
    if metric is DistanceMetric.DOT_PRODUCT:
        size, middle = np.linalg.norm(queries, axis=1)[:, None], np.linalg.norm(centroids, axis=1)[None, :]
        return queries @ centroids.T + size * (most + _SLACK * (middle + most))
    way = distances(metric, queries, centroids)
    near = far = way
    if metric is not DistanceMetric.MANHATTAN:
        error = 8 * (queries.shape[1] + 8) * np.finfo(float).eps * ((queries**2).sum(1)[:, None] + (centroids**2).sum(1)[None, :])
        near, far = np.sqrt(np.maximum(way**2 - error, 0)), np.sqrt(way**2 + error)
    gap = np.maximum(np.maximum(near - most, least - far) - _SLACK * (far + most), 0)
    return (1 - gap**2 / 2 + _SLACK) if metric is DistanceMetric.COSINE else 1 / (1 + gap) * (1 + _SLACK)


def _placed(vectors: pd.Series, size: int, metric: DistanceMetric) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have a place among the lists, and these as rows of doubles."""
    fits = np.array([v is not None and len(v) == size for v in vectors], bool)
    x = np.stack(vectors[fits].to_numpy()).astype(np.float64) if fits.any() else np.zeros((0, size))
    good = np.isfinite(x).all(1)
    if metric is DistanceMetric.COSINE:
        good &= (x != 0).any(1)
    fits[np.flatnonzero(fits)[~good]] = False
    x = x[good]
    return fits, _unit(x) if metric is DistanceMetric.COSINE else x


def _deal(metric: DistanceMetric, centroids: np.ndarray):
    """Adds ``list`` and ``distance`` to batches of (id, embedding)."""

    step = max(1, _RUN_VALUES // len(centroids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            fits, x = _placed(batch["embedding"], centroids.shape[1], metric)
            lists, far = np.full(len(batch), OTHERS, np.int32), np.zeros(len(batch))
            nearest = np.concatenate([distances(metric, x[i : i + step], centroids).argmin(1) for i in range(0, len(x), step)] or [np.zeros(0, int)])
            lists[fits] = nearest
            far[fits] = distance_to(metric, x, centroids[nearest])
            yield batch.assign(list=lists, distance=far)

    return run


def train(vectors: DataFrame, lists: int, metric: DistanceMetric, seed: int = 0) -> np.ndarray:
    """Centroids of a sample of ``vectors`` (``id``, ``embedding``, all of one length and, under the cosine, not zero)."""
    rows = vectors.count()
    take = min(1.0, lists * SAMPLE_PER_LIST / max(rows, 1))
    part = vectors if take >= 1 else vectors.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < math.ceil(take * (1 << 20)))
    x = F.transform("embedding", lambda v: v.cast("double"))
    if metric is DistanceMetric.COSINE:
        size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda total, v: total + v * v))
        x = F.transform(x, lambda v: v / size)
    sample = part.select(array_to_vector(x).alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=12, featuresCol="features").fit(sample)
    return np.array(model.clusterCenters(), np.float64)


class InvertedLists:
    """The lists that :meth:`build` wrote below ``path``. The driver holds a row a list: its centroid, number and extent."""

    def __init__(self, spark: SparkSession, path: str, metric: DistanceMetric):
        self.spark, self.path, self.metric = spark, path, metric
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
        self.centroids, self._rows = np.array([r["centroid"] for r in rows], np.float64), rows[0]["schema"]
        self._id = self._rows.split(", ")[0]
        extents = self.frame().groupBy("list").agg(F.count("*"), F.min("distance"), F.max("distance"))
        self.sizes = {r[0]: (r[1], r[2], r[3]) for r in extents.collect()}

    @classmethod
    def build(cls, docs: DataFrame, path: str, metric: DistanceMetric = DistanceMetric.COSINE, lists: int | None = None, seed: int = 0) -> InvertedLists:
        """Index the rows of ``docs`` (``id``, ``embedding``) that have an embedding. ``lists``: the square root of their number
        if not given. The length of the vectors is the commonest one.
        """
        spark = docs.sparkSession
        rows = docs.filter(F.col("embedding").isNotNull()).select("id", "embedding")
        common = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
        size, n = (common["size"], common["count"]) if common else (0, 0)
        lists = min(MOST_LISTS, max(1, lists or round(math.sqrt(n))))
        if lists * max(size, 1) > CENTROID_VALUES:
            raise InvalidConfig(f"{lists} centroids of {size} numbers are more than every task should hold")
        fit = rows.filter((F.size("embedding") == size) & F.forall("embedding", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))))
        if metric is DistanceMetric.COSINE:
            fit = fit.filter(F.exists("embedding", lambda v: v != 0))
        centroids = train(fit, lists, metric, seed) if n and not fit.isEmpty() else np.zeros((1, size))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", distance double, list int"
        spread = rows.repartition(2 * spark.sparkContext.defaultParallelism, "id")
        dealt = spread.mapInPandas(_deal(metric, centroids), schema)
        # crowded lists are spread by distance, then by id
        sorted_rows = dealt.repartitionByRange("list", "distance", "id").sortWithinPartitions("list", "distance")
        sorted_rows.write.partitionBy("list").parquet(f"{path}/lists")
        spark.createDataFrame([(i, c.tolist(), schema) for i, c in enumerate(centroids)], "list int, centroid array<double>, schema string").coalesce(1).write.parquet(f"{path}/centroids")
        return cls(spark, path, metric)

    def frame(self, lists: Iterable[int] | None = None) -> DataFrame:
        """Rows (id, embedding, distance, list) of some lists; the files of others are not opened."""
        rows = self.spark.read.schema(self._rows).parquet(f"{self.path}/lists")
        return rows if lists is None else rows.filter(F.col("list").isin(sorted(lists)))

    def __len__(self) -> int:
        return sum(n for n, _, _ in self.sizes.values())

    def _real(self) -> list[int]:
        return [i for i in self.sizes if i != OTHERS]

    def _by_runs(self, vectors: list[np.ndarray], choose) -> np.ndarray:
        """A row a query, a column a list: which to read. ``choose`` says so of some queries that have a place; others read all."""
        fits, x = _placed(pd.Series(vectors, dtype=object), self.centroids.shape[1], self.metric)
        wanted = np.ones((len(vectors), len(self._real())), bool)
        rows, step = np.flatnonzero(fits), max(1, _RUN_VALUES // max(1, wanted.shape[1]))
        for i in range(0, len(rows) if wanted.shape[1] else 0, step):
            wanted[rows[i : i + step]] = choose(x[i : i + step], rows[i : i + step])
        return wanted

    def _orders(self, x: np.ndarray) -> np.ndarray:
        """Lists in the order of their nearness to each of some queries, as places among all lists."""
        middle = self.centroids[self._real()]
        far = distances(self.metric, x, middle) if self.metric is not DistanceMetric.DOT_PRODUCT else -(x @ middle.T)
        return np.argsort(far, axis=1, kind="stable")

    def nearest(self, vectors: list[np.ndarray], probes: int | None, rows: int) -> np.ndarray:
        """Which lists to read: the ``probes`` nearest to each query; without that as many as hold ``rows`` vectors."""
        sizes = np.array([self.sizes[i][0] for i in self._real()], np.int64)

        def choose(x: np.ndarray, _: np.ndarray) -> np.ndarray:
            order = self._orders(x)
            n = np.full(len(x), probes) if probes is not None else (np.cumsum(sizes[order], axis=1) < rows).sum(1) + 1
            out = np.zeros(order.shape, bool)
            np.put_along_axis(out, order, np.arange(order.shape[1])[None, :] < n[:, None], 1)
            return out

        return self._by_runs(vectors, choose)

    def within_reach(self, vectors: list[np.ndarray], scores: np.ndarray) -> np.ndarray:
        """Which lists may hold a vector of each query's score or a better one."""
        real = self._real()
        least, most = (np.array([self.sizes[i][j] for i in real], np.float64) for j in (1, 2))
        return self._by_runs(vectors, lambda x, rows: highest_scores(self.metric, x, self.centroids[real], least, most) >= scores[rows, None])

    def probes_for(self, recall: float = 0.93, k: int = 10, sample: int = SAMPLE_QUERIES) -> int:
        """How many lists a search for ``k`` vectors must read to find this share of them, measured on ``sample`` indexed vectors:
        by the place that the lists of their exact neighbours take among the lists near to them.
        """
        some = self.frame(self._real()).select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample)
        queries = self.spark.createDataFrame([(i, r["id"], r["embedding"]) for i, r in enumerate(some.collect())], f"query_id long, own {self._id.split(' ', 1)[1]}, query_vec array<float>")
        near = self.search_batch(queries.drop("own"), k + 1).join(queries.drop("query_vec"), "query_id").filter(F.col("id") != F.col("own"))
        rows = near.join(self.frame().select("id", "list"), "id").select("query_id", "list").collect()
        asked = queries.collect()
        fits, x = _placed(pd.Series([r["query_vec"] for r in asked], dtype=object), self.centroids.shape[1], self.metric)
        orders = iter(self._orders(x) if self._real() else [])
        order = {r["query_id"]: {self._real()[n]: place for place, n in enumerate(next(orders) if fit else range(len(self._real())))} for r, fit in zip(asked, fits, strict=True)}
        places = sorted(-1 if r["list"] == OTHERS else order[r["query_id"]][r["list"]] for r in rows)
        return places[math.ceil(recall * len(places)) - 1] + 1 if places and places[-1] >= 0 else 1

    def _found(self, names: list, queries: list[np.ndarray], wanted: np.ndarray, floors: np.ndarray, k: int, schema: str, without: DataFrame | None, **ways) -> DataFrame:
        """(query_id, id, score): the k best of each task among each query's lists, none below its floor."""
        real = self._real()
        read = np.flatnonzero(wanted.any(0))
        by_list = {real[i]: np.packbits(wanted[:, i]) for i in read}
        rows = self.frame([OTHERS, *by_list])
        if without is not None:
            rows = remove(rows, without)
        return rows.select("id", "embedding", "distance", "list").mapInPandas(_scan_lists(self.metric, self.centroids, names, queries, by_list, floors, k, **ways), schema)

    def search_batch(self, queries: DataFrame, k: int, probes: int | None = None, kind: str = "float", without: DataFrame | None = None, places: int | None = None) -> DataFrame:
        """(query_id, id, score, rank) for each row of ``queries`` (``query_id``, ``query_vec``): of the ``probes`` nearest lists,
        or exact. ``without`` (``id``) names rows that are not to be found. ``places``: scores are rounded to so many places
        before they are ranked.
        """
        if k < 0 or (probes is not None and probes < 1):
            raise InvalidConfig("k must not be negative, and probes at least 1")
        schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {self._id}, score {kind}"
        near = self.spark.createDataFrame([], schema)
        step = max(1, LISTS_OF_QUERIES // max(1, len(self._real())))
        for part in search.query_blocks(queries) if k else []:
            names, vectors = search.asked_vectors(part)
            for i in range(0, len(names), step):
                near = near.unionByName(self._part(names[i : i + step], vectors[i : i + step], k, probes, schema, without, kind=kind, places=places))
        return search.ranked_best(near, k, kind)

    def _part(self, names: list, vectors: list[np.ndarray], k: int, probes: int | None, schema: str, without: DataFrame | None, **ways) -> DataFrame:
        if probes is not None:
            return self._found(names, vectors, self.nearest(vectors, probes, k), np.full(len(names), -np.inf), k, schema, without, **ways)
        wanted, floors, _ = self.plan_exact(vectors, k, without, max(_ROUNDING, 10.0**-places) if (places := ways["places"]) is not None else _ROUNDING)
        return self._found(names, vectors, wanted, floors, k, schema, without, **ways)

    def plan_exact(self, vectors: list[np.ndarray], k: int, without: DataFrame | None = None, rounding: float = _ROUNDING) -> tuple[np.ndarray, np.ndarray, float]:
        """For exact results: which lists each query reads, a score that k vectors are known to reach (or minus infinity), and the
        share of (query, vector) pairs that lie in lists out of reach.
        """
        first = self._found(list(range(len(vectors))), vectors, self.nearest(vectors, None, k), np.full(len(vectors), -np.inf), k, f"query_id long, {self._id}, score double", without)
        best = search.ranked_best(first, k, "double").groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score"), F.max(F.isnan("score")).alias("odd"))
        floors = np.full(len(vectors), -np.inf)
        for r in best.filter((F.col("n") == k) & ~F.col("odd")).collect():  # one row a query
            floors[r["query_id"]] = r["score"]
        # sums of another batch may differ in the last digit, and rounding may lift a score
        floors = np.where(np.isinf(floors), floors, floors - rounding * np.maximum(1, np.abs(floors)))
        wanted = self.within_reach(vectors, floors)
        sizes = np.array([self.sizes[i][0] for i in self._real()], np.int64)
        pairs = len(vectors) * int(sizes.sum())
        return wanted, floors, 1 - int((wanted.sum(0) * sizes).sum()) / pairs if pairs else 0.0


def _scan_lists(metric: DistanceMetric, centroids: np.ndarray, names: list, queries: list[np.ndarray], by_list: dict[int, np.ndarray], floors: np.ndarray, k: int, **ways):
    """``by_list``: the bits of the queries that read a list."""
    fits, placed = _placed(pd.Series(queries, dtype=object), centroids.shape[1], metric)
    at = np.cumsum(fits) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = search.KeptBest(k, metric, names, queries, **ways)
        for batch in batches:
            for number, rows in batch.groupby("list"):
                columns = None
                if number != OTHERS:
                    columns = np.flatnonzero(np.unpackbits(by_list[number], count=len(names)))
                    inner = columns[fits[columns]]
                    bar = np.maximum(floors[inner], kept.unrounded(kept.least()[inner]))
                    most = highest_scores(metric, placed[at[inner]], centroids[[number]], rows["distance"].min(), rows["distance"].max())[:, 0]
                    columns = np.concatenate([columns[~fits[columns]], inner[most >= bar]])
                if columns is None or len(columns):
                    kept.offer(rows["id"].to_numpy(), rows["embedding"], columns)
        yield from kept.frames()

    return run


class IvfIndex(Index):
    """An index over documents by inverted lists. Built from a DataFrame of documents; what is added later is searched beside the
    lists until :meth:`rebuild`, what is removed is left out of them.
    """

    def __init__(self, docs: DataFrame, metric: DistanceMetric = DistanceMetric.COSINE, lists: int | None = None, probes: int | None = None, path: str | None = None):
        self.spark, self.metric, self.probes, self._lists = docs.sparkSession, metric, probes, lists
        self._build(docs.select(*DOCUMENT.names), path)

    def _build(self, docs: DataFrame, path: str | None = None) -> None:
        path = path or shared_path(self.spark, "ivf")
        docs.write.parquet(f"{path}/documents")
        self._docs = self.spark.read.parquet(f"{path}/documents")
        self.lists = InvertedLists.build(self._docs, path, self.metric, self._lists)
        self._added = self.spark.createDataFrame([], DOCUMENT)
        self._gone = self.spark.createDataFrame([], "id string")
        self._changed = False

    @property
    def frame(self) -> DataFrame:
        """The documents as they are now."""
        return remove(self._docs, self._gone).unionByName(self._added) if self._changed else self._docs

    def add(self, document: Row) -> None:
        self.add_batch(self.spark.createDataFrame([document], DOCUMENT))

    def add_batch(self, documents: DataFrame) -> None:
        new = checkpointed(documents.select(*DOCUMENT.names))
        self._added, self._gone, self._changed = checkpointed(upsert(self._added, new)), checkpointed(self._gone.union(new.select("id")).distinct()), True

    def remove(self, id: str) -> bool:
        one = self.spark.createDataFrame([(id,)], "id string")
        there = not self.frame.join(one, "id", "left_semi").isEmpty()
        if there:
            self._added, self._gone, self._changed = checkpointed(remove(self._added, one)), checkpointed(self._gone.union(one).distinct()), True
        return there

    def rebuild(self) -> None:
        """Take what was added and removed into the lists."""
        self._build(self.frame)

    def search(self, query: list[float], k: int) -> DataFrame:
        asked = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, query_vec array<float>")
        return self.search_batch(asked, k).drop("query_id", "rank").orderBy(F.isnan("score"), F.desc("score"), "id")

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        found = self.lists.search_batch(queries, k, self.probes, without=self._gone if self._changed else None)
        if self._changed:
            beside = search.top_k_scan(self._added, queries, k, self.metric)
            found = search.ranked_best(found.drop("rank").unionByName(beside.drop("rank")), k, "float")
        return found.join(self.frame, "id").select("query_id", *DOCUMENT.names, "score", "rank")

    def clear(self) -> None:
        self._build(self.spark.createDataFrame([], DOCUMENT))

    def __len__(self) -> int:
        return self.frame.count()

    def dimension(self) -> int | None:
        return self.lists.centroids.shape[1] or None
