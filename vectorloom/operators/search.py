"""Exact nearest-neighbour search over document rows.

Ties are settled by ascending id, and a score that is not a number comes last, so results are deterministic. Rows
without an embedding are never found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.errors import InvalidConfig
from vectorloom.functions.metadata import MetadataFilter, any_value_contains
from vectorloom.functions.vectors import similarity, vector
from vectorloom.types import DistanceMetric

OVERFETCH = 4  # a filtered search looks at so many times k rows before it filters
BROADCAST_QUERY_VALUES = 4_000_000  # of the part of a batch that is sent to every task at once
_QUERY_RUN = 512
_DOCUMENT_RUN = 2048
_TILE_VALUES = 131_072  # distances that are summed at once
_PAIRS = 16_384  # that are scored at once


def _order(score: str = "score", id_col: str = "id") -> list[Column]:
    return [F.isnan(score), F.desc(score), F.col(id_col)]


def _checked(k: int) -> int:
    if k < 0:
        raise InvalidConfig(f"k must not be negative, got {k}")
    return k


def scored(docs: DataFrame, query: list[float] | Column, metric: DistanceMetric = DistanceMetric.COSINE, kind: str = "float") -> DataFrame:
    """Rows that have an embedding, with their score."""
    q = query if isinstance(query, Column) else vector(query)
    return docs.filter(F.col("embedding").isNotNull()).withColumn("score", similarity(metric, F.col("embedding"), q, kind))


def top_k(docs: DataFrame, query: list[float], k: int, metric: DistanceMetric = DistanceMetric.COSINE, kind: str = "float", places: int | None = None) -> DataFrame:
    """The k best rows, best first: a top-k per task, then one over the tasks' winners. ``places``: scores are rounded to so many
    places before they are ranked.
    """
    found = scored(docs, query, metric, kind)
    found = found if places is None else found.withColumn("score", F.round("score", places))
    return found.orderBy(*_order()).limit(_checked(k))


def with_rank(found: DataFrame) -> DataFrame:
    """Ranks from 1 for the few rows of a search result."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*_order())))


def top_k_filtered(docs: DataFrame, query: list[float], k: int, where: MetadataFilter, metric: DistanceMetric = DistanceMetric.COSINE, prefilter: bool = False, kind: str = "float", places: int | None = None) -> DataFrame:
    """The k best of those among the 4 k best rows that meet the filter; there may be fewer than k.

    ``prefilter`` asks for the k best of all rows that meet it instead.
    """
    if prefilter:
        return top_k(docs.filter(where.matches(F.col("metadata"))), query, k, metric, kind, places)
    near = top_k(docs, query, _checked(k) * OVERFETCH, metric, kind, places)
    return near.filter(where.matches(F.col("metadata"))).orderBy(*_order()).limit(k)


def top_k_containing(docs: DataFrame, query: list[float], k: int, part: str, metric: DistanceMetric = DistanceMetric.COSINE, kind: str = "float", places: int | None = None) -> DataFrame:
    """The k best of those among the 2 k best rows that have ``part`` in some metadata value."""
    near = top_k(docs, query, 2 * _checked(k), metric, kind, places)
    return near.filter(any_value_contains(F.col("metadata"), part)).orderBy(*_order()).limit(k)


def _asked_values(queries: DataFrame) -> int:
    return queries.agg(F.sum(F.size("query_vec"))).first()[0] or 0


def query_blocks(queries: DataFrame) -> list[DataFrame]:
    """The batch in parts of about BROADCAST_QUERY_VALUES numbers each, so that a part can be sent to every task."""
    n = -(-_asked_values(queries) // max(1, BROADCAST_QUERY_VALUES))
    if n <= 1:
        return [queries]
    part = F.pmod(F.xxhash64("query_id", "query_vec"), F.lit(n))
    return [queries.filter(part == i) for i in range(n)]


def _all(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found


def _with_documents(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents of (query_id, id, score, rank), found by their ids."""
    return found.join(docs, "id").select("query_id", *docs.columns, "score", "rank")


def top_k_batch(docs: DataFrame, queries: DataFrame, k: int, metric: DistanceMetric = DistanceMetric.COSINE, kind: str = "float", places: int | None = None) -> DataFrame:
    """(query_id, …document, score, rank) for each row of ``queries`` (``query_id``, ``query_vec``), scored as a single query is.

    As :func:`top_k_scan`, with sums of the precision asked for. Only ids and scores are ranked, k rows a query leave a task,
    and the documents of the best are fetched by their ids.
    """
    return _with_documents(top_k_scan(docs, queries, k, metric, kind, places, summed=kind), docs)


def top_k_documents(docs: DataFrame, queries: DataFrame, k: int, metric: DistanceMetric = DistanceMetric.COSINE, kind: str = "float", places: int | None = None) -> DataFrame:
    """The same rows by sums in double precision, whatever that of the scores."""
    return _with_documents(top_k_scan(docs, queries, k, metric, kind, places), docs)


def exact_scores(metric: DistanceMetric, docs: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Scores of rows of doubles by their differences, so that equal vectors have distance 0."""
    if metric is DistanceMetric.EUCLIDEAN:
        return 1 / (1 + np.sqrt(((docs - query) ** 2).sum(1)))
    if metric is DistanceMetric.MANHATTAN:
        return 1 / (1 + np.abs(docs - query).sum(1))
    if metric is DistanceMetric.DOT_PRODUCT:
        return docs @ query
    lengths = np.linalg.norm(docs, axis=1) * np.linalg.norm(query)
    return np.divide(docs @ query, lengths, out=np.zeros(len(docs)), where=lengths != 0)


def pair_scores(metric: DistanceMetric, docs: np.ndarray, queries: np.ndarray, kind: str = "double") -> np.ndarray:
    """Scores of rows against the rows beside them, summed from left to right in this precision as ``similarity`` does."""
    number = np.float32 if kind == "float" else np.float64
    x, q = (np.ascontiguousarray(v.T, number) for v in (docs, queries))

    def total(step) -> np.ndarray:
        out = np.zeros(x.shape[1], number)
        for a, b in zip(x, q, strict=True):
            out += step(a, b)
        return out

    with np.errstate(all="ignore"):
        if metric is DistanceMetric.DOT_PRODUCT:
            score = total(lambda a, b: a * b)
        elif metric is DistanceMetric.COSINE:
            lengths = np.sqrt(total(lambda a, b: a * a)) * np.sqrt(total(lambda a, b: b * b))
            score = np.divide(total(lambda a, b: a * b), lengths, out=np.zeros(x.shape[1], number), where=lengths != 0)
        else:
            way = np.sqrt(total(lambda a, b: (a - b) * (a - b))) if metric is DistanceMetric.EUCLIDEAN else total(lambda a, b: np.abs(a - b))
            score = 1 / (1 + way.astype(np.float64))
    return score.astype(number).astype(np.float64)


class _Likeness:
    """How documents compare with queries, cheaply (``values``: a row a query), and how much likeness a score takes at least.
    Vectors that such sums say nothing about (parts that are not numbers, sizes out of range) are as like as can be.
    """

    def __init__(self, metric: DistanceMetric, x: np.ndarray, q: np.ndarray, kind: str):
        self.metric = metric
        self._error = 8 * (x.shape[1] + 8) * float(np.finfo(np.float32 if kind == "float" else np.float64).eps)
        far = 1e15 if kind == "float" else 1e140
        (x, self._x, odd_x), (q, self._q, odd_q) = self._sized(x, far), self._sized(q, far)
        if metric is DistanceMetric.COSINE:
            x, q = (v / np.where(n == 0, 1, n)[:, None] for v, n in ((x, self._x), (q, self._q)))
        if metric is DistanceMetric.MANHATTAN:
            self._reach = np.abs(x).sum(1).max(initial=0) + np.abs(q).sum(1)
            self.values = self._manhattan(x.astype(np.float32), q.astype(np.float32))
        elif metric is DistanceMetric.EUCLIDEAN:
            self.values = np.hstack([q, np.ones((len(q), 1))]) @ np.hstack([x, -(self._x**2)[:, None] / 2]).T
        else:
            self.values = q @ x.T
        self._width = x.shape[1]
        self.values[:, odd_x] = np.inf
        self.values[odd_q] = np.inf

    @staticmethod
    def _sized(v: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            n = np.sqrt((v**2).sum(1))
        odd = ~(n < far) | ((n < 1 / far) & (v != 0).any(1))
        return np.where(odd[:, None], 0, v), np.where(odd, 0, n), odd

    @staticmethod
    def _manhattan(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(x)), np.float32)
        step = max(1, _TILE_VALUES // max(1, len(x)))
        columns = np.ascontiguousarray(x.T)
        gap = np.empty((min(step, len(q)), len(x)), np.float32)
        for at in range(0, len(q), step):
            part, rows = out[at : at + step], q[at : at + step]
            here = gap[: len(rows)]
            for j, column in enumerate(columns):
                np.subtract(column[None, :], rows[:, j, None], out=here)
                np.abs(here, out=here)
                part -= here
        return out

    def least(self, bar: np.ndarray) -> np.ndarray:
        """By query, what a document of this score or a higher one has at least."""
        if self.metric is DistanceMetric.DOT_PRODUCT:
            return bar - self._error * self._q * self._x.max(initial=0)
        if self.metric is DistanceMetric.COSINE:
            return bar - 4 * self._error
        with np.errstate(all="ignore"):
            way = np.where(bar > 0, 1 / np.maximum(bar, 1e-300) - 1, np.inf)
        way = np.maximum(way, 0) + self._error * (1 + np.abs(way))
        if self.metric is DistanceMetric.MANHATTAN:
            return -way - 4 * (self._width + 8) * float(np.finfo(np.float32).eps) * self._reach
        return (self._q**2 - way**2) / 2 - 8 * (self._width + 8) * np.finfo(float).eps * (self._q**2 + self._x.max(initial=0) ** 2)


def _with_nan(found: DataFrame, kind: str) -> DataFrame:
    """pandas hands a score that is not a number over as null."""
    return found.withColumn("score", F.coalesce("score", F.lit(float("nan")).cast(kind)))


def rounded_half_up(scores: np.ndarray, places: int) -> np.ndarray:
    """As SQL rounds: halves away from zero."""
    return np.copysign(np.floor(np.abs(scores) * 10.0**places + 0.5) / 10.0**places, scores)


def _firsts_of_equals(x: np.ndarray, k: int) -> np.ndarray:
    """Of rows in the order of their ids, those that have fewer than k equal ones before them: no others are among the k best."""
    if not x.shape[1] or len(x) <= k:
        return np.arange(min(len(x), k)) if not x.shape[1] else np.arange(len(x))
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, group, counts = np.unique(raw, return_inverse=True, return_counts=True)
    if counts.max() <= k:
        return np.arange(len(x))
    order = np.argsort(group, kind="stable")
    place = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(order[place < k])


class KeptBest:
    """The k best (id, score) of each query of a batch, as a task comes across documents.

    Some thousand documents are compared with some hundred queries at a time, by what is cheap; only pairs that may be among
    the k best are scored. ``summed`` is the precision of the sums, ``kind`` that of the scores, ``places`` to how many places
    they are rounded before they are ranked (None: not at all).
    """

    def __init__(self, k: int, metric: DistanceMetric, names: list, queries: list[np.ndarray], kind: str = "double", summed: str = "double", places: int | None = None):
        self.k, self.metric, self.names, self.kind, self.summed, self.places = k, metric, names, kind, summed, places
        sizes = np.array([len(q) for q in queries], np.int64)
        self._columns = {int(m): np.flatnonzero(sizes == m) for m in np.unique(sizes)}
        self._asked = {m: np.stack([queries[c] for c in mine]).astype(np.float64).reshape(len(mine), m) for m, mine in self._columns.items()}
        self._n = np.zeros(len(names), np.int64)
        self._scores, self._ids = np.zeros((len(names), 0)), None

    def least(self) -> np.ndarray:
        """By query: a score below this is not among the k best; one as high may be."""
        if self._scores.shape[1] < self.k or not self.k:
            return np.full(len(self.names), -np.inf)
        last = self._scores[:, self.k - 1]
        return np.where((self._n == self.k) & ~np.isnan(last), last, -np.inf)

    def unrounded(self, bar: np.ndarray) -> np.ndarray:
        """A little lower: what rounding may lift to these scores."""
        if self.places is not None:
            bar = bar - 10.0**-self.places
        return bar - 4e-7 * np.abs(np.where(np.isinf(bar), 0, bar)) - 1e-37 if self.kind == "float" else bar

    def offer(self, ids: np.ndarray, vectors: pd.Series, columns: np.ndarray | None = None) -> None:
        """Some documents for the queries of these columns (None: all), a bounded number of either at a time.

        Vectors may be of any lengths: groups of equal length are compared by their common prefix (cosine: 0 across lengths).
        """
        asked = np.ones(len(self.names), bool)
        if columns is not None:
            asked[:] = False
            asked[columns] = True
        lengths = vectors.str.len().to_numpy()
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            rows = rows[np.argsort(ids[rows], kind="stable")]
            x = np.stack(vectors.iloc[rows].to_numpy()).astype(np.float64).reshape(len(rows), n)
            some = _firsts_of_equals(x, self.k)
            rows, x = rows[some], x[some]
            for m, mine in self._columns.items():
                at = np.flatnonzero(asked[mine])
                width = 0 if self.metric is DistanceMetric.COSINE and n != m else min(n, m)
                for i in range(0, len(at), _QUERY_RUN):
                    run = at[i : i + _QUERY_RUN]
                    for j in range(0, len(rows), _DOCUMENT_RUN):
                        part = slice(j, j + _DOCUMENT_RUN)
                        self._tile(ids[rows[part]], x[part, :width], mine[run], self._asked[m][run, :width])

    def _values(self, x: np.ndarray, q: np.ndarray, docs: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Scores of documents ``docs`` for queries ``of``, as they are ranked."""
        parts = [pair_scores(self.metric, x[docs[i : i + _PAIRS]], q[of[i : i + _PAIRS]], self.summed) for i in range(0, len(docs), _PAIRS)]
        scores = np.concatenate(parts or [np.zeros(0)])
        scores = scores if self.places is None else rounded_half_up(scores, self.places)
        return scores.astype(np.float32).astype(np.float64) if self.kind == "float" else scores

    def _tile(self, ids: np.ndarray, x: np.ndarray, columns: np.ndarray, q: np.ndarray) -> None:
        like, k, n = _Likeness(self.metric, x, q, self.summed), self.k, len(ids)
        bar = self.least()[columns]
        new = np.flatnonzero(self._n[columns] < k)
        if len(new) and k < n:  # k documents that look best give a score to beat
            some = np.argpartition(like.values[new], n - k, axis=1)[:, n - k :]
            lowest = self._values(x, q, some.ravel(), np.repeat(new, k)).reshape(len(new), k).min(1)
            bar[new] = np.where(np.isnan(lowest), -np.inf, lowest)
        of, docs = np.nonzero(like.values >= np.where(bar == -np.inf, -np.inf, like.least(self.unrounded(bar)))[:, None])
        scores = self._values(x, q, docs, of)
        good = (scores >= bar[of]) | (bar[of] == -np.inf)
        if good.any():
            self._merge(columns[of[good]], ids[docs[good]], scores[good])

    def _merge(self, columns: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if self._ids is None:
            self._ids = np.empty(self._scores.shape, ids.dtype)
        changed = np.unique(columns)
        held = np.arange(self._scores.shape[1])[None, :] < self._n[changed, None]
        columns = np.concatenate([np.repeat(changed, self._n[changed]), columns])
        ids, scores = np.concatenate([self._ids[changed][held], ids]), np.concatenate([self._scores[changed][held], scores])
        order = np.argsort(ids, kind="stable")
        nan = np.isnan(scores[order])  # a score that is not a number comes after any other
        order = order[np.lexsort((-np.where(nan, 0, scores[order]), nan, columns[order]))]
        columns, ids, scores = columns[order], ids[order], scores[order]
        _, counts = np.unique(columns, return_counts=True)
        place = np.arange(len(columns)) - np.repeat(np.cumsum(counts) - counts, counts)
        kept = place < self.k
        more = min(self.k, int(counts.max())) - self._scores.shape[1]
        if more > 0:
            self._scores = np.pad(self._scores, ((0, 0), (0, more)))
            self._ids = np.hstack([self._ids, np.empty((len(self.names), more), self._ids.dtype)])
        self._n[changed] = np.minimum(counts, self.k)
        self._scores[columns[kept], place[kept]], self._ids[columns[kept], place[kept]] = scores[kept], ids[kept]

    def frames(self) -> Iterator[pd.DataFrame]:
        for at in range(0, len(self.names), _QUERY_RUN):
            n = self._n[at : at + _QUERY_RUN]
            if n.any():
                held = np.arange(self._scores.shape[1])[None, :] < n[:, None]
                names = [name for name, times in zip(self.names[at : at + _QUERY_RUN], n.tolist(), strict=True) for _ in range(times)]
                yield pd.DataFrame({"query_id": names, "id": self._ids[at : at + _QUERY_RUN][held], "score": self._scores[at : at + _QUERY_RUN][held]})


def asked_vectors(queries: DataFrame) -> tuple[list, list[np.ndarray]]:
    """A part of a batch, of checked size, on the driver."""
    rows = queries.select("query_id", "query_vec").collect()
    return [r["query_id"] for r in rows], [np.array(r["query_vec"], np.float64) for r in rows]


def _best_of_batch(k: int, *batch, **ways):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = KeptBest(k, *batch, **ways)
        for documents in batches:
            if len(documents) and k:
                kept.offer(documents["id"].to_numpy(), documents["embedding"])
        yield from kept.frames()

    return run


def top_k_scan(docs: DataFrame, queries: DataFrame, k: int, metric: DistanceMetric = DistanceMetric.COSINE, kind: str = "float", places: int | None = None, summed: str = "double") -> DataFrame:
    """(query_id, id, score, rank): documents are dealt out to all cores, queries go to every task, and a matrix product in
    double precision tells which documents of a batch to score for which queries. A task keeps the k best rows of each query
    from batch to batch, and only these leave it. The queries' size is checked; larger batches are asked in parts. ``places``:
    scores are rounded to so many places before they are ranked. ``summed``: the precision of a score's sums.
    """
    rows = docs.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    rows = rows.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism, "id")  # small files hold much work
    id_type, query_type = rows.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, id {id_type}, score {kind}"
    ways = {"kind": kind, "summed": summed, "places": places}
    found = [rows.mapInPandas(_best_of_batch(_checked(k), metric, *asked_vectors(part), **ways), schema) for part in query_blocks(queries)]
    return ranked_best(_all(found), k, kind)


def ranked_best(near: DataFrame, k: int, kind: str) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(*_order())
    return _with_nan(near, kind).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _best_of_block(metric: DistanceMetric, k: int, **ways):
    """A task's block of documents against a block of queries: the k best ids of each query."""

    def run(key: tuple, docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        kept = KeptBest(k, metric, queries["query_id"].tolist(), [np.array(q, np.float64) for q in queries["query_vec"]], **ways)
        if len(docs) and len(queries) and k:
            kept.offer(docs["id"].to_numpy(), docs["embedding"])
        return pd.concat(list(kept.frames()) or [pd.DataFrame({"query_id": [], "id": [], "score": []})])

    return run


def top_k_blocks(docs: DataFrame, queries: DataFrame, k: int, metric: DistanceMetric = DistanceMetric.COSINE, block_rows: int = 20_000, query_rows: int = 5_000, kind: str = "float", places: int | None = None) -> DataFrame:
    """The same for batches of any size: blocks of documents meet blocks of queries in tasks of bounded size, a matrix
    product in double precision scores them, and only k rows a query leave a task. Returns (query_id, id, score, rank).
    """
    rows = docs.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    n, m = max(1, -(-rows.count() // block_rows)), max(1, -(-queries.count() // query_rows))
    deal = lambda df, key, mine: df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(n if mine == "d" else m)).cast("int"))
    left = deal(rows, "id", "d").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = deal(queries.select("query_id", "query_vec"), "query_id", "q").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    id_type, query_type = rows.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    near = left.groupBy("d", "q").cogroup(right.groupBy("d", "q")).applyInPandas(_best_of_block(metric, _checked(k), kind=kind, places=places), f"query_id {query_type}, id {id_type}, score {kind}")
    return ranked_best(near, k, kind)
