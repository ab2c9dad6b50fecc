"""Keyword search by BM25 over blocks of documents, and what is done with ranked lists: fusion and diverse choice.

Documents are indexed where they stand, without a shuffle: a task closes a block after BLOCK_DOCS documents or BLOCK_POSTINGS
postings and writes it as one row: ids and lengths of its documents, its terms in order, and by term the places of the documents
that have it and how often they do. Beside these stands a Parquet table in folders by the hash of the term, sorted by term, with a
row for each term and block: the greatest weight of the term in the block and how many documents have it there. A query's terms
open few folders of this table and few row groups, and it tells how many documents have a term and which blocks matter. A
batch of queries is answered in two rounds: each query's most promising block gives it a score that k documents reach, and
only blocks whose sum of greatest weights can reach some query's score are read and scored. A block is one task's work, for all
queries at once; a task keeps the k best of each query from block to block and skips the queries that a block has nothing for.
Only lists of blocks, weights of asked terms and k rows a query and task are ever shuffled.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vectorloom.errors import InvalidConfig
from vectorloom.operators.shared import checkpointed, rows_a_batch

K1, B = 1.2, 0.75
BLOCK_DOCS = 512
BLOCK_POSTINGS = 1 << 17  # a row of about a megabyte
FOLDERS = 64
ASKED_ROWS = 1_000_000  # terms of the queries that every task gets at once
TEXTS_A_BATCH, BLOCKS_A_BATCH = 500, 8  # rows that a task has in Python at once; a block is about a megabyte
BROADCAST_BLOCKS = 500_000  # numbers of blocks, 8 bytes each; a longer list is joined by a shuffle
ROW_GROUP = 8 << 20  # bytes, so that one task's blocks are read by several
RANK_CONSTANT = 60
_SLACK = 1e-9
_BLOCK = "block long, words long, ids array<{id}>, lengths array<long>, terms string, counts binary, places binary, tfs binary, folder int"
_MOST = "term string, block long, most double, n long, folder int"
_find = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case: runs of letters and digits. Null has none."""
    return _find(text.lower()) if text else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def words(texts: pd.Series) -> pd.Series:
    return texts.map(words_of)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, none below 0, in as few bytes each as the greatest needs."""
    return values.astype(np.min_scalar_type(values.max())).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}")


class _Block:
    """A block while a task fills it."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.ids, self.lengths, self.distinct, self.terms, self.tfs = [], [], [], [], []

    def add(self, doc: Any, found: list[str]) -> None:
        counts = Counter(found)
        self.ids.append(doc)
        self.lengths.append(len(found))
        self.distinct.append(len(counts))
        self.terms += [self.numbers.setdefault(t, len(self.numbers)) for t in counts]
        self.tfs += counts.values()

    def row(self, block: int, folders: int) -> tuple:
        terms = sorted(self.numbers)
        ranks = np.empty(len(terms), np.int64)
        ranks[[self.numbers[t] for t in terms]] = np.arange(len(terms))
        of = ranks[self.terms]
        order = np.argsort(of, kind="stable")
        places = np.repeat(np.arange(len(self.ids)), self.distinct)[order]
        counts = np.bincount(of, minlength=len(terms))
        # a task's blocks share a folder, so that none writes more than one file
        return block, sum(self.lengths), self.ids, self.lengths, "\n".join(terms), _packed(counts), _packed(places), _packed(np.array(self.tfs)[order]), (block >> 33) % folders


def _index(id_type: pa.DataType, block_docs: int, block_postings: int, folders: int):
    types = [pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 33, _Block()

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(block.row(number, folders), types, strict=True)], _names(_BLOCK))

        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                found = words_of(text.as_py())
                if not found:
                    continue
                block.add(doc, found)
                if len(block.ids) >= block_docs or len(block.terms) >= block_postings:
                    yield closed()
                    number, block = number + 1, _Block()
        if block.ids:
            yield closed()

    return run


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _postings(row: dict, mean: float) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: its terms, how many documents have each, where its postings end, and all postings' documents and weights before idf."""
    terms = row["terms"].split("\n")  # no term holds a line break
    counts = _unpacked(row["counts"], len(terms)).astype(np.int64)
    ends = np.cumsum(counts)
    places, tf = (_unpacked(row[c], int(ends[-1])) for c in ("places", "tfs"))
    tf, length = tf.astype(np.float64), np.asarray(row["lengths"], np.float64)[places]
    return terms, counts, ends, places, tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _maxima(mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            terms, counts, ends, _, weight = _postings(row, mean)
            most = np.maximum.reduceat(weight, ends - counts)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.full(len(terms), row["block"])), pa.array(most), pa.array(counts)], _names(_MOST)[:4])

    return run


class KeywordIndex:
    """The index that :meth:`build` wrote below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows, self.mean, self.folders, self._id = spark.read.parquet(f"{path}/corpus").first()
        self.blocks = spark.read.schema(_BLOCK.format(id=self._id)).parquet(f"{path}/blocks")
        self.maxima = spark.read.schema(_MOST).parquet(f"{path}/maxima")

    @classmethod
    def build(cls, docs: DataFrame, path: str, id_col: str = "id", text_col: str = "content", block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS, folders: int = FOLDERS) -> KeywordIndex:
        """Index the texts of ``docs``; texts without a word count for nothing and are never found. Ids should differ."""
        spark, kind = docs.sparkSession, docs.schema[id_col].dataType
        row = _BLOCK.format(id=kind.simpleString())
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        made = texts.mapInArrow(_index(to_arrow_type(kind), block_docs, block_postings, folders), row)
        with rows_a_batch(spark, TEXTS_A_BATCH):
            made.write.partitionBy("folder").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/blocks")
        held = spark.read.schema(row).parquet(f"{path}/blocks")
        n, total = (v or 0 for v in held.agg(F.sum(F.size("ids")), F.sum("words")).first())
        mean = total / n if n else 1.0
        spark.createDataFrame([(n, mean, folders, kind.simpleString())], "n long, mean double, folders int, id_type string").coalesce(1).write.parquet(f"{path}/corpus")
        maxima = held.select("block", "lengths", "terms", "counts", "places", "tfs").mapInArrow(_maxima(mean), _MOST.rsplit(", ", 1)[0])
        maxima = maxima.withColumn("folder", F.pmod(F.xxhash64("term"), F.lit(folders)).cast("int"))
        with rows_a_batch(spark, BLOCKS_A_BATCH):
            maxima.hint("rebalance", "folder").sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(f"{path}/maxima")
        return cls(spark, path)

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, folder, asked) of the terms that there are; ``asked`` is idf times occurrences in the query."""
        terms = queries.select("query_id", F.explode(words(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        terms = checkpointed(terms.withColumn("folder", F.pmod(F.xxhash64("term"), F.lit(self.folders)).cast("int")))
        found = self._having(self.maxima, terms)
        df = found.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (F.lit(self.rows) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return checkpointed(terms.join(df, "term").select("query_id", "term", "folder", (F.col("times") * idf).alias("asked")))

    def _of(self, rows: DataFrame, asked: DataFrame) -> DataFrame:
        """The rows of folders that have a term that is asked for; other folders are not opened."""
        opened = sorted(r[0] for r in asked.select("folder").distinct().collect())  # as many as there are folders at most
        return rows.filter(F.col("folder").isin(opened))

    def _having(self, rows: DataFrame, asked: DataFrame) -> DataFrame:
        """The rows whose term is asked for."""
        few = asked.count() <= ASKED_ROWS
        terms = asked.select("term", "folder").distinct()
        return self._of(rows, asked).join(F.broadcast(terms) if few else terms, ["term", "folder"], "left_semi")

    def _parts(self, queries: DataFrame) -> Iterator[tuple[DataFrame, list, dict[str, list[tuple[int, float]]]]]:
        """The batch in parts whose terms every task can hold: the part's terms, its query ids, and by term (query, asked)."""
        asked = self._asked(queries)
        n = max(1, -(-asked.count() // ASKED_ROWS))
        for i in range(n):
            part = asked if n == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)
            names, terms = {}, {}
            for r in part.orderBy("query_id", "term").collect():
                terms.setdefault(r["term"], []).append((names.setdefault(r["query_id"], len(names)), r["asked"]))
            if names:
                yield part, list(names), terms

    def _maxima_of(self, part: DataFrame) -> DataFrame:
        """The part's rows of the maxima, block by block within a task."""
        here = self._having(self.maxima, part).drop("folder")
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # named, or a later rule may deal the rows otherwise
        return checkpointed(here.repartition(tasks, "block").sortWithinPartitions("block", "term"))

    def opened(self, numbers: DataFrame) -> DataFrame:
        """The blocks with these numbers (``block``, each once), a row each; folders without one of them are not listed."""
        numbers = checkpointed(numbers.select("block", F.pmod(F.shiftright("block", 33), F.lit(self.folders)).cast("int").alias("folder")))
        few = numbers.count() <= BROADCAST_BLOCKS
        return self._of(self.blocks, numbers).join(F.broadcast(numbers.select("block")) if few else numbers.select("block"), "block", "left_semi")

    def blocks_in_reach(self, part: DataFrame, names: list, terms: dict, k: int) -> tuple[DataFrame, list[float]]:
        """(block) where a document of the k best of some query may be, and for each query a score that k documents reach."""
        maxima = self._maxima_of(part)
        tops = maxima.mapInPandas(_best_blocks(terms, len(names)), "query long, bound double, block long")
        first = tops.groupBy("query").agg(F.max_by("block", F.struct("bound", "block")).alias("block")).collect()  # one row a query
        wanted: dict[int, set[int]] = {}
        for r in first:
            wanted.setdefault(r["block"], set()).add(r["query"])
        chosen = self.opened(self.spark.createDataFrame([(b,) for b in wanted], "block long"))
        start = chosen.mapInArrow(_scores_of_blocks(terms, len(names), k, self.mean, self.blocks.schema["ids"].dataType, wanted=wanted), f"query long, id {self._id}, score double")
        with rows_a_batch(self.spark, BLOCKS_A_BATCH):
            reached = start.groupBy("query").agg(F.min("score").alias("score"), F.count("*").alias("n")).filter(F.col("n") == k).collect()
        floors = [0.0] * len(names)
        for r in reached:
            floors[r["query"]] = r["score"] * (1 - _SLACK)
        return maxima.mapInPandas(_blocks_in_reach(terms, floors), "block long"), floors

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank): the k best documents for each row of ``queries`` (``query_id``, ``query_text``) that have
        one of its words; equal scores by id. Query ids must differ.
        """
        if k < 1:
            raise InvalidConfig(f"k must be at least 1, got {k}")
        kind = queries.schema["query_id"].dataType.simpleString()
        found = self.spark.createDataFrame([], f"query_id {kind}, id {self._id}, score double")
        for part, names, terms in self._parts(queries):
            blocks, floors = self.blocks_in_reach(part, names, terms, k)
            best = self.opened(blocks).mapInArrow(_scores_of_blocks(terms, len(names), k, self.mean, self.blocks.schema["ids"].dataType, floors), f"query long, id {self._id}, score double")
            with rows_a_batch(self.spark, BLOCKS_A_BATCH):
                best = checkpointed(best)  # k rows a query and task
            numbers = self.spark.createDataFrame(list(enumerate(names)), f"query long, query_id {kind}")
            found = found.unionByName(best.join(F.broadcast(numbers), "query").select("query_id", "id", "score"))  # a row a query of the part
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def search(self, text: str, k: int) -> DataFrame:
        """(id, score, rank) for one query."""
        return self.search_batch(self.spark.createDataFrame([(0, text)], "query_id long, query_text string"), k).drop("query_id")


def _by_block(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of each block, which stand together but may begin in one batch and end in another."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for block, rows in batch.groupby("block", sort=False):
            if held and held[0]["block"].iloc[0] != block:
                yield held[0]["block"].iloc[0], pd.concat(held)
                held = []
            held.append(rows)
    if held:
        yield held[0]["block"].iloc[0], pd.concat(held)


def _bounds(terms: dict, n: int, names: Iterable[str], most: Iterable[float]) -> np.ndarray:
    """What no document of a block scores above, for each query."""
    out = np.zeros(n)
    for term, highest in zip(names, most, strict=True):
        for query, asked in terms[term]:
            out[query] += asked * highest
    return out


def _best_blocks(terms: dict, n: int):
    """Of each query the block of a task with the highest bound."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, where = np.zeros(n), np.zeros(n, np.int64)
        for block, rows in _by_block(batches):
            bounds = _bounds(terms, n, rows["term"], rows["most"])
            higher = bounds > best
            best[higher], where[higher] = bounds[higher], block
        some = np.flatnonzero(best)
        yield pd.DataFrame({"query": some, "bound": best[some], "block": where[some]})

    return run


def _blocks_in_reach(terms: dict, floors: list[float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = np.array(floors)
        for block, rows in _by_block(batches):
            bounds = _bounds(terms, len(floors), rows["term"], rows["most"])
            if ((bounds >= least) & (bounds > 0)).any():
                yield pd.DataFrame({"block": [block]})

    return run


def _scores_of_blocks(terms: dict, n: int, k: int, mean: float, ids_type: T.DataType, floors: list[float] | None = None, wanted: dict[int, set[int]] | None = None):
    """The k best documents a task has for each query; ``wanted`` names the queries of each block (None: all of all)."""
    by_query: list[list[tuple[str, float]]] = [[] for _ in range(n)]
    for term, asked in terms.items():
        for query, weight in asked:
            by_query[query].append((term, weight))
    id_type = to_arrow_type(ids_type).value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in range(n)]
        least = list(floors or [0.0] * n)
        for block in _rows(batches):
            ids = block["ids"]
            here, counts, ends, places, weight = _postings(block, mean)
            known = [(i, t) for i, t in enumerate(here) if t in terms]
            held = {t: (places[ends[i] - counts[i] : ends[i]], weight[ends[i] - counts[i] : ends[i]]) for i, t in known}
            bounds = _bounds(terms, n, held, (w.max() for _, w in held.values()))
            for query in sorted(wanted[block["block"]]) if wanted is not None else range(n):
                if bounds[query] * (1 + _SLACK) < least[query] or not bounds[query]:
                    continue
                scores = np.zeros(len(ids))
                for term, asked in by_query[query]:
                    if term in held:
                        at, w = held[term]
                        scores[at] += asked * w
                some = np.flatnonzero((scores >= least[query]) & (scores > 0))
                if len(some) > k:
                    some = some[scores[some] >= np.partition(scores[some], len(some) - k)[len(some) - k]]
                more = [(-scores[i], ids[i] is not None, ids[i]) for i in some.tolist()]
                best[query] = heapq.nsmallest(k, best[query] + more)
                if len(best[query]) == k:
                    least[query] = max(least[query], -best[query][-1][0])
        found = [(query, doc, -score) for query, rows in enumerate(best) for score, _, doc in rows]
        columns = [[r[i] for r in found] for i in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), id_type, pa.float64()), strict=True)], ["query", "id", "score"])

    return run


def fused(lists: Iterable[DataFrame], k: int, constant: int = RANK_CONSTANT) -> DataFrame:
    """(query_id, id, score, rank): the k best of several ranked lists (query_id, id, rank) by reciprocal ranks, 1 / (constant +
    rank) summed over the lists that have the row.
    """
    one = None
    for found in lists:
        part = found.select("query_id", "id", (1.0 / (constant + F.col("rank"))).alias("part"))
        one = part if one is None else one.unionByName(part)
    summed = one.groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return summed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def greedy_choice(scores: np.ndarray, vectors: np.ndarray, k: int, weight: float) -> list[int]:
    """Places of ``k`` rows, one after another: of greatest weight * score - (1 - weight) * cosine to the nearest one chosen."""
    lengths = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(lengths == 0, 1, lengths)[:, None]
    nearest, free, chosen = np.zeros(len(scores)), np.ones(len(scores), bool), []
    for turn in range(min(k, len(scores))):
        value = np.where(free, np.round(weight * scores - (1 - weight) * nearest, 12), -np.inf)
        place = int(value.argmax())  # the first of equals
        chosen.append(place)
        free[place] = False
        like = unit @ unit[place]
        nearest = like if turn == 0 else np.maximum(nearest, like)
    return chosen


def diverse(found: DataFrame, k: int, weight: float = 0.5, most: int = 10_000) -> DataFrame:
    """(query_id, id, score, rank): of each query's candidates (query_id, id, score, embedding) the ``k`` of greedy marginal
    relevance. Candidates are the few that a search gave; more than ``most`` for one query are refused.
    """
    if not 0 <= weight <= 1 or k < 0:
        raise InvalidConfig("weight must lie between 0 and 1, and k must not be negative")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > most:
            raise InvalidConfig(f"{len(rows)} candidates for one query; at most {most}")
        rows = rows.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        chosen = greedy_choice(rows["score"].to_numpy(np.float64), np.stack(rows["embedding"].to_numpy()).astype(np.float64), k, weight)
        return rows.loc[chosen, ["query_id", "id", "score"]].assign(rank=range(1, len(chosen) + 1))

    kinds = {c: found.schema[c].dataType.simpleString() for c in ("query_id", "id", "score")}
    rows = found.filter(F.col("embedding").isNotNull()).select("query_id", "id", "score", "embedding")
    return rows.groupBy("query_id").applyInPandas(run, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", rank int")
