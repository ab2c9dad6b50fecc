"""Ranked lexical search by branch and bound over a hierarchical max tree.

Documents are indexed where they stand: a task reads its texts once and closes a shard after SHARD_DOCS documents or
SHARD_POSTINGS postings, so an index row is of bounded size, nothing is shuffled, and only shards go on from there. A shard
holds its documents' ids and lengths and, by term, the documents with the term and how often they have it. Number and
length of all documents, and how many hold each term, are sums over the shards.

With these known, a task makes the tree of a shard: over ranges of FANOUT documents, of FANOUT such ranges, and so on to the
whole shard, each node has for each term the most that any document below gives the term. What a query can get from a
node's documents is at most the sum over its terms of weight and this maximum. A search takes the node with the highest
bound from a queue and opens it, until the k-th best score so far is above all bounds left; nodes whose bound equals that
score are still opened, as a document below may have the same score and a smaller id. A task keeps the k best of each query
from shard to shard. Before that, all shards are ranked by the bounds of their topmost nodes: each query first searches the one
shard with its highest bound, and its k-th score there is where every task starts from. Only k rows a query leave a task.

All arithmetic after the weights is in 64-bit integers, so a bound is exact and no result is lost to rounding.

Defined cases: null and empty texts, and texts without a term, count neither for N nor for lengths and are never found; a query
without terms, or with terms that no document holds, has no rows; repeated documents are found each, equal scores ascend
by document id with null ids first; rows of one query id are searched each by itself; an empty table on either side gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vectorloom.llm.common import as_bytes, cut, remove, shared_dir, tidy

K = 20
FANOUT = 16
SHARD_DOCS = FANOUT**3
SHARD_POSTINGS = 1 << 19
ASKED_TERMS = 1 << 20  # terms of a block of queries, which is sent to every task

# A term is a run of letters and digits and of anything beyond ASCII, with A-Z in lower case. In UTF-8 that
# can be said of bytes.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SCALE = 1000

SHARD = "shard long, docs long, tokens long, terms array<binary>, counts array<int>, ids array<{id}>, lengths array<long>, places binary, freqs binary"


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term gives a document before its weight, in whole numbers."""
    m = 100 - 25 + (25 * length * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class _Shard:
    """A shard while a task fills it."""

    def __init__(self):
        self.ids, self.lengths, self.postings, self.size, self.tokens, self.docs = [], [], {}, 0, 0, 0

    def add(self, doc: Any, found: dict[bytes, int], length: int) -> None:
        self.docs += 1
        self.tokens += length
        if not found:
            return
        place = len(self.ids)
        self.ids.append(doc)
        self.lengths.append(length)
        self.size += len(found)
        for term, tf in found.items():
            self.postings.setdefault(term, []).append((place, tf))

    def row(self, number: int) -> tuple:
        terms = sorted(self.postings)
        pairs = [p for t in terms for p in self.postings[t]]
        both = np.array(pairs, np.int32).reshape(-1, 2)
        return number, self.docs, self.tokens, terms, [len(self.postings[t]) for t in terms], self.ids, self.lengths, both[:, 0].tobytes(), both[:, 1].tobytes()


def _index(only: frozenset[bytes] | None, id_type: pa.DataType, shard_docs: int, shard_postings: int):
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in SHARD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, shard = TaskContext.get().partitionId() << 33, 0, _Shard()

        def closed() -> pa.RecordBatch:
            row = shard.row(base + made)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for doc, raw in zip(batch.column("id").to_pylist(), batch.column("raw"), strict=True):
                words = terms_of(raw.as_py())
                if not words:
                    continue
                found = Counter(words)
                shard.add(doc, {t: n for t, n in found.items() if t in only} if only is not None else found, len(words))
                if len(shard.ids) >= shard_docs or shard.size >= shard_postings:
                    yield closed()
                    made, shard = made + 1, _Shard()
        if shard.docs:
            yield closed()

    return tidy(run)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", only: frozenset[bytes] | None = None, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """Write the shards (SHARD) of ``docs`` to ``path``. ``only`` keeps postings of these terms alone; counts are of all terms.

    Reading is one pass without a shuffle; a shard's row is a few megabytes at most.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), as_bytes(F.col(text_col)).alias("raw"))
    shards = rows.mapInArrow(_index(only, to_arrow_type(kind), shard_docs, shard_postings), SHARD.format(id=kind.simpleString()))
    shards.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


class Tree:
    """The max tree of one shard: per level the keys ``term * width + node`` in order, and the maximum of each."""

    def __init__(self, counts: np.ndarray, places: np.ndarray, impacts: np.ndarray, docs: int):
        width = FANOUT
        while width < docs:
            width *= FANOUT
        keys = np.repeat(np.arange(len(counts), dtype=np.int64) * width, counts) + places
        self.levels = [(width, keys, impacts)]
        while width > 1:
            width //= FANOUT
            keys = keys // FANOUT
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            impacts = np.maximum.reduceat(impacts, first) if len(first) else impacts
            keys = keys[first]
            self.levels.append((width, keys, impacts))
        self.tops = np.zeros(len(counts), np.int64)
        self.tops[keys] = impacts  # the topmost level has one node a term

    def children(self, level: int, node: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The bounds (at level 1: the scores) of a node's FANOUT children, for a query's terms and weights."""
        width, keys, values = self.levels[level - 1]
        begin = terms * width + node * FANOUT
        lo, hi = np.searchsorted(keys, begin), np.searchsorted(keys, begin + FANOUT)
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        out = np.zeros(FANOUT, np.int64)
        np.add.at(out, keys[at] - np.repeat(begin, n), values[at] * np.repeat(weights, n))
        return out


class Query(NamedTuple):
    number: int  # of the row
    terms: list[bytes]
    weights: np.ndarray  # of each term, times its occurrences in the query


class Best:
    """The k best (score, id) of a query; ``floor`` is a score that k documents are known to reach."""

    def __init__(self, k: int, floor: int = 0):
        self.k, self.floor, self.rows = k, floor, []

    def least(self) -> int:
        """A document below this score is not among the k best; one with this score may be."""
        return max(self.floor, self.rows[-1][0] if len(self.rows) == self.k else 0, 1)

    def add(self, found: list[tuple[int, Any]]) -> None:
        rows = self.rows + found
        rows.sort(key=lambda r: (-r[0], r[1] is not None, r[1]))
        self.rows = rows[: self.k]


def search_shard(tree: Tree, ids: list, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Best-first branch and bound for one query; the number of opened nodes."""
    top = len(tree.levels) - 1
    queue = [(-int(weights @ tree.tops[terms]), top, 0)]
    opened = 0
    while queue:
        bound, level, node = heapq.heappop(queue)
        if -bound < best.least():
            break
        opened += 1
        values = tree.children(level, node, terms, weights)
        good = np.flatnonzero(values >= best.least())
        if level == 1:
            best.add([(int(values[c]), ids[node * FANOUT + c]) for c in good])
        else:
            for c in good:
                heapq.heappush(queue, (-int(values[c]), level - 1, node * FANOUT + int(c)))
    return opened


def _shards(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int) -> Iterator[tuple[int, dict[bytes, int], Tree, list]]:
    for batch in batches:
        for r in range(batch.num_rows):
            row = {name: batch.column(name)[r] for name in batch.schema.names}
            places, freqs = (np.frombuffer(row[c].as_py(), np.int32).astype(np.int64) for c in ("places", "freqs"))
            ids, lengths, counts = row["ids"].as_py(), np.array(row["lengths"].as_py(), np.int64), np.array(row["counts"].as_py(), np.int64)
            if len(ids):
                tree = Tree(counts, places, impact(freqs, lengths[places], n_docs, n_terms), len(ids))
                yield row["shard"].as_py(), {t: i for i, t in enumerate(row["terms"].as_py())}, tree, ids


def _asked(query: Query, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    have = [(known[t], w) for t, w in zip(query.terms, query.weights, strict=True) if t in known]
    return np.array([t for t, _ in have], np.int64), np.array([w for _, w in have], np.int64)


def _top_bounds(queries: list[Query], n_docs: int, n_terms: int):
    """Of each query the shard of a task with the highest bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(len(queries), np.int64)
        where = np.zeros(len(queries), np.int64)
        for shard, known, tree, _ in _shards(batches, n_docs, n_terms):
            for i, query in enumerate(queries):
                terms, weights = _asked(query, known)
                bound = int(weights @ tree.tops[terms])
                if bound > best[i]:
                    best[i], where[i] = bound, shard
        some = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array([queries[i].number for i in some], pa.int64()), pa.array(best[some]), pa.array(where[some])], ["query", "bound", "shard"])

    return tidy(run)


def _search(queries: list[Query], k: int, n_docs: int, n_terms: int, floors: dict[int, int], wanted: dict[int, set[int]] | None, id_type: pa.DataType):
    """The k best documents a task has for each query; ``wanted`` names the queries of each shard (None: all of all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {q.number: Best(k, floors.get(q.number, 0)) for q in queries}
        for shard, known, tree, ids in _shards(batches, n_docs, n_terms):
            for query in queries:
                if wanted is None or query.number in wanted.get(shard, ()):
                    terms, weights = _asked(query, known)
                    if len(terms):
                        search_shard(tree, ids, terms, weights, best[query.number])
        rows = [(number, doc, score) for number, b in best.items() for score, doc in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64())], ["query", "doc", "score"])

    return tidy(run)


def _best_rows(found: DataFrame, k: int) -> DataFrame:
    over = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)


def _ask_block(shards: DataFrame, queries: list[Query], k: int, n_docs: int, n_terms: int, id_name: str, id_type: pa.DataType) -> DataFrame:
    """(query, doc, score, rank) of a block of queries."""
    schema = f"query long, doc {id_name}, score long"
    tops = shards.mapInArrow(_top_bounds(queries, n_docs, n_terms), "query long, bound long, shard long")
    first = tops.groupBy("query").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard")).collect()  # one row a query of the block
    wanted: dict[int, set[int]] = {}
    for r in first:
        wanted.setdefault(r["shard"], set()).add(r["query"])
    start = shards.filter(F.col("shard").isin(list(wanted))).mapInArrow(_search(queries, k, n_docs, n_terms, {}, wanted, id_type), schema)
    reached = start.groupBy("query").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") == k)
    floors = {r["query"]: r["floor"] for r in reached.collect()}
    return _best_rows(shards.mapInArrow(_search(queries, k, n_docs, n_terms, floors, None, id_type), schema), k)


def _counted(raw: bytes | None) -> Counter:
    return Counter(terms_of(raw or b""))


def search(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", block_terms: int = ASKED_TERMS) -> DataFrame:
    """(query id, ``rank``, ``doc_id``, ``score``): the ``k`` documents of highest score above 0 for each row of ``queries``.

    Queries are asked in blocks of at most ``block_terms`` terms (or one query, if that has more), each against all documents;
    the index of a block has the postings of its terms. The driver holds a block.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    asked = cut(queries.select(F.monotonically_increasing_id().alias("query"), F.col(query_id).alias("item"), as_bytes(F.col(query_text)).alias("raw")))
    parts, block, size = [], [], 0
    for row in asked.select("query", "raw").toLocalIterator():
        found = _counted(bytes(row["raw"]))
        if block and size + len(found) > block_terms:
            parts.append(_block(docs, block, k, id_col, text_col))
            block, size = [], 0
        if found:
            block.append((row["query"], found))
            size += len(found)
    parts.append(_block(docs, block, k, id_col, text_col))
    best = parts[0]
    for more in parts[1:]:
        best = best.unionByName(more)
    named = best.join(asked.select("query", "item"), "query")
    return named.select(F.col("item").alias(query_id), "rank", F.col("doc").alias("doc_id"), "score")


def _block(docs: DataFrame, block: list[tuple[int, Counter]], k: int, id_col: str, text_col: str) -> DataFrame:
    """One block of queries: index, counts, search; the index is removed when its rows are found."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    schema = f"query long, doc {kind.simpleString()}, score long, rank int"
    if not block or not k:
        return spark.createDataFrame([], schema)
    path = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    shards = build_index(docs, path, id_col, text_col, frozenset(t for _, found in block for t in found))
    n_docs, n_terms = (v or 0 for v in shards.agg(F.sum("docs"), F.sum("tokens")).first())
    if not n_docs:
        return spark.createDataFrame([], schema)
    held = shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.counts").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = {bytes(r["term"]): r["w"] for r in held.select("term", weight.alias("w")).collect()}  # the block's terms at most
    asked = []
    for number, found in block:
        known = [t for t in found if weights.get(t)]
        asked.append(Query(number, known, np.array([found[t] * weights[t] for t in known], np.int64)))
    best = cut(_ask_block(shards, asked, k, n_docs, n_terms, kind.simpleString(), to_arrow_type(kind)))
    remove(spark, path)
    return best
