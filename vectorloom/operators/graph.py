"""Neighbour graph: each vector with some that are near to it, and searches that walk along its links.

The graph starts from random hyperplanes: vectors on the same side of all planes, in groups of bounded size, are compared with
each other. Rounds then compare the neighbours of each vector among themselves, for a neighbour's neighbour is likely one's own,
and keep the DEGREE best of each. At last links are added backwards, a bounded number a vector, so that walks can go both
ways. No vector ever has more than twice DEGREE links, and what is compared at once is a vector's links.

A batch of queries walks together, a round at a time: of each query's best vectors so far the best few that were not opened are
joined with the graph, what they lead to is scored, and the best BREADTH stay. A query is done when all its best are opened.
Results are approximate; :mod:`vectorloom.operators.ivf` has exact ones. All of it is joins and windows over tables in the
shared folder; joins shuffle both sides, so that no round sends a table through the driver, which sees whether a round has
rows left.

Vectors of other lengths than the commonest one, and with parts that are not numbers (under the cosine also those of no length),
are not in the graph; each query is compared with all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.errors import InvalidConfig
from vectorloom.functions.vectors import similarity
from vectorloom.operators import search
from vectorloom.operators.shared import checkpointed
from vectorloom.types import DistanceMetric

DEGREE = 16
GROUP = 128  # vectors that are compared with each other at the start
PLANES = 3  # sets of hyperplanes
ROUNDS = 3
BREADTH = 64
OPENED = 12  # of a query's best in a round
ENTRIES = 1024  # vectors from which walks begin
MOST_ROUNDS = 40


def _pair_scores(metric: DistanceMetric, x: np.ndarray) -> np.ndarray:
    """Scores of all pairs of some rows, by matrix products where there is one; only their order matters."""
    if metric is DistanceMetric.MANHATTAN:
        return -np.abs(x[:, None, :] - x[None, :, :]).sum(2)
    if metric is DistanceMetric.COSINE:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    product = x @ x.T
    if metric is DistanceMetric.EUCLIDEAN:
        size = (x**2).sum(1)
        return 2 * product - size[:, None] - size[None, :]
    return product


def _nearest_of_each(metric: DistanceMetric, degree: int):
    """Rows with ``members`` (id, embedding): the ``degree`` best others of each member, as (id, near, score)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, near, scores = [], [], []
            for members in batch["members"]:
                if len(members) < 2:
                    continue
                names = np.array([m["id"] for m in members], object)
                s = _pair_scores(metric, np.array([m["embedding"] for m in members], np.float64))
                np.fill_diagonal(s, -np.inf)
                n = min(degree, len(names) - 1)
                best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                ids.append(np.repeat(names, n))
                near.append(names[best].ravel())
                scores.append(np.take_along_axis(s, best, 1).ravel())
            if ids:
                yield pd.DataFrame({"id": np.concatenate(ids), "near": np.concatenate(near), "score": np.concatenate(scores)})

    return run


def _best_links(links: DataFrame, degree: int) -> DataFrame:
    once = links.groupBy("id", "near").agg(F.max("score").alias("score"))
    best = Window.partitionBy("id").orderBy(F.desc("score"), "near")
    return once.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= degree).drop("_n")


def _backwards(links: DataFrame, degree: int) -> DataFrame:
    """Links the other way, the ``degree`` best of each vector, however many lead to it."""
    turned = links.select(F.col("near").alias("id"), F.col("id").alias("near"), "score")
    best = Window.partitionBy("id").orderBy(F.desc("score"), "near")
    return turned.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= degree).drop("_n")


def _fits(metric: DistanceMetric, size: int):
    fit = (F.size("embedding") == size) & F.forall("embedding", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    return fit & F.exists("embedding", lambda v: v != 0) if metric is DistanceMetric.COSINE else fit


class NeighbourGraph:
    """The graph that :meth:`build` wrote below ``path``."""

    def __init__(self, spark: SparkSession, path: str, metric: DistanceMetric):
        self.spark, self.metric = spark, metric
        self.vectors, self.others = (spark.read.parquet(f"{path}/{n}") for n in ("vectors", "others"))
        self.links = spark.read.parquet(f"{path}/links")

    @classmethod
    def build(cls, docs: DataFrame, path: str, metric: DistanceMetric = DistanceMetric.COSINE, degree: int = DEGREE, rounds: int = ROUNDS, seed: int = 0) -> NeighbourGraph:
        """The graph of the rows of ``docs`` (``id``, ``embedding``) that have an embedding. Ids must differ."""
        if degree < 1:
            raise InvalidConfig(f"degree must be at least 1, got {degree}")
        spark = docs.sparkSession
        rows = docs.filter(F.col("embedding").isNotNull()).select("id", "embedding")
        common = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
        size = common["size"] if common else 0
        fit = _fits(metric, size)
        rows.filter(fit).write.parquet(f"{path}/vectors")
        rows.filter(~fit).write.parquet(f"{path}/others")
        vectors = spark.read.parquet(f"{path}/vectors")
        kind = vectors.schema["id"].dataType.simpleString()
        compare = _nearest_of_each(metric, degree)
        links = None
        for turn in range(PLANES):
            found = cls._grouped(vectors, size, seed + turn).mapInPandas(compare, f"id {kind}, near {kind}, score double")
            links = found if links is None else links.unionByName(found)
        links = checkpointed(_best_links(links, degree))
        for _ in range(rounds):
            around = links.select("id", "near").union(_backwards(links, degree).select("id", "near")).union(vectors.select("id", F.col("id").alias("near"))).distinct()
            members = around.hint("merge").join(vectors.withColumnRenamed("id", "near"), "near")
            members = members.groupBy("id").agg(F.collect_list(F.struct(F.col("near").alias("id"), "embedding")).alias("members"))  # at most twice the degree and one
            found = members.select("members").mapInPandas(compare, f"id {kind}, near {kind}, score double")
            links = checkpointed(_best_links(links.unionByName(found), degree))
        both = links.select("id", "near").union(_backwards(links, degree).select("id", "near")).distinct()
        both.groupBy("id").agg(F.collect_list("near").alias("near")).write.parquet(f"{path}/links")
        return cls(spark, path, metric)

    @staticmethod
    def _grouped(vectors: DataFrame, size: int, seed: int) -> DataFrame:
        """Rows of ``members`` that lie on the same sides of random planes through the mean; crowded sides are dealt out by id."""
        n = vectors.count()
        bits = max(0, math.ceil(math.log2(max(1, n / GROUP))))
        planes = np.random.default_rng(seed).normal(size=(bits, size))
        mean = vectors.select(F.posexplode("embedding").alias("at", "x")).groupBy("at").agg(F.avg("x")).collect()  # a row a dimension
        middle = np.array([x for _, x in sorted(tuple(r) for r in mean)]) if mean else np.zeros(size)

        def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = np.stack(batch["embedding"].to_numpy()).astype(np.float64) - middle
                    yield batch.assign(side=((x @ planes.T) > 0).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64)))

        kind, vector = (vectors.schema[c].dataType.simpleString() for c in ("id", "embedding"))
        placed = checkpointed(vectors.mapInPandas(sides, f"id {kind}, embedding {vector}, side long"))
        parts = placed.groupBy("side").agg(F.ceil(F.count("*") / (2 * GROUP)).alias("parts"))
        placed = placed.hint("merge").join(parts, "side").withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts")))
        return placed.groupBy("side", "part").agg(F.collect_list(F.struct("id", "embedding")).alias("members")).select("members")

    def search_batch(self, queries: DataFrame, k: int, breadth: int = BREADTH, kind: str = "float") -> DataFrame:
        """(query_id, id, score, rank): about the k best vectors for each row of ``queries`` (``query_id``, ``query_vec``)."""
        if k < 0 or breadth < 1:
            raise InvalidConfig("k must not be negative, and breadth at least 1")
        breadth = max(breadth, k)
        asked = checkpointed(queries.select("query_id", "query_vec"))
        score = similarity(self.metric, F.col("embedding"), F.col("query_vec"), "double")
        entries = checkpointed(self.vectors.orderBy(F.xxhash64("id"), "id").limit(ENTRIES))
        order = [F.isnan("score"), F.desc("score"), "id"]
        best, turn = (Window.partitionBy(*by).orderBy(*order) for by in (["query_id"], ["query_id", "open"]))

        def kept(state: DataFrame) -> DataFrame:
            """Each query's best, and which of them are opened next: marked here, as a round that joined its state with a part of
            it would square Spark's estimate of the state's size, a number of ever more digits that the driver computes."""
            state = state.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= breadth).drop("_n")
            return checkpointed(state.withColumn("next", F.col("open") & (F.row_number().over(turn) <= OPENED)))

        near = F.broadcast(entries)  # at most ENTRIES vectors
        state = kept(asked.join(near).select("query_id", "id", score.alias("score"), F.lit(True).alias("open")))
        for _ in range(MOST_ROUNDS):
            led = state.filter("next").select("query_id", "id").hint("merge").join(self.links, "id").select("query_id", F.explode("near").alias("id")).distinct()
            led = led.hint("merge").join(state.select("query_id", "id"), ["query_id", "id"], "left_anti")
            found = led.hint("merge").join(self.vectors, "id").hint("merge").join(asked, "query_id").select("query_id", "id", score.alias("score"), F.lit(True).alias("open"))
            state = kept(state.select("query_id", "id", "score", (F.col("open") & ~F.col("next")).alias("open")).unionByName(found))
            if state.filter("open").isEmpty():
                break
        found = state.drop("open", "next")
        if not self.others.isEmpty():  # or the batch need not come to the driver
            found = found.unionByName(search.top_k_scan(self.others, asked, k, self.metric, "double").drop("rank"))
        return search.ranked_best(found.withColumn("score", F.col("score").cast(kind)), k, kind)
