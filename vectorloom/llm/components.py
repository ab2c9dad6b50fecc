"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of ``links`` (two LONG columns) with the smallest node reachable from it.

    A round hangs all larger neighbours of a node, then all smaller ones, below its smallest neighbour; rounds grow with
    the logarithm of a component's diameter. Each round is written to the shared folder. Nodes are counted before they
    are joined, so a star's centre costs one row per task there, and Spark may split its rows in the join.
    """
    pairs = cut(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi > lo").distinct())
    mark = None
    while True:
        both = pairs.select(F.col("hi").alias("x"), F.col("lo").alias("y")).union(pairs.select(F.col("lo"), F.col("hi")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(low, "x").select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select("hi", "lo", "m")
        pairs = cut(small.select("hi", F.col("m").alias("lo")).union(small.filter("lo > m").select("lo", "m")).distinct())
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == mark:
            break
        mark = now
    roots = pairs.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "node")
    return roots.union(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).join(roots.select("node"), "node", "left_anti").distinct())
