"""Merkle manifest of a dataset: a digest of every row, of every group of rows and of the whole, with a proof for each row.

Rows become leaves, leaves are ordered within their group, and runs of eight consecutive nodes become one node of the level
above until a group has a single node left, its subroot; subroots become the root likewise. A level is a window over
(group, number of the parent): a full-frame ``collect_list`` in order gives every node its run, which is both what the
parent is hashed from and where the node's siblings are. One row of each run goes on to the next level, so a level has an
eighth of the rows below it. Proofs are put together from the root down, once for each run, and a row's own path is only
spelled out in its last step. As digests have 64 digits each, a run is one string and a node's siblings are the digits
before and after its own.

Places within a group come from one sort of all rows by range: tasks number what they hold, and the counts of the tasks
(as many rows as there are tasks) say where each begins, so neither a large group nor the whole is ever in one task.
What is sorted are digests, not texts.

Defined cases: null columns count as ``-``, so null and empty text differ; null groups are a group, the first; rows of one
id are ordered by their leaves, null ids first; repeated rows are leaves of their own; a group of one row has its leaf as
subroot and an empty list of siblings at each level it does not have; an empty table gives an empty manifest; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.common import cut

FANOUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
BROADCAST_BYTES = 32 << 20  # of a table of groups that is sent to every task
_DIGITS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def row_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of a row's values, each with its length in bytes before it, so that no two rows spell the same."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed."""
    return F.translate(text, _UPPER, _LOWER)


def numbered(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows`` with their place from 0 in the whole table's order as ``at``, written to the shared folder.

    One sort by range; the driver sees one count per task. ``order`` should tell rows apart, as far as they differ.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, or a later rule may deal the rows otherwise
    ranged = cut(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    task, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    starts, total = [], 0
    for part, n in sorted(tuple(r) for r in ranged.groupBy(task.alias("part")).count().collect()):
        starts.append((part, total))
        total += n
    begins = rows.sparkSession.createDataFrame(starts, "part long, start long")
    return ranged.withColumn("part", task).join(F.broadcast(begins), "part").withColumn("at", F.col("start") + place).drop("_id", "part", "start")


class Level(NamedTuple):
    """Nodes of one level: ``runs`` (g, run, n, digits) of the groups that go on, ``tops`` (g, node) of those that end here."""

    runs: DataFrame | None
    tops: DataFrame


def _runs(nodes: DataFrame, fanout: int, kept: Sequence[str]) -> DataFrame:
    """(g, run, n, digits[, rows]) from (g, i, node, n, …kept): the window of a level, and one row of each run."""
    over = Window.partitionBy("g", "run").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = nodes.withColumn("run", F.expr(f"i div {fanout}")).withColumn("rows", F.collect_list(F.struct("node", *kept)).over(over))
    return whole.filter(F.col("i") % fanout == 0).select("g", "run", "n", F.array_join("rows.node", "").alias("digits"), *(["rows"] if kept else []))


def _climb(nodes: DataFrame, largest: int, fanout: int, kept: Sequence[str] = ()) -> list[Level]:
    """The levels above and with ``nodes`` (g, i, node, n, …kept), where ``n`` is the size of the group and ``largest`` its maximum."""
    levels = []
    while largest > 1:
        runs = cut(_runs(nodes.filter("n > 1"), fanout, kept))
        levels.append(Level(runs, nodes.filter("n = 1").select("g", "node", *kept)))
        up = F.expr(f"(n + {fanout - 1}) div {fanout}")
        nodes, largest, kept = runs.select("g", F.col("run").alias("i"), F.sha2("digits", 256).alias("node"), up.alias("n")), -(-largest // fanout), ()
    return [*levels, Level(None, nodes.select("g", "node", *kept))]


def _single(levels: list[Level]) -> DataFrame:
    """(g, node): the one node that each group ends in."""
    found = levels[0].tops.select("g", "node")
    for level in levels[1:]:
        found = found.unionByName(level.tops.select("g", "node"))
    return found


def _step(digits: Column, k: Column, path: Column) -> Column:
    """``path`` with what stands on either side of the k-th of a run's nodes before it."""
    left = F.substring(digits, F.lit(1), (k * _DIGITS).cast("int"))
    right = F.substring(digits, (k * _DIGITS + _DIGITS + 1).cast("int"), F.octet_length(digits))
    return F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), path)


def _paths(levels: list[Level], ends: DataFrame, fanout: int) -> DataFrame:
    """(g, i, end, path) of the nodes of the lowest of ``levels``: what lies beside the way from them to the root, where
    ``ends`` (g, end, path) has the way from each group's last node on.
    """
    paths = None
    for level in reversed(levels):
        here = level.tops.join(ends, "g").select("g", F.lit(0).cast("long").alias("i"), "end", "path")
        if level.runs is not None:
            last = F.expr(f"octet_length(digits) div {_DIGITS} - 1").cast("int")
            below = level.runs.join(paths.withColumnRenamed("i", "run"), ["g", "run"]).withColumn("k", F.explode(F.sequence(F.lit(0), last)))
            below = below.select("g", (F.col("run") * fanout + F.col("k")).alias("i"), "end", _step(F.col("digits"), F.col("k"), F.col("path")).alias("path"))
            here = here.unionByName(below)
        paths = here
    return paths


def _folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and what lies beside its way lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def _in_groups(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """(g, i, n, id, node, claimed) of ``rows`` (lang, id, leaf, claimed): each row's group by number and its place there;
    also how many groups there are, and the size of the largest.
    """
    order = [F.col("lang").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    placed = numbered(cut(rows.withColumn("tie", F.monotonically_increasing_id())), order)
    sizes = placed.groupBy("lang").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    groups = cut(numbered(sizes, [F.col("first")]).withColumnRenamed("at", "g"))
    n_groups, largest, size = groups.agg(F.count("*"), F.max("n"), F.sum(F.coalesce(F.octet_length("lang"), F.lit(0)) + 64)).first()
    beside = F.broadcast(groups) if (size or 0) <= BROADCAST_BYTES else groups
    joined = placed.alias("p").join(beside.alias("q"), F.col("p.lang").eqNullSafe(F.col("q.lang")))
    return joined.select("g", (F.col("at") - F.col("first")).alias("i"), "n", "id", F.col("leaf").alias("node"), "claimed"), n_groups, largest or 0


def manifest(leaves: DataFrame, group_col: str, id_col: str, claimed_col: str, fanout: int = FANOUT) -> DataFrame:
    """The manifest of ``leaves`` (group, id, ``leaf``, claimed leaf or null if it is the leaf): the id, ``leaf``, ``subroot``,
    ``root``, ``proof_sha256``, ``folded_root`` (of the claimed leaf and the siblings as they were), ``verified``.
    """
    spark = leaves.sparkSession
    rows = leaves.select(F.col(group_col).alias("lang"), F.col(id_col).alias("id"), "leaf", F.col(claimed_col).alias("claimed"))
    nodes, n_groups, largest = _in_groups(rows)
    levels = _climb(nodes, largest, fanout, ("id", "claimed"))
    subroots = cut(_single(levels))

    # The same over the subroots, which are one group in the order of their groups.
    zero, nothing = F.lit(0).cast("long"), F.expr("array()").cast(_PATH)
    top = _climb(subroots.select(zero.alias("g"), F.col("g").alias("i"), "node", F.lit(n_groups).cast("long").alias("n")), n_groups, fanout)
    found = _single(top).head()
    root = F.lit(found["node"] if found else None).cast("string")
    ends = _paths(top, spark.range(1).select(zero.alias("g"), F.lit(None).cast("string").alias("end"), nothing.alias("path")), fanout)
    ends = subroots.join(ends.select(F.col("i").alias("g"), "path"), "g").select("g", F.col("node").alias("end"), "path")

    # Down to the runs of leaves, and only there to the rows.
    out = levels[0].tops.join(ends, "g").select("id", "node", "claimed", "end", "path")
    if levels[0].runs is not None:
        above = _paths(levels[1:], ends, fanout).withColumnRenamed("i", "run")
        runs = levels[0].runs.join(above, ["g", "run"]).select("digits", "end", "path", F.posexplode("rows").alias("k", "row"))
        out = out.unionByName(runs.select("row.id", "row.node", "row.claimed", "end", _step(F.col("digits"), F.col("k"), F.col("path")).alias("path")))
    beside = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = _folded(F.coalesce("claimed", "node"), F.col("path"))
    out = out.select(F.col("id").alias(id_col), F.col("node").alias("leaf"), F.col("end").alias("subroot"), root.alias("root"), F.sha2(beside, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def verify_documents(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` by language, each row's proof tried with the row as it may have been tampered with: where 3
    divides the id's crc32, its text in lower case.
    """
    columns = [F.col(c) for c in COLUMNS]
    changed = [lowered(c) if name == "text" else c for name, c in zip(COLUMNS, columns, strict=True)]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaf = row_digest(columns)
    claimed = F.when(tampered, row_digest(changed))
    leaves = docs.select("lang", "doc_id", leaf.alias("leaf"), claimed.alias("claimed"))
    return manifest(leaves, "lang", "doc_id", "claimed")
