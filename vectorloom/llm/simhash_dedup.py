"""SimHash near-dedup with a hierarchical index in Gray order.

Fingerprints are sorted by Gray rank, so that neighbours in the order share bit patterns. The patterns shared by the
leading bits form the nodes of a tree: the upper nodes split the sorted fingerprints into groups of bounded size (a
group that is still too large is split by more bits), the lower ones are built inside a task. Two nodes are compared by
the bits both masks hold; once these differ in more than the radius, all fingerprints below are pruned together. Pairs of
groups that survive are dealt to tasks, and each task walks the two groups' lower nodes down at once. A task reports
the links it finds as a forest (a star for each connected set), so thousands of near copies yield as many rows, not
their square. Stars of all tasks are joined to components by :func:`connected_components`.

What driver and tasks hold of the tree is one entry per group of at least ``group_size`` fingerprints, a depth and a
prefix; groups grow with the table up to 8 times that. A fingerprint is sent once to each group whose prefix of ``b`` bits
differs from its own in at most three: 42 of 64 groups at b = 6 (8 to 67 million texts), 299 of 4,096 at b = 12 (4 billion).

Defined cases: null text counts as empty; a text without words has fingerprint zero and is linked like any other; a null
id is the smallest of none (a component of null ids only has a null component id); repeated rows link, and
:func:`drop_near_duplicates` keeps one of them; an empty table gives an empty result; other columns of the input are
ignored, and kept by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import as_bytes, cut, private_prefix, release_memory, tidy
from vectorloom.llm.components import connected_components

SHINGLE, SEED, RADIUS = 3, 42, 3  # fixed values of the contract
GROUP_SIZE = 1 << 17
_STEP = 4  # bits by which one level of nodes is longer than the one above
_FRONTIER = 1 << 19
_RUN = 1 << 15
_DEALT = 1 << 10


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; zero without words."""
    words = raw.lower().split()  # for bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    text, digest = b" ".join(words), xxhash.xxh64_digest
    ends = list(accumulate([len(w) + 1 for w in words]))
    size = min(shingle, len(words))
    count = len(words) - size + 1
    votes = np.zeros(64, np.int64)
    for k in range(0, count, _RUN):  # long texts a run at a time
        stop = min(k + _RUN, count)
        starts = [ends[k - 1] if k else 0, *ends[k : stop - 1]]
        hashes = [digest(text[a : b - 1], SEED) for a, b in zip(starts, ends[k + size - 1 : stop + size - 1], strict=True)]
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(votes * 2 > count).tobytes(), "big", signed=True)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py(), shingle) for x in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("text_hash"), pa.array(prints, pa.int64())], ["row", "id", "text_hash", "fp"])

    return tidy(run)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(row, id, text_hash, fp), one row per input row."""
    body = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), _text_hash(F.col(text_col)).alias("text_hash"), as_bytes(F.col(text_col)).alias("body"))
    return body.mapInArrow(_fingerprints(shingle), f"row long, id {body.schema['id'].dataType.simpleString()}, text_hash long, fp long")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray sequence. Its leading bits depend on the code's leading bits only."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


def _rank_column(fp):
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def upper_nodes(prints: DataFrame, group_size: int = GROUP_SIZE) -> list[tuple[int, int]]:
    """(depth, Gray prefix) of the groups that the distinct fingerprints fall into, in Gray order."""
    ranked = prints.select(_rank_column(F.col("fp")).alias("rank"))
    total, depth, nodes = ranked.count(), 0, []
    group_size = min(max(group_size, total >> 6), group_size << 3)
    while depth < 40 and total > group_size << depth:
        depth += 1
    while True:
        prefix = F.shiftrightunsigned("rank", 64 - depth) if depth else F.lit(0).cast("long")
        found = ranked.groupBy(prefix.alias("prefix")).count().collect()
        nodes += [(depth, r["prefix"]) for r in found if r["count"] <= 2 * group_size or depth >= 60]
        heavy = [(r["prefix"],) for r in found if r["count"] > 2 * group_size and depth < 60]
        if not heavy:
            return sorted(nodes, key=lambda n: n[1] << (64 - n[0]))
        few = prints.sparkSession.createDataFrame(heavy, "prefix long")
        ranked = ranked.withColumn("prefix", prefix).join(F.broadcast(few), "prefix", "left_semi").select("rank")
        depth += _STEP


class NodePartners:
    """For a node of the upper tree, the nodes (itself included) whose shared pattern differs by at most ``radius`` bits.

    Nodes are looked up by their patterns with up to ``radius`` bits turned, so no two nodes are compared that are not near.
    """

    def __init__(self, nodes: list[tuple[int, int]], radius: int):
        self.depth = np.array([d for d, _ in nodes], np.int64)
        self.gray = np.array([p ^ (p >> 1) for _, p in nodes], np.uint64)
        self.by_depth = {}
        for d in np.unique(self.depth).tolist():
            here = np.flatnonzero(self.depth == d)
            here = here[np.argsort(self.gray[here])]
            turned = [sum(1 << b for b in bits) for n in range(min(radius, d) + 1) for bits in combinations(range(d), n)]
            self.by_depth[d] = (here, self.gray[here], np.array(turned, np.uint64))

    def of(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``asked``, partner), each near pair of nodes once."""
        places, partners = [], []
        for d, (here, patterns, turned) in self.by_depth.items():
            # a node at least as deep finds those of depth d by its own leading bits
            deep = np.flatnonzero(self.depth[asked] >= d)
            lead = self.gray[asked[deep]] >> (self.depth[asked[deep]] - d).astype(np.uint64)
            for k in range(0, len(deep), 256):
                sought = lead[k : k + 256, None] ^ turned
                at = np.minimum(np.searchsorted(patterns, sought), len(patterns) - 1)
                i, j = np.nonzero(patterns[at] == sought)
                places.append(deep[k + i])
                partners.append(here[at[i, j]])
            # a shorter one is looked up among the leading bits of those of depth d
            for low in {x for x in self.depth[asked].tolist() if x < d}:
                short = np.flatnonzero(self.depth[asked] == low)
                leading = patterns >> np.uint64(d - low)  # still in order
                for i in short:
                    sought = self.gray[asked[i]] ^ self.by_depth[low][2]
                    first, end = np.searchsorted(leading, sought, "left"), np.searchsorted(leading, sought, "right")
                    found = np.repeat(first - np.concatenate([[0], np.cumsum(end - first)[:-1]]), end - first) + np.arange((end - first).sum())
                    places.append(np.full(len(found), i))
                    partners.append(here[found])
        return np.concatenate(places), np.concatenate(partners)


def _deal(nodes: list[tuple[int, int]], radius: int):
    """Send every fingerprint to each surviving pair of its group: (pair, second, fp)."""
    starts = np.array([p << (64 - d) for d, p in nodes], np.uint64)
    near = NodePartners(nodes, radius)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            if not len(fp):
                continue
            own = np.searchsorted(starts, gray_rank(fp.view(np.uint64)), "right") - 1
            groups, place = np.unique(own, return_inverse=True)
            asked, partners = near.of(groups)
            order = np.argsort(asked, kind="stable")
            partners, count = partners[order], np.bincount(asked, minlength=len(groups))
            offsets = np.cumsum(count) - count
            for k in range(0, len(fp), _DEALT):  # bounded, as each fingerprint leaves many times
                mine = place[k : k + _DEALT]
                n = count[mine]
                at = np.repeat(np.arange(len(mine)), n)
                other = partners[np.repeat(offsets[mine] - (np.cumsum(n) - n), n) + np.arange(len(at))]
                group = groups[mine][at]
                yield pd.DataFrame({"pair": np.minimum(group, other) << 32 | np.maximum(group, other), "second": other < group, "fp": fp[k : k + _DEALT][at]})

    return tidy(run)


class _Levels:
    """The lower nodes of one group: at each level the runs of Gray-sorted fingerprints that share the leading bits."""

    def __init__(self, codes: np.ndarray, depths: list[int]):
        self.codes, self.first, self.pattern = codes, [], []
        for t in depths:
            lead = codes >> np.uint64(64 - t)
            first = np.concatenate([[0], np.flatnonzero(lead[1:] != lead[:-1]) + 1])
            self.first.append(first)
            self.pattern.append(lead[first])
        # children of node k at a level: child[k] to child[k + 1] at the next
        self.child = [np.append(np.searchsorted(b, a), len(b)) for a, b in zip(self.first, self.first[1:], strict=False)]


def near_pairs(left: np.ndarray, right: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of index pairs (into Gray-sorted ``left`` and ``right``; within ``left`` if None) at most ``radius`` bits apart.

    Both trees are walked down together, a bounded part of the frontier at a time.
    """
    told = [next((t for t in range(_STEP, 64, _STEP) if len(np.unique(c >> np.uint64(64 - t))) == len(c)), 64) for c in (left, left if right is None else right)]
    depths = [*range(_STEP, min(max(told) + 1, 64), _STEP), 64]
    a = _Levels(left, depths)
    b = a if right is None else _Levels(right, depths)
    last = len(depths) - 1

    def near(level: int, x: np.ndarray, y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        keep = np.bitwise_count(a.pattern[level][x] ^ b.pattern[level][y]) <= radius
        if right is None:
            keep &= x < y if level == last else x <= y
        return level, x[keep], y[keep]

    n, m = len(a.pattern[0]), len(b.pattern[0])
    stack = [near(0, np.repeat(np.arange(n), m), np.tile(np.arange(m), n))]
    while stack:
        level, x, y = stack.pop()
        if not len(x):
            continue
        if level == last:
            yield x, y
            continue
        width = b.child[level][y + 1] - b.child[level][y]
        size = (a.child[level][x + 1] - a.child[level][x]) * width
        first = int(np.searchsorted(np.cumsum(size), _FRONTIER)) + 1  # at least one, however wide
        if first < len(x):
            stack.append((level, x[first:], y[first:]))
        x, y, width, size = x[:first], y[:first], width[:first], size[:first]
        at = np.repeat(np.arange(len(x)), size)
        k = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        stack.append(near(level + 1, a.child[level][x[at]] + k // width[at], b.child[level][y[at]] + k % width[at]))


def _hook(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the sets of x[i] and y[i]; a set is named by its smallest member."""
    while len(x):
        a, b = label[x], label[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _links(radius: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sides = [frame["fp"].to_numpy()[frame["second"].to_numpy() == s].view(np.uint64) for s in (False, True)]
        left, right = (codes[np.argsort(gray_rank(codes))] for codes in sides)
        pair = int(frame["pair"].iloc[0])
        alone = pair >> 32 == pair & 0xFFFFFFFF
        out = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if not len(left) or (not alone and not len(right)):
            return out
        codes = left if alone else np.concatenate([left, right])
        label = np.arange(len(codes))
        for x, y in near_pairs(left, None if alone else right, radius):
            _hook(label, x, y if alone else y + len(left))
        member = np.flatnonzero(label != np.arange(len(codes)))
        codes = codes.view(np.int64)
        return pd.DataFrame({"a": codes[label[member]], "b": codes[member]})

    return run


def link_forest(prints: DataFrame, radius: int = RADIUS, group_size: int = GROUP_SIZE) -> DataFrame:
    """(a, b): fingerprints joined by links, a forest per pair of groups. ``prints`` has distinct fingerprints ``fp``."""
    nodes = upper_nodes(prints, group_size)
    dealt = prints.select("fp").mapInPandas(_deal(nodes, radius), "pair long, second boolean, fp long")
    run = _links(radius)

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        found = run(frame)
        release_memory()
        return found

    return dealt.groupBy("pair").applyInPandas(links, "a long, b long")


def _classes(docs: DataFrame, id_col: str, text_col: str, radius: int = RADIUS, shingle: int = SHINGLE, group_size: int = GROUP_SIZE) -> DataFrame:
    """(id, text_hash, fp, component_id, kept), one row per input row."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    best = F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row"))).alias("best")
    prints = cut(rows.groupBy("fp").agg(best))
    roots = cut(connected_components(cut(link_forest(prints, radius, group_size))))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("best").alias("first"))
    classes = rooted.join(named, "root").select("fp", "first")
    return rows.join(classes, "fp").select("id", "text_hash", "fp", F.col("first.id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, group_size: int = GROUP_SIZE) -> DataFrame:
    """One row per input row: the id, ``fingerprint`` (hex), ``component_id`` and ``kept`` (one row of each component)."""
    found = _classes(docs, id_col, text_col, radius, shingle, group_size)
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns.

    Where an id is unique, a semi join on id and text hash is all it takes. Rows that repeat both are reduced to one.
    """
    p = private_prefix(docs)
    made = cut(_classes(docs, id_col, text_col, radius))
    stays = made.filter("kept").select(F.col("id").alias(f"{p}_id"), F.col("text_hash").alias(f"{p}_kept"))
    kept = docs.withColumn(f"{p}_hash", _text_hash(F.col(text_col))).join(stays, F.col(id_col).eqNullSafe(F.col(f"{p}_id")) & (F.col(f"{p}_hash") == F.col(f"{p}_kept")), "left_semi")
    if not made.groupBy("id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, f"{p}_hash"])
    return kept.select(*docs.columns)
