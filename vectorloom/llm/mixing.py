"""Mixing sources to target weights.

Each source's documents form one stream of words, in an order fixed by hashed buckets of ids, cut into blocks of a
fixed number of words. The mix is a row of slots, one block each, dealt over output shards. How many slots a shard
gives each source is a multinomial draw given the sources' totals (a multivariate hypergeometric one): the shards are
halved again and again and each half's counts are drawn from a generator seeded by its place, so every shard finds its
own counts without knowing another's, and all shards together meet the totals. The draw is exact at any size: every slot
is taken with the same chance, and what is missing or too much after that is drawn in turn, a square root of it each time. A source's slot ``j`` takes the block at
``j`` mod its blocks under a pseudorandom permutation (a Feistel network that walks cycles), one permutation for each
pass over the source, so no block is taken again before all were taken. Slots and documents meet in a join on source
and block; a source's last slot is shortened so that its words come out at the target.

Defined cases: null text has no words; documents without words take none; a null source is a source of its own, last in
order; empty tables give empty results; repeated rows are separate documents; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from vectorloom.llm.common import SPACE_RUN, count_words, cut, private_prefix, tidy

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0  # fixed values of the contract
BLOCK_WORDS = 64
SHARD_SLOTS = 1 << 15
SEED = 11
_BUCKET_DOCS = 8192
_FEW = 64


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words each source gives: by weight, none above ``cap`` times its size, the excess reshared until none is."""
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > cap * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
        left = max(0.0, left - sum(out[i] for i in over))
        open_ -= over
    return out


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 chosen by ``key``: a balanced Feistel network, walked until it falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([SEED, key]).integers(0, 1 << 62, 6, dtype=np.uint64)
    y = np.asarray(x, np.uint64).copy()
    todo = np.arange(len(y))
    while len(todo):
        left, right = y[todo] >> np.uint64(half), y[todo] & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ _mix(left, k, mask), left
            else:
                left, right = right, left ^ _mix(right, k, mask)
        y[todo] = (left << np.uint64(half)) | right
        todo = todo[y[todo] >= n]
    return y.astype(np.int64)


def _mix(v: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (v + key) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)) & mask


@dataclass(frozen=True)
class SourcePlan:
    """How one source is taken: its blocks, its slots in the mix, and the words of its last slot."""

    source: str | None
    size: int
    target: float
    blocks: int
    slots: int
    last_words: int


def plan_source(source: str | None, index: int, size: int, target: float, block: int = BLOCK_WORDS) -> SourcePlan:
    want, blocks = round(target), -(-size // block)
    if not want or not size:
        return SourcePlan(source, size, target, blocks, 0, 0)
    passes, rest = divmod(want, size)
    if not rest:
        tail = block_words(int(permute(np.array([blocks - 1]), blocks, _key(index, passes - 1))[0]), size, block)
        return SourcePlan(source, size, target, blocks, passes * blocks, tail)
    short = size - (blocks - 1) * block
    at = int(permute(np.array([blocks - 1]), blocks, _key(index, passes), inverse=True)[0])  # the slot that takes the short block
    slots = -(-rest // block)
    if at < slots and rest > (slots - 1) * block + short:
        slots += 1
    before = (slots - 1) * block - (block - short if at < slots - 1 else 0)
    return SourcePlan(source, size, target, blocks, passes * blocks + slots, rest - before)


def block_words(index: int, size: int, block: int) -> int:
    return min(block, size - index * block)


def _key(index: int, passes: int) -> int:
    return index * 1_000_003 + passes


def split_counts(counts: np.ndarray, part: int, shards: int, shard_slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before shard ``part``, slots of each source in it): hypergeometric halving down to the shard."""
    low, high, total = 0, shards, int(counts.sum())
    before, here = np.zeros_like(counts), counts.copy()
    while high - low > 1:
        mid = (low + high) // 2
        left = _draw(here, min(mid * shard_slots, total) - low * shard_slots, [SEED, low, high])
        if part < mid:
            high, here = mid, left
        else:
            low, before, here = mid, before + left, here - left
    return before, here


def _draw(counts: np.ndarray, n: int, seed: list[int]) -> np.ndarray:
    return draw_without_replacement(counts, n, np.random.default_rng(seed))


def draw_without_replacement(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind a uniform draw of ``n`` of all items holds (multivariate hypergeometric), for counts of any size.

    Items taken independently with one chance are, given how many they are, a uniform draw of so many; adding or removing
    a uniform draw of the difference keeps them one.
    """
    counts, total = counts.copy(), int(counts.sum())
    if n > total - n:
        return counts - draw_without_replacement(counts, total - n, rng)
    taken = np.zeros_like(counts)
    if n <= _FEW:
        for _ in range(n):
            kind = int(np.searchsorted(np.cumsum(counts), rng.integers(total), "right"))
            counts[kind], taken[kind], total = counts[kind] - 1, taken[kind] + 1, total - 1
        return taken
    taken = rng.binomial(counts, n / total)
    missing = n - int(taken.sum())
    if missing > 0:
        return taken + draw_without_replacement(counts - taken, missing, rng)
    return taken - draw_without_replacement(taken, -missing, rng)


def _slots(plans: list[SourcePlan], shards: int, shard_slots: int):
    counts = np.array([p.slots for p in plans], np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["shard"]:
                before, here = split_counts(counts, int(shard), shards, shard_slots)
                order = np.random.default_rng([SEED, 7, int(shard)]).permutation(int(here.sum()))
                filled = 0
                for i, p in enumerate(plans):
                    if not (n := int(here[i])):
                        continue
                    j = np.arange(before[i], before[i] + n)
                    taken, place = j // p.blocks, j % p.blocks
                    block = np.empty(n, np.int64)
                    for t in np.unique(taken):
                        block[taken == t] = permute(place[taken == t], p.blocks, _key(i, int(t)))
                    words = np.where(j == p.slots - 1, p.last_words, np.iinfo(np.int64).max)
                    yield pd.DataFrame({"shard": int(shard), "slot": order[filled : filled + n], "source_no": i, "pass": taken, "block": block, "most": words})
                    filled += n

    return tidy(run)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). ``row_col`` names a column of distinct numbers of the rows; without it they are numbered here.

    documents: ``row``, ``id``, ``source``, ``size``, ``source_size``, ``target``; one row per input row.
    pieces: ``row``, ``id``, ``size``, ``shard``, ``slot``, ``pass``, ``start`` (the document's words before it),
    ``words``: which words of which document the mix takes, and where. A document's words in one pass are taken once.
    The driver holds one row per source (a few numbers each), nothing per document, block or slot.
    """
    spark = docs.sparkSession
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size"), row.alias("row")))
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goals = targets([r["size"] for r in found], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))])
    plans = [plan_source(r["source"], i, r["size"], t, block) for i, (r, t) in enumerate(zip(found, goals, strict=True))]
    facts = spark.createDataFrame(
        [Row(source_no=i, source=p.source, source_size=p.size, target=float(p.target), buckets=-(-r["docs"] // _BUCKET_DOCS)) for i, (p, r) in enumerate(zip(plans, found, strict=True))],
        "source_no int, source string, source_size long, target double, buckets long",
    )
    held = sized.join(F.broadcast(facts.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    # Words before each document in its source: within hashed buckets of bounded size, then over the few buckets.
    held = held.withColumn("bucket", F.pmod(F.xxhash64("id", "size"), F.col("buckets")))
    inside = Window.partitionBy("source_no", "bucket").orderBy("id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = held.groupBy("source_no", "bucket").agg(F.sum("size").alias("n")).select("source_no", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    held = held.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    held = held.join(buckets, ["source_no", "bucket"]).withColumn("at", F.col("ahead") + F.col("inside"))
    documents = held.select("row", "id", "source", "size", "source_size", "target", "source_no", "at")

    parts = documents.filter("size > 0").select(
        "row", "id", "size", "source_no", "at", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).alias("block")
    )
    first, end = F.greatest(F.col("at"), F.col("block") * block), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    parts = parts.select("row", "id", "size", "source_no", "block", (first - F.col("at")).alias("start"), (first - F.col("block") * block).alias("inside"), (end - first).alias("length"))

    shards = -(-sum(p.slots for p in plans) // shard_slots)
    slots = spark.range(0, shards, 1, max(1, min(shards, 10_000))).withColumnRenamed("id", "shard")
    slots = slots.mapInPandas(_slots(plans, shards, shard_slots), "shard long, slot long, source_no int, pass long, block long, most long")
    # Spark takes what Python makes for small, whatever its size: without the hint it would broadcast all slots
    pieces = parts.join(slots.hint("shuffle_merge"), ["source_no", "block"]).withColumn("words", F.least(F.col("length"), F.greatest(F.lit(0), F.col("most") - F.col("inside"))))
    pieces = pieces.filter("words > 0").select("row", "id", "size", "shard", "slot", "pass", "start", "words")
    return documents, pieces


def mix_shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK_WORDS) -> DataFrame:
    """One row per input row: the id, ``size``, ``source_size``, ``target`` and ``taken``, the words the mix takes of it."""
    documents, pieces = mix(docs, id_col, text_col, source_col, block)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return documents.join(taken, "row", "left").select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("source").alias(source_col)
    )


def take_spans(text: Column, spans: Column) -> Column:
    """The words of a text in some spans (``start``, ``words``; in order), single-spaced. The text is split once."""
    words = F.filter(F.split(text, SPACE_RUN), lambda w: w != "")
    # as a lambda's variable the words are made once; a plain column would be put in place of each use of it
    taken = F.transform(F.array(words), lambda w: F.concat_ws(" ", F.flatten(F.transform(spans, lambda s: F.slice(w, (s["start"] + 1).cast("int"), s["words"].cast("int"))))))
    return F.element_at(taken, 1)


def mix_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents: a row of ``docs`` for every pass that takes words of it, its text those words, single-spaced
    where the words are cut and unchanged where the pass takes them all. Other columns stay; ids repeat with the passes.

    ``docs`` is written to the shared folder with row numbers first, so that each row, repeated or not, meets its own takes
    in a join on that number: texts move once.
    """
    p = private_prefix(docs)
    docs_there = cut(docs.withColumn(f"{p}_row", F.monotonically_increasing_id()))
    _, pieces = mix(docs_there, id_col, text_col, source_col, block, row_col=f"{p}_row")
    takes = pieces.groupBy("row", "size", "pass").agg(F.array_sort(F.collect_list(F.struct("start", "words"))).alias("spans"), F.sum("words").alias("taken"))
    whole = F.col("taken") == F.col("size")
    takes = takes.select(F.col("row").alias(f"{p}_take"), whole.alias(f"{p}_whole"), F.when(~whole, F.col("spans")).alias(f"{p}_spans"))
    mixed = docs_there.join(takes, F.col(f"{p}_row") == F.col(f"{p}_take"))
    return mixed.withColumn(text_col, F.when(F.col(f"{p}_whole"), F.col(text_col)).otherwise(take_spans(F.col(text_col), F.col(f"{p}_spans")))).select(*docs.columns)
