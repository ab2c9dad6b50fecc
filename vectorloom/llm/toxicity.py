"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two models, toxic and ordinary, say how likely a letter is after the letters before it in its word (up to ``ORDER - 1``,
the word's start and end count as letters), so a word that no labelled text holds is still known by its parts. A class's
counts are discounted and backed off to a Kneser-Ney model of both classes together: there a run of letters counts as
often as it occurs where it is longest or begins a word, else by how many different letters it follows, and each order
backs off to the one below. All discounts are estimated from counts of counts. What a context must be seen with before
its class speaks for itself is the backoff's ``STRENGTH``, so a rare expression says what the shared counts say, the same
for both classes. A text is scored by the difference of its two log-likelihoods per word, over the whole text and over
its most toxic shares of words, so that a few insults in a long text are not averaged away; a logistic curve, fitted on
labelled rows that trained neither model, turns these into a probability.

Counts cover all labelled rows of the training folds, each different text of a class once: words are counted per task and
summed in Spark, then runs of letters; probabilities are joined order by order there too. What is broadcast are the log
ratios of runs and contexts in two tables of fixed size, 24 MB, whatever the corpus (a run of letters that shares its place
with a more frequent one has that one's ratio). The curve alone learns from a bounded sample of labelled rows
(``CURVE_ROWS``), drawn by a hash of the id. Every row is scored on its whole text.

Defined cases: a null or empty text has no words: all its evidence is zero, and its score is what the curve gives for
that; words are split at white space, lower-cased and stripped of punctuation; labels that are null or belong to no row
are ignored; if only one class is there to learn from, every score is the share of toxic labels (0 without any); if the
curve's fold lacks a class, the curve is fitted on the training folds; repeated rows are scored alike; an empty table
gives an empty result; :func:`score_rows` keeps all columns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import cut, private_prefix, tidy

THRESHOLD, HELD_OUT = 0.3, 2  # fixed values of the contract
ORDER, STRENGTH = 5, 60.0
CURVE_ROWS = 20_000
RUN_BUCKETS, CONTEXT_BUCKETS = 1 << 23, 1 << 22
SHARES = (0.01, 0.02, 0.05)  # the most toxic words that are looked at by themselves
EVIDENCE = len(SHARES) + 1
_KNOWN_WORDS = 200_000
_RUN_TEXT = 2 << 20
_PIECE = 1 << 15
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_BEGIN, _END = "\x02", "\x03"
_NO_CONTEXT = 1


def word_of(part: str) -> str:
    """A part of a text as a word: lower-cased, without punctuation and digits at its edges unless it has nothing else."""
    return _EDGES.sub("", part.lower()) or part


@dataclass
class Runs:
    """The runs of letters that end at each place of some words, one order at a time (row k: order k; 0: there is none)."""

    word: np.ndarray
    run: np.ndarray
    context: np.ndarray  # the letters before the run's last one
    shorter: np.ndarray  # the run without its first letter
    initial: np.ndarray  # whether it begins with its word


def letter_runs(words: list[str], order: int = ORDER) -> Iterator[Runs]:
    """Runs of the words' letters by 64-bit keys, in pieces of bounded size."""
    letters = np.frombuffer("".join([f"{_BEGIN}{w}{_END}" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum([0, *(len(w) + 2 for w in words)])
    for first in range(0, len(letters), _PIECE):
        a, b = max(first - order, 0), min(first + _PIECE, len(letters))
        word = np.searchsorted(begins, np.arange(a, b), "right") - 1
        at = np.arange(a, b) - begins[word]
        with np.errstate(over="ignore"):
            mixed = (letters[a:b].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            run, power, sums = np.zeros((order + 1, b - a), np.uint64), np.uint64(1), np.zeros(b - a, np.uint64)
            for k in range(1, order + 1):
                sums[k - 1 :] += mixed[: max(b - a - k + 1, 0)] * power
                power *= np.uint64(0xD6E8FEB86659FD93)
                run[k] = np.where(at >= k - 1, sums * np.uint64(0x9FB21C651E98DF25) + np.uint64(k), 0)
        context, shorter = np.zeros_like(run), np.zeros_like(run)
        context[1] = _NO_CONTEXT
        context[2:, 1:] = run[1:-1, :-1]
        shorter[2:] = run[1:-1]
        ends = (at > 0) & (np.arange(a, b) >= first)
        initial = at == np.arange(order + 1)[:, None] - 1
        yield Runs(word[ends], *(x[:, ends].view(np.int64) for x in (run, context, shorter)), initial[:, ends])


@dataclass
class Tables:
    """Log ratios (toxic to ordinary) in half precision, by the low bits of keys; not a number where nothing is known."""

    run: np.ndarray
    context: np.ndarray
    curve: np.ndarray | None = None

    def ratios(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary): the longest known run decides at each letter, or its known context."""
        out = np.zeros(len(words))
        for piece in letter_runs(words):
            total, open_ = np.zeros(len(piece.word)), np.ones(len(piece.word), bool)
            for k in range(ORDER, 0, -1):
                there = piece.run[k] != 0
                for keys, table in ((piece.run[k], self.run), (piece.context[k], self.context)):
                    found = table[keys & (len(table) - 1)].astype(np.float64)
                    take = open_ & there & ~np.isnan(found)
                    total[take] = found[take]
                    open_ &= ~take
            out += np.bincount(piece.word, total, len(words))
        return out


class Evidence:
    """Evidence of texts under one model, with a bounded memory of words; lives as long as a task."""

    def __init__(self, tables: Tables):
        self.tables, self.known = tables, {}

    def of(self, texts: list[str | None]) -> np.ndarray:
        parts, size, out = [], 0, []
        for text in texts:
            parts.append((text or "").split())
            size += len(text or "")
            if size >= _RUN_TEXT:
                out += self._rows(parts)
                parts, size = [], 0
        return np.array([*out, *self._rows(parts)]).reshape(-1, EVIDENCE)

    def _rows(self, texts: list[list[str]]) -> list[list[float]]:
        known = self.known.get
        new = list({p for parts in texts for p in parts if known(p) is None})
        fresh = dict(zip(new, self.tables.ratios([word_of(p) for p in new]).tolist(), strict=True))
        out = [self._row(np.array([r if (r := known(p)) is not None else fresh[p] for p in parts])) for parts in texts]
        if len(self.known) < _KNOWN_WORDS:  # the first words met stay: frequent ones are among them
            self.known.update(fresh)
        return out

    @staticmethod
    def _row(ratios: np.ndarray) -> list[float]:
        if not len(ratios):
            return [0.0] * EVIDENCE
        most = -np.sort(-ratios)
        return [float(ratios.mean()), *(float(most[: int(np.ceil(len(most) * s))].mean()) for s in SHARES)]


def _remainder(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def held_out(id_col: Column) -> Column:
    return _remainder(id_col) == HELD_OUT


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update({word_of(p) for p in (text.as_py() or "").split()})  # a text counts a word once
        words = list(counts[0].keys() | counts[1].keys())
        for k in range(0, len(words), 50_000):
            part = words[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[w] for w in part], pa.int64()) for c in counts)], ["word", "n0", "n1"])


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n0, n1 = batch.column("n0").to_numpy(), batch.column("n1").to_numpy()
        for piece in letter_runs(batch.column("word").to_pylist()):
            for k in range(1, ORDER + 1):
                there = np.flatnonzero(piece.run[k])
                run, first, place = np.unique(piece.run[k][there], return_index=True, return_inverse=True)
                counts = [np.bincount(place, n[piece.word[there]], len(run)).astype(np.int64) for n in (n0, n1)]
                facts = [x[k][there][first] for x in (piece.context, piece.shorter, piece.initial)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (run, *facts, np.full(len(run), k), *counts)], ["run", "context", "shorter", "initial", "k", "n0", "n1"])


def count_words(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n0, n1): in how many different ordinary and toxic labelled texts each word stands. ``labels``: ``_id``, ``toxic``."""
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).withColumn("_hash", F.xxhash64("text", F.length("text")))
    texts = texts.filter(_remainder(F.col("_doc")).isin(0, 1))
    # Copies of a text count once: of each text and class one id is chosen, by hashes, before any text moves.
    mine = labels.filter(_remainder(F.col("_id")).isin(0, 1))
    chosen = texts.select("_doc", "_hash").join(mine, F.col("_doc") == F.col("_id")).groupBy("_hash", "toxic").agg(F.min("_id").alias("_id"))
    rows = texts.join(cut(chosen).withColumnRenamed("_hash", "_chosen"), (F.col("_doc") == F.col("_id")) & (F.col("_hash") == F.col("_chosen")))
    counted = rows.select("text", "toxic").mapInArrow(tidy(_count_words), "word string, n0 long, n1 long")
    return cut(counted.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def _discount(ones: int | None, twos: int | None) -> float:
    """Kneser and Ney's estimate from how many counts are one and two."""
    return ones / (ones + 2 * twos) if ones else 0.5


def run_ratios(words: DataFrame, strength: float = STRENGTH) -> tuple[DataFrame, DataFrame]:
    """(runs, contexts) with their keys, counts and probabilities: ``shared``, ``p0``, ``p1``, ``ratio`` of a run's last letter after
    the others; ``left0``, ``left1``, ``ratio`` of what a class leaves to the shared model after a context.
    """
    runs = words.mapInArrow(tidy(_count_runs), "run long, context long, shorter long, initial boolean, k long, n0 long, n1 long")
    runs = runs.groupBy("run").agg(F.min("context").alias("context"), F.min("shorter").alias("shorter"), F.max("initial").alias("initial"), F.min("k").alias("k"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    runs = cut(runs)
    follows = runs.filter("k > 1").groupBy(F.col("shorter").alias("run")).agg(F.count("*").alias("before"))
    all_of = F.when((F.col("k") == ORDER) | F.col("initial"), F.col("n0") + F.col("n1")).otherwise(F.coalesce(F.col("before"), F.col("n0") + F.col("n1")))
    runs = cut(runs.join(follows, "run", "left").withColumn("n", all_of).drop("before"))

    names = ("n", "n0", "n1")
    of_counts = runs.groupBy("k").agg(*[F.count(F.when(F.col(c) == v, 1)).alias(f"{c}_{v}") for c in names for v in (1, 2)]).collect()  # ORDER rows
    found = {r["k"]: r for r in of_counts}
    less = {c: F.element_at(F.array(*[F.lit(_discount(*(found[k][f"{c}_{v}"] if k in found else 0 for v in (1, 2)))) for k in range(1, ORDER + 1)]), F.col("k").cast("int")) for c in names}
    sums = [F.sum(c).alias(f"all_{c}") for c in names] + [F.count(F.when(F.col(c) > 0, 1)).alias(f"kinds_{c}") for c in names]
    contexts = cut(runs.groupBy("context").agg(F.min("k").alias("k"), *sums).withColumns({f"less_{c}": less[c] for c in names}))
    left = {c: (F.lit(strength) + F.col(f"less_{c}") * F.col(f"kinds_{c}")) / (F.lit(strength) + F.col(f"all_{c}")) for c in ("n0", "n1")}
    seen = cut(runs.join(contexts.drop("k"), "context"))

    letters = runs.filter("k = 1").count()
    below, orders = None, []
    for k in range(1, ORDER + 1):
        here = seen.filter(F.col("k") == k)
        if below is None:
            here = here.withColumn("lower", F.lit(1.0 / (letters + 1)))
        else:
            here = here.join(below.select(F.col("run").alias("shorter"), F.col("shared").alias("lower")), "shorter")
        kept = F.greatest(F.col("n") - F.col("less_n"), F.lit(0.0))
        here = here.withColumn("shared", (kept + F.col("less_n") * F.col("kinds_n") * F.col("lower")) / F.col("all_n"))
        of_class = [(F.greatest(F.col(c) - F.col(f"less_{c}"), F.lit(0.0)) / (F.lit(strength) + F.col(f"all_{c}")) + left[c] * F.col("shared")).alias(f"p{c[1]}") for c in ("n0", "n1")]
        below = cut(here.select("run", "context", "k", "n0", "n1", "shared", *of_class))
        orders.append(below)
    out = orders[0]
    for more in orders[1:]:
        out = out.unionByName(more)
    return (
        out.withColumn("ratio", F.log("p1") - F.log("p0")),
        contexts.select("context", "k", (F.col("all_n0") + F.col("all_n1")).alias("n"), left["n0"].alias("left0"), left["n1"].alias("left1")).withColumn("ratio", F.log("left1") - F.log("left0")),
    )


def _table(ratios: DataFrame, key: str, weight: Column, buckets: int) -> np.ndarray:
    """Ratios by the key's low bits; of keys that share them the most frequent. At most ``buckets`` rows reach the driver."""
    found = ratios.groupBy(F.col(key).bitwiseAND(F.lit(buckets - 1)).alias("bucket")).agg(F.max_by(F.col("ratio").cast("float"), F.struct(weight, key)).alias("ratio")).toArrow()
    out = np.full(buckets, np.nan, np.float16)
    out[found.column("bucket").to_numpy()] = found.column("ratio").to_numpy()
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Tables | None, float]:
    """(tables with their curve, share of toxic labels); no tables if a class is missing."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull())
    known = known.filter(~held_out(F.col("_id")))
    base = known.agg(F.avg("toxic")).first()[0] or 0.0
    words = count_words(docs, known, id_col, text_col)
    both = words.agg(F.sum("n0"), F.sum("n1")).first()
    if not both[0] or not both[1]:
        return None, base
    runs, contexts = run_ratios(words)
    tables = Tables(_table(runs, "run", F.col("n0") + F.col("n1"), RUN_BUCKETS), _table(contexts, "context", F.col("n"), CONTEXT_BUCKETS))

    shared = docs.sparkSession.sparkContext.broadcast(tables)
    names = [f"e{k}" for k in range(EVIDENCE)]

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Evidence(shared.value)
        for batch in batches:
            found = model.of(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(found[:, k]) for k in range(EVIDENCE)), batch.column("toxic")], [*names, "toxic"])

    for fold in ([3], [0, 1]):
        sample = _texts_of(docs, _sample(known, fold, CURVE_ROWS), id_col, text_col)
        seen = sample.mapInArrow(tidy(evidence), ", ".join(f"{n} double" for n in names) + ", toxic int").toPandas()  # at most about CURVE_ROWS rows
        if seen["toxic"].nunique() == 2:
            break
    shared.destroy()
    tables.curve = fit_curve(seen[names].to_numpy(), seen["toxic"].to_numpy())
    return tables, base


def _sample(labels: DataFrame, fold: list[int], rows: int) -> DataFrame:
    """Labelled ids of some folds, about ``rows`` at most, chosen by a hash of the id."""
    mine = labels.filter(_remainder(F.col("_id")).isin(fold))
    share = rows / max(mine.count(), 1)
    return mine.filter(F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1 << 20)) / (1 << 20) < share)


def _texts_of(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # the sample's size is bounded by CURVE_ROWS, so it may be broadcast and the texts stay where they are
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("text", "toxic")


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method: means, scales and weights, as rows of one array."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.array([[*mean, 0.0], [*scale, 1.0], w])


def score_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 added."""
    tables, base = train(docs, labels, id_col, text_col)
    if tables is None:
        return docs.withColumn(score_col, F.lit(float(base)))
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    place = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Evidence(shared.value)
        mean, scale, weights = shared.value.curve
        for batch in batches:
            found = model.of(batch.column(place).to_pylist())
            z = np.column_stack([(found - mean[:-1]) / scale[:-1], np.ones(len(found))]) @ weights
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*batch.schema.names, score_col])

    schema = docs.select("*", F.lit(0.0).alias(score_col)).schema
    return docs.mapInArrow(tidy(score), schema)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``held_out``, ``score`` and ``predicted``."""
    scored = score_rows(docs.select(id_col, text_col), labels, id_col, text_col, "_score")
    predicted = F.when(F.col("_score") >= THRESHOLD, 1).otherwise(0)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), F.col("_score").alias("score"), predicted.alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` scored below the threshold, with all their columns."""
    score = private_prefix(docs)
    return score_rows(docs, labels, id_col, text_col, score).filter(F.col(score) < THRESHOLD).select(*docs.columns)
