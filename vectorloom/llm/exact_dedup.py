"""Exact dedup by content-defined chunk recipes.

Every text is normalised (each run of ASCII white space becomes one space) and cut where its own content says so: a
rolling hash over 16 bytes marks the cuts, so equal passages are cut alike wherever they stand. Chunks are
deduplicated by digest *and* bytes, which gives every distinct chunk a verified identifier, and a document becomes its
recipe, the ordered list of identifiers. Two texts are equal exactly when their recipes are, so long documents are
never moved or compared again: the text crosses the network once, as distinct chunks, and all later work is on recipes.

Defined cases: null text counts as empty; empty texts are equal to each other (empty recipe); of equal texts the row
with the smallest id stays, null ids coming last; of rows that repeat the smallest id exactly one stays; an empty
table gives an empty result; other columns of the input are ignored by :func:`exact_duplicates` and kept by
:func:`drop_exact_duplicates`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.common import SPACE_RUN, as_bytes, cut, private_prefix, tidy

MIN_CHUNK, MAX_CHUNK, CUT_BITS = 512, 16384, 11
DIGEST_BYTES = 16
_WINDOW_STEPS = 4  # doublings: the rolling hash covers 2 ** 4 bytes
_SLICE = 2 << 20


def normalise(raw: bytes) -> bytes:
    """Each run of ASCII white space becomes one space; leading and trailing runs too."""
    words = raw.split()
    if not words:
        return b" " if raw else b""
    return (b" " if raw[:1].isspace() else b"") + b" ".join(words) + (b" " if raw[-1:].isspace() else b"")


def _gear() -> np.ndarray:
    return np.random.default_rng(20_260_101).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: bytes, gear: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last 16 bytes asks for a cut."""
    h = gear[np.frombuffer(data, np.uint8)]
    for step in range(_WINDOW_STEPS):
        width = 1 << step
        rolled = h.copy()
        rolled[width:] += h[:-width] << np.uint32(width)
        h = rolled
    top = np.uint32(32 - CUT_BITS)
    return np.flatnonzero(h >> top == 0) + 1


def chunk_bounds(length: int, cuts: list[int]) -> list[tuple[int, int]]:
    """Chunks of one text from its cut points, none shorter than MIN_CHUNK (but the last) or longer than MAX_CHUNK."""
    bounds, start = [], 0
    for cut_at in [*cuts, length]:
        while cut_at - start > MAX_CHUNK:
            bounds.append((start, start + MAX_CHUNK))
            start += MAX_CHUNK
        if cut_at - start >= MIN_CHUNK or (cut_at == length and cut_at > start):
            bounds.append((start, cut_at))
            start = cut_at
    return bounds


def _slices(raws: Iterable[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of normalised texts of about 2 MB, with the index of the first."""
    first, held, size = 0, [], 0
    for i, raw in enumerate(raws):
        held.append(normalise(raw))
        size += len(held[-1])
        if size >= _SLICE:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _chunked(raws: Iterable[bytes], gear: np.ndarray) -> Iterator[list[tuple[int, bytes, list[tuple[int, int]]]]]:
    """(index, normalised text, chunk bounds) of each text, in runs; the hash runs over all texts of a run at once.

    A window that reaches into the text before matters to no cut, for no cut falls within MIN_CHUNK bytes of a start.
    """
    for first, texts in _slices(raws):
        cuts = cut_points(b"".join(texts), gear)
        ends = np.cumsum([len(t) for t in texts])
        begins = ends - np.array([len(t) for t in texts])
        low, high = np.searchsorted(cuts, begins, "right"), np.searchsorted(cuts, ends, "left")
        yield [(first + k, text, chunk_bounds(len(text), (cuts[low[k] : high[k]] - begins[k]).tolist())) for k, text in enumerate(texts)]


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def _recipes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = _gear()
        for batch in batches:
            recipes, shas = [], []
            for texts in _chunked((x.as_py() for x in batch.column("body")), gear):
                for _, text, bounds in texts:
                    shas.append(hashlib.sha256(text).hexdigest())
                    recipes.append([_digest(text[a:b], size) for a, b in bounds])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(shas, pa.string()), pa.array(recipes, pa.list_(pa.binary()))],
                ["row", "id", "text_sha256", "recipe"],
            )

    return tidy(run)


def _chunks(size: int, with_place: bool):
    names = ["row", "pos", "digest", "content"] if with_place else ["digest", "content"]
    kinds = {"row": pa.int64(), "pos": pa.int64(), "digest": pa.binary(), "content": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = _gear()
        for batch in batches:
            rows = batch.column("row").to_pylist()
            for texts in _chunked((x.as_py() for x in batch.column("body")), gear):
                out: dict[str, list] = {n: [] for n in kinds}
                seen: set[bytes] = set()
                for i, text, bounds in texts:
                    for pos, (a, b) in enumerate(bounds):
                        content = text[a:b]
                        if not with_place:
                            if content in seen:
                                continue
                            seen.add(content)
                        out["row"].append(rows[i])
                        out["pos"].append(pos)
                        out["digest"].append(_digest(content, size))
                        out["content"].append(content)
                yield pa.RecordBatch.from_arrays([pa.array(out[n], kinds[n]) for n in names], names)

    return tidy(run)


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """One row per input row: ``row`` (a stable row number), ``id``, ``text_sha256`` and the recipe of verified identifiers.

    An identifier is a chunk's digest. Where different chunks share one (found by comparing the bytes), all their
    identifiers get the chunk's rank among them as a suffix, so that an identifier names one byte string.
    """
    body = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), as_bytes(F.col(text_col)).alias("body"))
    id_type = body.schema["id"].dataType.simpleString()
    plain = cut(body.mapInArrow(_recipes(digest_bytes), f"row long, id {id_type}, text_sha256 string, recipe array<binary>"))

    distinct = body.mapInArrow(_chunks(digest_bytes, False), "digest binary, content binary").distinct()
    shared = cut(distinct.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"))
    if shared.isEmpty():
        return plain

    # Rows with a chunk whose digest names several byte strings: their recipes are rebuilt with ranks.
    told = Window.partitionBy("digest").orderBy("content")
    ranked = distinct.join(shared, "digest", "left_semi").withColumn("rank", F.row_number().over(told))
    hit = plain.select("row", F.explode("recipe").alias("digest")).join(shared, "digest", "left_semi").select("row").distinct()
    # all of ``body`` goes in each time: with other columns, a shuffled input might number its rows otherwise
    places = body.mapInArrow(_chunks(digest_bytes, True), "row long, pos long, digest binary, content binary").join(hit, "row", "left_semi")
    named = places.join(ranked, ["digest", "content"], "left").select(
        "row", "pos", F.concat("digest", F.coalesce(F.concat(F.lit("#"), F.col("rank").cast("string")), F.lit("")).cast("binary")).alias("ident")
    )
    rebuilt = named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "ident"))).alias("parts"))
    rebuilt = rebuilt.select("row", F.transform("parts", lambda p: p["ident"]).alias("rebuilt"))
    return plain.join(rebuilt, "row", "left").select("row", "id", "text_sha256", F.coalesce("rebuilt", "recipe").alias("recipe"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Groups are counted before they are joined back, so a hot group costs one row per task there. They are cut off from
    the join that follows, so that Spark may split a hot group's rows in it; its other side has one row per recipe.
    """
    made = recipes(docs, id_col, text_col, digest_bytes)
    first = F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row")))
    groups = cut(made.groupBy("recipe").agg(first.alias("first"), F.count("*").alias("group_size")))
    return made.join(groups, "recipe").select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; null ids match as such.

    Where an id is unique, a semi join on id and text digest is all it takes. Rows that repeat both are reduced to one.
    """
    made = cut(exact_duplicates(docs, id_col, text_col))
    p = private_prefix(docs)
    stays = made.filter("kept").select(F.col(id_col).alias(f"{p}_id"), F.col("text_sha256").alias(f"{p}_kept"))
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_RUN, " "), 256)
    kept = docs.withColumn(f"{p}_sha", sha).join(stays, F.col(id_col).eqNullSafe(F.col(f"{p}_id")) & (F.col(f"{p}_sha") == F.col(f"{p}_kept")), "left_semi")
    if not made.groupBy(id_col, "text_sha256").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, f"{p}_sha"])
    return kept.select(*docs.columns)
