"""Token counts of flat, unindexed token files by a separator scan.

A flat token file is nothing but token identifiers of two bytes each (little-endian), documents one after another, each
ended by the end-of-document identifier; nothing says where a document starts. Files are cut into blocks of a fixed number
of bytes; tasks read byte ranges and search them for the separator all at once. A block reports the places of its separators;
what is before the first one belongs to a document that began in an earlier block, so a prefix scan over the blocks'
(separator count, place of the last separator) gives every block the number and the start of the document it begins in,
and with these all documents' ordinals and lengths. The scan is done in two steps, within runs of blocks and over the
runs, so that no task holds more than a run's blocks or a file's runs.

Defined cases: a file may be empty; tokens after the last separator are an unfinished document, reported with
``ended`` false; two separators in a row enclose a document of no tokens; null text counts as empty; repeated rows are
separate documents; a text that spells the end mark counts it as a token and goes on, for another identifier stands for it
in the file; an empty table gives no files with documents and an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.llm.common import cut, remove, shared_dir, tidy
from vectorloom.llm.tokenize import encoder

END_OF_DOCUMENT = 49407  # the vocabulary's own end-of-text identifier
SPELLED_OUT = 49406  # its start-of-text identifier: stands in the files for an end mark that a text spells out
DTYPE = "<u2"
WIDTH = 2
BLOCK_BYTES = 1 << 21
RUN_BLOCKS = 256


def _encode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, WIDTH).encode
        mark = np.array([END_OF_DOCUMENT], DTYPE).tobytes()
        for batch in batches:
            packed = []
            for text in batch.column("text"):
                data = encode(text.as_py() or "")
                if mark in data:  # perhaps: the two bytes may also stand across two tokens
                    ids = np.frombuffer(data, DTYPE)
                    data = np.where(ids == END_OF_DOCUMENT, SPELLED_OUT, ids).astype(DTYPE).tobytes()
                packed.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["tokens"])

    return tidy(run)


def write_token_files(docs: DataFrame, path: str, text_col: str = "text", tokenizer_path: str | None = None, also: str | None = None) -> None:
    """Write the documents' tokens as flat files, one per task, by Spark's own text writer.

    A row's bytes are its tokens and the line separator is the end-of-document identifier, so the files hold nothing else
    and any store that Spark writes to will do. ``also`` names a column to read along, so that the rows are those of
    another reading with that column.
    """
    packed = docs.select(F.col(text_col).alias("text"), *([F.col(also).alias("_also")] if also else [])).mapInArrow(_encode(tokenizer_path), "tokens binary")
    separator = np.array([END_OF_DOCUMENT], DTYPE).tobytes().decode("latin-1")
    packed.select(F.col("tokens").cast("string").alias("value")).write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of a folder's token files; no content is read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    return files.filter("bytes > 0")


def _find(uri: str, start: int, size: int) -> np.ndarray:
    """Places (in tokens from the file's start) of the separators in a byte range."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        data = f.read_at(size, start)
    return np.flatnonzero(np.frombuffer(data, DTYPE) == END_OF_DOCUMENT) + start // WIDTH


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file, block, start, size in zip(batch["file"], batch["block"], batch["start"], batch["size"], strict=True):
            ends = _find(file, int(start), int(size))
            yield pd.DataFrame({"file": [file], "block": block, "start": start, "size": size, "n": len(ends), "last": ends[-1] if len(ends) else None, "ends": [ends.astype(np.int64)]}).astype({"last": "Int64"})


def count_tokens(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document of the token files below ``path``: ``file``, ``doc_no`` (from 0 in its file), ``start`` (in
    tokens), ``tokens`` (without the separator), ``ended``.
    """
    block_bytes -= block_bytes % WIDTH
    blocks = list_files(spark, path).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {block_bytes}"))))
    blocks = blocks.select("file", "block", (F.col("block") * block_bytes).alias("start"), F.least(F.lit(block_bytes), F.col("bytes") - F.col("block") * block_bytes).alias("size"))
    found = blocks.repartition(F.xxhash64("file", "block")).mapInPandas(_blocks, "file string, block long, start long, size long, n long, last long, ends array<long>")
    found = cut(found.withColumn("run", F.expr(f"block div {RUN_BLOCKS}")))

    # The prefix scan: how many separators stand before each block of its file, and where the last of them is.
    heads = found.select("file", "run", "block", "n", "last")
    runs = heads.groupBy("file", "run").agg(F.sum("n").alias("run_n"), F.max("last").alias("run_last"))
    over = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("file", "run", F.coalesce(F.sum("run_n").over(over), F.lit(0)).alias("runs_before"), F.max("run_last").over(over).alias("runs_last"))
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("file", "run", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("blocks_before"), F.max("last").over(inside).alias("blocks_last"))
    scan = heads.join(runs, ["file", "run"]).select(
        "file", "block", (F.col("runs_before") + F.col("blocks_before")).alias("before"), F.coalesce("blocks_last", "runs_last", F.lit(-1)).alias("previous")
    )
    stitched = found.join(scan, ["file", "block"])
    docs = stitched.select("file", "before", "previous", "ends", F.posexplode("ends").alias("k", "end"))
    begin = F.when(F.col("k") == 0, F.col("previous")).otherwise(F.element_at("ends", F.greatest(F.col("k"), F.lit(1)))) + 1
    docs = docs.select("file", (F.col("before") + F.col("k")).alias("doc_no"), begin.alias("start"), (F.col("end") - begin).alias("tokens"), F.lit(True).alias("ended"))
    # what follows a file's last separator
    tails = found.groupBy("file").agg(F.max((F.col("start") + F.col("size")) / WIDTH).cast("long").alias("all"), F.sum("n").alias("n"), F.max("last").alias("last"))
    tails = tails.withColumn("start", F.coalesce(F.col("last"), F.lit(-1)) + 1).filter(F.col("all") > F.col("start"))
    tails = tails.select("file", F.col("n").alias("doc_no"), "start", (F.col("all") - F.col("start")).alias("tokens"), F.lit(False).alias("ended"))
    return docs.unionByName(tails)


def _settled(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows stand in the same places in every reading, else written to the shared folder, where they do.

    A scan without any exchange reads the rows of its files in their order, also when a task is run again; behind a
    shuffle rows come as the network brings them.
    """
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return cut(docs) if re.search(r"Exchange|ShuffleQueryStage|InMemoryTableScan", plan) else docs


def count_document_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write ``docs`` as flat token files to the shared folder, count the documents in them, and remove the files.

    One row per document: the id, ``file`` (its number in the name Spark gave it), ``doc_no``, ``start``, ``tokens``,
    ``n_chars``.
    The files know no ids: a document is told by its place, for a task's file holds the task's rows in their order. Both
    readings are of the same files of a table, or of a copy that is written first if the rows come from a shuffle. That all
    files have as many documents as their tasks had rows is checked.
    """
    spark = docs.sparkSession
    docs = _settled(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")))
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, "text", tokenizer_path, "_id")
    counted = cut(count_tokens(spark, path, block_bytes).select(F.regexp_extract("file", r"part-(\d+)", 1).cast("long").alias("file"), "doc_no", "start", "tokens"))
    remove(spark, path)
    place = F.monotonically_increasing_id()
    # id and text are read again, the columns that were read for the files, so the rows stand where they stood then
    rows = docs.select("_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), place.alias("_place"))
    rows = rows.select("_id", "n_chars", F.shiftright("_place", 33).alias("_file"), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("_no"))
    found = counted.join(rows, (F.col("file") == F.col("_file")) & (F.col("doc_no") == F.col("_no")), "full")
    whole = F.when(F.col("file").isNotNull() & F.col("_file").isNotNull(), F.col("tokens")).otherwise(F.raise_error(F.lit("a token file and its task's rows differ in number")).cast("long"))
    return found.select(F.col("_id").alias(id_col), "file", "doc_no", "start", whole.alias("tokens"), "n_chars")
