"""Web archives (WARC) in seekable Zstandard bundles, written and read by tasks.

A task writes its records to bundles of its own. Records are gathered into frames of about FRAME_BYTES that are compressed
each by itself; a record is never split, so a very long one is a frame alone. Behind the frames stands a seek table in a
skippable frame, as the seekable format has it: each frame's compressed and raw size and checksum, then a footer. Any
Zstandard reader reads a bundle from end to end, and one that knows the table opens a single frame. An index maps record
identifiers to (bundle, frame, offset in the frame), so a lookup reads and decompresses one frame a record. Bundles
have names of their own for every attempt of a task, and only those that the index names count: what a lost executor
leaves behind is never read.

Equal payloads of MIN_PAYLOAD bytes or more are stored once. That of the row with the largest id is a ``response``; other rows
are ``revisit`` records, headers only, that name the response. Which rows these are is settled on digests; of a payload that
many rows share, each task passes one copy on. Equal means equal SHA-256; the SHA-1 is what WARC writes.

Defined cases: a null payload counts as empty; a null id is the smallest, and has no header; a null URL has no header; line
breaks and other control characters in a URL are percent-encoded in its header; of equal rows with the largest id one is
the response and the others revisit it; an empty table writes no bundle; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from base64 import b32encode
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm.common import as_bytes, cut, remove, shared_dir, tidy

MIN_PAYLOAD = 1000
FRAME_BYTES = 1 << 20  # raw
BUNDLE_BYTES = 1 << 30  # compressed
READ_BYTES = 16 << 20  # compressed, that a task reads back
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # the tables know no time of retrieval
# The WARC profile of a revisit, and the numbers of the seekable Zstandard format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY, _FOOTER = struct.Struct("<III"), struct.Struct("<IBI")

RECORD = "record_id string, record_type string, page_id string, url string, digest string, payload binary, refers_id string"
INDEX = "record_id string, bundle string, frame int, frame_at long, frame_size int, offset int, length int"
PARSED = "record_id string, record_type string, page_id string, url string, refers_id string, payload_bytes long, payload_digest string, payload binary"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _header(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", value)


def record_bytes(record_id: str, record_type: str, page_id: str | None, url: str | None, digest: str, payload: bytes | None, refers_id: str | None, date: str = DATE) -> bytes:
    """One WARC record with its trailing empty lines; the block is an HTTP answer, of a revisit its head only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {quote(page_id)}")
    head.append(f"WARC-Payload-Digest: sha1:{b32encode(bytes.fromhex(digest)).decode()}")
    if refers_id is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_id}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


class BundleWriter:
    """Records as frames of one seekable file; ``add`` and ``close`` give index rows once a frame is written."""

    def __init__(self, stream, name: str, frame_bytes: int = FRAME_BYTES):
        self.stream, self.name, self.frame_bytes = stream, name, frame_bytes
        self.at, self.frames, self._held, self._raw = 0, [], [], 0
        self._compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.records = 0

    def add(self, record_id: str, data: bytes) -> list[tuple]:
        done = self._flush() if self._held and self._raw + len(data) > self.frame_bytes else []
        self._held.append((record_id, data))
        self._raw += len(data)
        self.records += 1
        return done

    def _flush(self) -> list[tuple]:
        if not self._held:
            return []
        raw = b"".join(data for _, data in self._held)
        packed, rows, offset = self._compress(raw), [], 0
        for record_id, data in self._held:
            rows.append((record_id, self.name, len(self.frames), self.at, len(packed), offset, len(data)))
            offset += len(data)
        self.stream.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.at += len(packed)
        self._held, self._raw = [], 0
        return rows

    def close(self) -> list[tuple]:
        rows = self._flush()
        table = b"".join(_ENTRY.pack(*f) for f in self.frames) + _FOOTER.pack(len(self.frames), CHECKSUMS, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.stream.close()
        return rows


def _write(path: str, frame_bytes: int, bundle_bytes: int, date: str):
    names = [c.split()[0] for c in INDEX.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in INDEX.split(", ")])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(len(names))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            rows = []
            columns = [batch.column(c.split()[0]) for c in RECORD.split(", ")]
            for values in zip(*columns, strict=True):
                record_id, *rest = (v.as_py() for v in values)
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    store, inner = _filesystem(f"{path}/{name}")
                    bundle = BundleWriter(store.open_output_stream(inner, compression=None), name, frame_bytes)
                record_id = record_id or uuid.uuid5(uuid.NAMESPACE_OID, f"{bundle.name}/{bundle.records}").urn
                rows += bundle.add(record_id, record_bytes(record_id, *rest, date))
                if bundle.at >= bundle_bytes:
                    rows += bundle.close()
                    bundle = None
            yield out(rows)
        if bundle is not None:
            yield out(bundle.close())

    return tidy(run)


def _records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_payload: int) -> DataFrame:
    """The rows as records (RECORD), equal payloads of at least ``min_payload`` bytes once."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), as_bytes(F.col(payload_col)).alias("payload"))
    base = base.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    large = base.filter(F.col("size") >= min_payload).withColumn("key", F.sha2("payload", 256))
    # How often a row occurs in a task: equal rows of a large group stay spread over as many tasks as they came from.
    seen = cut(large.groupBy("key", "digest", "page_id", "url", F.spark_partition_id().alias("part")).count())
    best = seen.groupBy("key").agg(F.max(F.struct("page_id", "url", "part")).alias("best"), F.any_value("digest").alias("digest"))
    name = F.regexp_replace(F.substring("key", 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "urn:uuid:$1-$2-$3-$4-$5")
    payloads = large.groupBy("key").agg(F.any_value("payload").alias("payload"))
    none = F.lit(None).cast("string")
    ids = F.col("page_id").cast("string").alias("page_id")
    responses = payloads.join(best, "key").select(
        name.alias("record_id"), F.lit("response").alias("record_type"), F.col("best.page_id").cast("string").alias("page_id"), F.col("best.url").alias("url"), "digest", "payload", none.alias("refers_id")
    )
    again = seen.join(best.select("key", "best"), "key")
    again = again.withColumn("times", (F.col("count") - F.when(F.struct("page_id", "url", "part").eqNullSafe(F.col("best")), 1).otherwise(0)).cast("int")).filter("times > 0")
    again = again.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times"))))
    revisits = again.select(none.alias("record_id"), F.lit("revisit").alias("record_type"), ids, "url", "digest", F.lit(None).cast("binary").alias("payload"), name.alias("refers_id"))
    small = base.filter(F.col("size") < min_payload).select(none.alias("record_id"), F.lit("response").alias("record_type"), ids, "url", "digest", "payload", none.alias("refers_id"))
    return small.unionByName(responses).unionByName(revisits)


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = MIN_PAYLOAD, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = DATE
) -> DataFrame:
    """Write a record per row to bundles below ``path`` and their index to ``path``/index; returns the index (INDEX).

    ``path`` is a new folder that all executors share, named as Arrow's file systems name it.
    """
    spark = pages.sparkSession
    store, inner = _filesystem(path)
    store.create_dir(inner, recursive=True)
    rows = _records(pages, id_col, url_col, payload_col, min_payload)
    rows.mapInArrow(_write(path, frame_bytes, bundle_bytes, date), INDEX).write.parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def seek_table(file) -> list[tuple[int, int, int, int, int]]:
    """(frame, place, compressed size, raw size, checksum) of an open bundle's frames, from its last bytes."""
    size = file.size()
    n, flags, magic = _FOOTER.unpack(file.read_at(_FOOTER.size, size - _FOOTER.size))
    if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
        raise ValueError("not a bundle with a seek table and checksums")
    table = file.read_at(n * _ENTRY.size, size - _FOOTER.size - n * _ENTRY.size)
    frames, at = [], 0
    for k in range(n):
        packed, raw, checksum = _ENTRY.unpack_from(table, k * _ENTRY.size)
        frames.append((k, at, packed, raw, checksum))
        at += packed
    return frames


def _frames(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bundle in batch["bundle"]:
                store, inner = _filesystem(f"{path}/{bundle}")
                with store.open_input_file(inner) as file:
                    yield pd.DataFrame([(bundle, *f) for f in seek_table(file)], columns=["bundle", "frame", "at", "size", "raw", "checksum"])

    return run


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of a frame: headers by lower-case name, and the payload of their HTTP block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at} of a frame")
        head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        begin = end + 4
        block = data[begin : begin + int(head["content-length"])]
        at = begin + len(block) + 4
        yield head | {"payload": block[block.index(b"\r\n\r\n") + 4 :]}


def _parsed(record: dict, with_payload: bool) -> tuple:
    payload, kind = record["payload"], record["warc-type"]
    found = kind == "response"
    if found and record["warc-payload-digest"] != "sha1:" + b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError(f"the payload of {record['warc-record-id']} does not have its digest")
    refers, page_id = record.get("warc-refers-to"), record.get("x-page-id")
    return (
        record["warc-record-id"].strip("<>"), kind, page_id and unquote(page_id), record.get("warc-target-uri"), refers and refers.strip("<>"),
        len(payload) if found else None, hashlib.sha1(payload).hexdigest() if found else None, payload if with_payload and found else None,
    )


def _parsed_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")]).astype({"payload_bytes": "Int64"})


def _read(path: str, with_payload: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for bundle, at, size, raw, checksum in zip(batch["bundle"], batch["at"], batch["size"], batch["raw"], batch["checksum"], strict=True):
                store, inner = _filesystem(f"{path}/{bundle}")
                with store.open_input_file(inner) as file:
                    data = unpack(file.read_at(int(size), int(at)), max_output_size=int(raw))
                if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
                    raise ValueError(f"a frame of {bundle} does not have its checksum")
                yield _parsed_frame([_parsed(r, with_payload) for r in parse_records(data)])

    return tidy(run)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records (PARSED) of the bundles that the index of ``path`` names, a frame at a time by way of the seek tables.

    What a revisit refers to is left to :func:`resolved`. Checksums and digests are checked; a mismatch stops the job.
    """
    bundles = read_index(spark, path).groupBy("bundle").agg(F.max(F.col("frame_at") + F.col("frame_size")).alias("bytes"))
    tasks = -(-(bundles.agg(F.sum("bytes")).first()[0] or 0) // READ_BYTES)  # the rows of frames are small, what they stand for is not
    frames = bundles.select("bundle").mapInPandas(_frames(path), "bundle string, frame int, at long, size long, raw long, checksum long")
    return frames.repartition(max(1, tasks), F.xxhash64("bundle", "frame")).mapInPandas(_read(path, with_payload), PARSED)


def _look_up(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (bundle, at, size), asked in batch.groupby(["bundle", "frame_at", "frame_size"]):
                store, inner = _filesystem(f"{path}/{bundle}")
                with store.open_input_file(inner) as file:
                    data = zstandard.ZstdDecompressor().decompressobj().decompress(file.read_at(int(size), int(at)))
                cuts = [data[int(o) : int(o) + int(n)] for o, n in zip(asked["offset"], asked["length"], strict=True)]
                yield _parsed_frame([_parsed(next(parse_records(c)), True) for c in cuts])

    return tidy(run)


def look_up(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The records (PARSED) of ``ids`` (``record_id``): of each bundle only the frames that hold one are read."""
    asked = read_index(spark, path).join(ids.select("record_id").distinct(), "record_id")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # kept, however few bytes name the frames
    return asked.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame").mapInPandas(_look_up(path), PARSED)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``, and revisits with the size and digest of the payload they refer to."""
    first = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    both = records.join(first, "refers_id", "left")
    return both.withColumns({"payload_bytes": F.coalesce("payload_bytes", "_bytes"), "payload_digest": F.coalesce("payload_digest", "_digest")}).drop("_bytes", "_digest")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read these back and remove them. One row per page: the id,
    ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, url_col, payload_col)
    found = cut(read_archives(spark, path, False).drop("payload", "url"))
    remove(spark, path)
    return resolved(found).select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
