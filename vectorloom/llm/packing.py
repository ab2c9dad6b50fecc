"""Packing token pieces into windows of a fixed length: bounded-space online best fit.

Each partition keeps a fixed number of windows open. A document is cut into full windows and a rest; the rest goes to
the open window it fills best. When it fits none and no slot is free, the fullest window is emitted; if its gap is worth
a cut, the piece first fills the gap. What is open at a partition's end is merged: groups of leftovers are packed again
with the same rule, round by round, each group bounded in size, until one group is left; the last group is cut into
sequences whose lengths are powers of two, which need no padding.

Only leftovers carry their ids (at most ``open_windows`` windows per partition), so merging can cut them; emitted
pieces are described by their place, length and checksum.

Defined cases: a null or empty text is its end mark alone; documents of any length; repeated rows are packed each; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vectorloom.llm.common import cut, tidy
from vectorloom.llm.tokenize import encoder

WINDOW, END_ID = 4096, 2  # fixed values of the contract
OPEN_WINDOWS = 32
CUT_GAP = 24  # a gap of at least so many ids is filled by cutting the next piece
MERGE_TASKS = 64
_WIDTH = 4

PIECE = "id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, leftover boolean, ids binary"


class Packer:
    """Open windows of one task. Pieces are (id, start, ids, doc_tokens); emit(pieces) takes a closed window."""

    def __init__(self, emit, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, cut_gap: int = CUT_GAP):
        self.emit, self.window, self.most, self.cut_gap = emit, window, open_windows, cut_gap
        self.open: list[tuple[int, list]] = []  # (filled, pieces)

    def add(self, doc, start: int, ids: memoryview, doc_tokens: int) -> None:
        length = len(ids) // _WIDTH
        while length >= self.window:
            self.emit([(doc, start, ids[: self.window * _WIDTH], doc_tokens)])
            start, ids, length = start + self.window, ids[self.window * _WIDTH :], length - self.window
        while length:
            fits = [k for k, (filled, _) in enumerate(self.open) if filled + length <= self.window]
            if fits:
                k = max(fits, key=lambda k: self.open[k][0])
            elif len(self.open) < self.most:
                k = len(self.open)
                self.open.append((0, []))
            else:
                k = max(range(len(self.open)), key=lambda k: self.open[k][0])
            filled, pieces = self.open[k]
            taken = min(length, self.window - filled)
            if taken == length or taken >= self.cut_gap:
                pieces.append((doc, start, ids[: taken * _WIDTH], doc_tokens))
                start, ids, length = start + taken, ids[taken * _WIDTH :], length - taken
                filled += taken
            if filled == self.window or (length and not fits):
                self.emit(pieces)
                del self.open[k]
            else:
                self.open[k] = (filled, pieces)


def _rows(pieces: list, sequence: int, leftover: bool) -> list[tuple]:
    out, offset = [], 0
    for doc, start, ids, doc_tokens in pieces:
        length = len(ids) // _WIDTH
        out.append((doc, start, length, zlib.crc32(ids), doc_tokens, sequence, offset, leftover, bytes(ids) if leftover else None))
        offset += length
    return out


NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "leftover", "ids"]


def _pack(id_type: pa.DataType, path: str | None, window: int, open_windows: int):
    kinds = [id_type, *[pa.int64()] * 6, pa.bool_(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, encode = np.array([END_ID], "<u4").tobytes(), encoder(path, _WIDTH).encode
        rows: list[tuple] = []
        base, made = None, 0

        def emit(pieces: list, leftover: bool = False) -> None:
            nonlocal made
            rows.extend(_rows(pieces, base + made, leftover))
            made += 1

        packer = Packer(emit, window, open_windows)
        for batch in batches:
            if base is None:
                base = (batch.column("task")[0].as_py() << 33) if batch.num_rows else None
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("body"), strict=True):
                ids = memoryview(encode(text.as_py()) + end)
                packer.add(doc, 0, ids, len(ids) // _WIDTH)
            yield batch_of(rows)
            rows.clear()
        for _, pieces in packer.open:
            emit(pieces, True)
        yield batch_of(rows)

    return tidy(run)


def _merge(window: int, open_windows: int, last: bool):
    """Pack a bounded group of leftover windows; what is still open stays left over, or is cut into powers of two."""

    def run(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["sequence_id", "offset"])
        rows: list[tuple] = []
        task = int(frame["sequence_id"].min()) >> 33
        base, made = (task << 33) | (1 << 32) | (int(key[1]) << 24), 0

        def emit(pieces: list, leftover: bool = False) -> None:
            nonlocal made
            rows.extend(_rows(pieces, base + made, leftover))
            made += 1

        packer = Packer(emit, window, 1 if last else open_windows)
        for doc, start, ids, tokens in zip(frame["id"], frame["start"], frame["ids"], frame["doc_tokens"], strict=True):
            packer.add(doc, int(start), memoryview(ids), int(tokens))
        for filled, pieces in packer.open:
            if not last:
                emit(pieces, True)
                continue
            for bit in range(filled.bit_length() - 1, -1, -1):
                if filled >> bit & 1:
                    taken, pieces = _take(pieces, 1 << bit)
                    emit(taken)
        return pd.DataFrame(rows, columns=NAMES)

    return run


def _take(pieces: list, n: int) -> tuple[list, list]:
    """The first n ids of a run of pieces, and the rest of the run."""
    taken = []
    while n:
        doc, start, ids, tokens = pieces[0]
        length = len(ids) // _WIDTH
        if length <= n:
            taken.append(pieces[0])
            pieces, n = pieces[1:], n - length
        else:
            taken.append((doc, start, ids[: n * _WIDTH], tokens))
            pieces, n = [(doc, start + n, ids[n * _WIDTH :], tokens), *pieces[1:]], 0
    return taken, pieces


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``."""
    body = docs.select(F.spark_partition_id().alias("task"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    kind = body.schema["id"].dataType
    schema = PIECE.format(id=kind.simpleString())
    packed = cut(body.mapInArrow(_pack(to_arrow_type(kind), tokenizer_path, window, open_windows), schema))
    done = [packed.filter("not leftover").drop("ids", "leftover")]
    left, groups, turn = packed.filter("leftover"), packed.rdd.getNumPartitions(), 0
    while True:
        groups, turn = -(-groups // MERGE_TASKS), turn + 1
        last = groups <= 1
        key = F.pmod(F.shiftrightunsigned(F.col("sequence_id"), 33), F.lit(groups)).alias("group")
        merged = left.groupBy(key, F.lit(turn).alias("turn")).applyInPandas(_merge(window, open_windows, last), schema)
        if last:
            done.append(merged.drop("ids", "leftover"))
            break
        merged = cut(merged)
        done.append(merged.filter("not leftover").drop("ids", "leftover"))
        left = merged.filter("leftover")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("id", id_col)
