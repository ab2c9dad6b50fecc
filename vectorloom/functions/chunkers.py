"""Chunkers: text columns to arrays of chunks. White space is Unicode's."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.errors import InvalidConfig

_EDGES = r"(?U)^\s+|\s+$"


def unicode_trim(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def _runs(parts: Column, size: int, step: int) -> Column:
    """Runs of ``size`` parts, one every ``step`` parts, each joined by one space; no parts, no runs."""

    def runs(all_parts: Column) -> Column:
        n = F.size(all_parts)
        starts = F.sequence(F.lit(0), n - 1, F.lit(step))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(all_parts, i + 1, F.lit(size)), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(joined)

    # as a lambda's variable the parts are made once for a text; a plain column would be made again for every run
    return F.element_at(F.transform(F.array(parts), runs), 1)


class Chunker(ABC):
    """Splits a text column into an array column of chunks."""

    @abstractmethod
    def chunks(self, text: Column) -> Column: ...

    def explode(self, df: DataFrame, text_col: str = "text", chunk_col: str = "chunk", pos_col: str = "pos") -> DataFrame:
        """One row per chunk, with its place; all columns of the input stay."""
        return df.select("*", F.posexplode(self.chunks(F.col(text_col))).alias(pos_col, chunk_col))


@dataclass(frozen=True)
class FixedSizeChunker(Chunker):
    """Windows of ``size`` words that overlap by ``overlap``; a last window may lie wholly in the overlap."""

    size: int = 500
    overlap: int = 50

    def chunks(self, text: Column) -> Column:
        if self.overlap >= self.size:
            raise InvalidConfig("Overlap must be less than chunk size")
        words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
        return _runs(words, self.size, self.size - self.overlap)


@dataclass(frozen=True)
class ParagraphChunker(Chunker):
    """Pieces between two newlines in a row, trimmed; empty ones dropped."""

    def chunks(self, text: Column) -> Column:
        return F.filter(F.transform(F.split(text, r"\n\n"), unicode_trim), lambda p: p != "")


@dataclass(frozen=True)
class SentenceChunker(Chunker):
    """Groups of ``sentences`` sentences. A sentence ends after each of ``. ! ?`` and the newline."""

    sentences: int = 5

    def chunks(self, text: Column) -> Column:
        if self.sentences < 1:
            raise InvalidConfig("A chunk must hold at least one sentence")
        found = F.filter(F.transform(F.split(text, r"(?<=[.!?\n])"), unicode_trim), lambda s: s != "")
        return _runs(found, self.sentences, self.sentences)
