"""Table functions for SQL: chunks of texts, by name.

    SELECT id, pos, chunk FROM texts, LATERAL chunk_words(text, 500, 50)
    SELECT * FROM chunk_rows(TABLE(SELECT id, text FROM texts) PARTITION BY (id), 'sentences', 5)

``chunk_words``, ``chunk_paragraphs`` and ``chunk_sentences`` take a text. ``chunk_rows`` takes a table, passes its columns on
but the text and numbers the chunks of each partition, of all its rows in a row; what it returns is worked out from the table
and the method when the query is analysed. Null texts have no chunks. The chunks are those of
:mod:`vectorloom.functions.chunkers`, which are faster where a query is written with DataFrames.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from vectorloom.errors import InvalidConfig

# Unicode's white space.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = re.compile(f"[{_SPACE}]+")
_EDGES = re.compile(f"^[{_SPACE}]+|[{_SPACE}]+$")
_SENTENCE = re.compile(r"(?<=[.!?\n])")


def _trimmed(pieces: list[str]) -> list[str]:
    return [p for p in (_EDGES.sub("", piece) for piece in pieces) if p]


def _runs(parts: list[str], size: int, step: int) -> list[str]:
    return [" ".join(parts[i : i + size]) for i in range(0, len(parts), step)]


def word_chunks(text: str | None, size: int = 500, overlap: int = 50) -> list[str]:
    if overlap >= size:
        raise InvalidConfig("Overlap must be less than chunk size")
    return _runs([w for w in _SPACES.split(text or "") if w], size, size - overlap)


def paragraph_chunks(text: str | None) -> list[str]:
    return _trimmed((text or "").split("\n\n"))


def sentence_chunks(text: str | None, sentences: int = 5) -> list[str]:
    if sentences < 1:
        raise InvalidConfig("A chunk must hold at least one sentence")
    return _runs(_trimmed(_SENTENCE.split(text or "")), sentences, sentences)


_METHODS = {"words": word_chunks, "paragraphs": paragraph_chunks, "sentences": sentence_chunks}


@udtf(returnType="pos int, chunk string")
class ChunkWords:
    def eval(self, text: str, size: int = 500, overlap: int = 50) -> Iterator[tuple]:
        yield from enumerate(word_chunks(text, size, overlap))


@udtf(returnType="pos int, chunk string")
class ChunkParagraphs:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from enumerate(paragraph_chunks(text))


@udtf(returnType="pos int, chunk string")
class ChunkSentences:
    def eval(self, text: str, sentences: int = 5) -> Iterator[tuple]:
        yield from enumerate(sentence_chunks(text, sentences))


@udtf
class ChunkRows:
    """Of a table with a column ``text``: its other columns, ``pos`` within the partition, and ``chunk``."""

    def __init__(self):
        self._pos = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, method: AnalyzeArgument, *numbers: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or "text" not in rows.dataType.names:
            raise InvalidConfig("chunk_rows needs a table with a column named text")
        if method.value not in _METHODS:
            raise InvalidConfig(f"chunks are {', '.join(_METHODS)}, not {method.value}")
        kept = [f for f in rows.dataType.fields if f.name != "text"]
        return AnalyzeResult(T.StructType([*kept, T.StructField("pos", T.IntegerType()), T.StructField("chunk", T.StringType())]))

    def eval(self, row: Row, method: str, *numbers: int) -> Iterator[tuple]:
        kept = [v for name, v in row.asDict().items() if name != "text"]
        for chunk in _METHODS[method](row["text"], *numbers):
            yield (*kept, self._pos, chunk)
            self._pos += 1


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, function in (("chunk_words", ChunkWords), ("chunk_paragraphs", ChunkParagraphs), ("chunk_sentences", ChunkSentences), ("chunk_rows", ChunkRows)):
        spark.udtf.register(name, function)
