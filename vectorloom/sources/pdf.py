"""PDF files as rows of text: one row per file, pages under a header line each.

The text is what literal strings before ``Tj`` and in arrays before ``TJ`` show, as bytes of Latin-1, without fonts'
encodings. Read are objects that stand in the file itself (no object streams), raw or deflated; a page's contents count
if they are one stream, not an array of references.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from vectorloom.errors import SourceIOError

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_KIDS = re.compile(rb"/Kids\s*\[(.*?)\]", re.DOTALL)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_CONTENTS = re.compile(rb"/Contents\s+(\d+)\s+\d+\s+R")
_SHOW = re.compile(rb"T[jJ](?=.)", re.DOTALL)
_WHITE = b" \t\n\x0c\r"
# The named escapes of PDF literal strings.
_NAMED = {b"n": "\n", b"r": "\r", b"t": "\t", b"b": "\b", b"f": "\f"}
_ESCAPED = re.compile(rb"\\([0-9]{1,3}|.)|(.)", re.DOTALL)


def decode_string(raw: bytes) -> str:
    """A literal string's text: escapes resolved, other bytes as Latin-1. Octal escapes with an 8 or 9 vanish."""

    def one(m: re.Match) -> str:
        escape, plain = m.groups()
        if plain is not None:
            return plain.decode("latin-1")
        if escape.isdigit():
            return chr(int(escape, 8)) if not re.search(rb"[89]", escape) else ""
        return _NAMED.get(escape, escape.decode("latin-1"))

    return "".join(one(m) for m in _ESCAPED.finditer(raw))


def closing_paren(data: bytes, start: int) -> int | None:
    """Place of the parenthesis that closes the one at ``start``; an escaped character is skipped."""
    depth = 0
    for m in re.finditer(rb"\\.|[()]", data[start:], re.DOTALL):
        depth += {b"(": 1, b")": -1}.get(m[0], 0)
        if depth == 0 and m[0] == b")":
            return start + m.start()
    return None


def array_text(data: bytes) -> str:
    """All literal strings of an array; numbers between them are ignored."""
    out, at = [], data.find(b"(")
    while at >= 0:
        end = closing_paren(data, at)
        if end is not None:
            out.append(decode_string(data[at + 1 : end]))
        at = data.find(b"(", at + 1 if end is None else end + 1)
    return "".join(out)


def string_before(data: bytes, pos: int) -> bytes | None:
    """The literal string that ends right before ``pos``. The search runs backwards and knows escapes only as a character
    to leave out on the way; a string that opens at the very first byte is not seen.
    """
    end = len(data[:pos].rstrip(_WHITE))
    if not end or data[end - 1 : end] != b")":
        return None
    depth, at = 0, end - 1
    while at > 0:
        c = data[at : at + 1]
        depth += {b")": 1, b"(": -1}.get(c, 0)
        if c == b"(" and not depth:
            return data[at + 1 : end - 1]
        at -= 2 if c == b"\\" else 1
    return None


def array_before(data: bytes, pos: int) -> bytes | None:
    """The array that ends right before ``pos``, nested ones included."""
    end = len(data[:pos].rstrip(_WHITE))
    if not end or data[end - 1 : end] != b"]":
        return None
    depth = 0
    for at in range(end - 1, -1, -1):
        depth += {b"]": 1, b"[": -1}.get(data[at : at + 1], 0)
        if not depth:
            return data[at + 1 : end - 1]
    return None


def content_text(data: bytes) -> str:
    """Text of a content stream. An operator needs a byte after it to be seen."""
    out = []
    for m in _SHOW.finditer(data):
        found = string_before(data, m.start()) if m[0] == b"Tj" else array_before(data, m.start())
        if found is not None:
            out.append(decode_string(found) if m[0] == b"Tj" else array_text(found))
    return "".join(out)


def _stream_of(body: bytes) -> bytes | None:
    m = _STREAM.search(body)
    if not m:
        return None
    if b"/FlateDecode" in body[: m.start()]:
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error:
            return m[1]
    return m[1]


def pdf_text(data: bytes) -> str:
    """Text of a file's pages in order of the page tree; raises if there is no page tree."""
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    if not data.startswith(b"%PDF-") or not objects:
        raise SourceIOError("Failed to load PDF: no objects found")
    kids = {n: [int(k) for k in _REF.findall(m[1])] for n, body in objects.items() if (m := _KIDS.search(body))}
    inner = {k for ks in kids.values() for k in ks}
    work, pages, seen = [n for n in reversed(list(kids)) if n not in inner], [], set()
    while work:
        n = work.pop()
        if n in seen:
            continue
        seen.add(n)
        if n in kids:
            work += reversed(kids[n])
        elif _PAGE.search(objects.get(n, b"")):
            pages.append(n)
    parts = []
    for number, n in enumerate(pages, 1):
        ref = _CONTENTS.search(objects[n])
        stream = _stream_of(objects.get(int(ref[1]), b"")) if ref else None
        parts.append(f"--- Page {number} ---\n" + (content_text(stream) if stream is not None else ""))
    return "\n".join(parts)


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(content, source, metadata) of the PDF files at a path or pattern. A file that cannot be read fails the job."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            local = [p.removeprefix("file:") for p in batch["path"]]
            names = [p.rstrip("/").rsplit("/", 1)[-1] or "unknown.pdf" for p in local]
            yield pd.DataFrame({"content": [pdf_text(bytes(b)) for b in batch["content"]], "source": names, "metadata": [{"format": "pdf", "path": p} for p in local]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "content string, source string, metadata map<string,string>")
