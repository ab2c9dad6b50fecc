"""Secret scans over text and whatever is encoded in it.

A worklist unwraps a text's layers: percent-encoded runs, Unicode escapes and character references, base64 runs (also
over several lines), and compressed data inside any of them. A layer's text with all its percent-encoded runs decoded,
or all its escapes and references, is a layer, so finds may cross from one run or word to the next. Each decoded run becomes a layer of its own, together with the name, if any, and a little of the text
before it (so ``password =`` still meets a decoded value), and every layer is scanned and unwrapped again until nothing
new appears; a layer that is one of those around it is not taken again, so cycles end. Each character of a layer knows
which characters of the layer around it it came from, and what is found in a layer is reported at that place in the text,
at each of its places if the layer occurs more than once.

Defined cases: null text is empty and has no secrets; positions are code points, ends exclusive; a layer's find at the
place and of the kind of another is one find; decoded data that is neither text nor compressed is dropped; compressed
data is read to its end, over all its members, in windows that overlap; where it is damaged, as far as it is sound; repeated rows are scanned each; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The contract's three kinds, in its order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

STEP, OVERLAP = 1 << 20, 1 << 16  # bytes inflated at a time; characters that windows over them share
MAX_DONE = 100_000
CONTEXT = 48
_BETWEEN = " :=\"'"  # what the contract's first kind has between name and value
_KEYWORDS = ("passw", "secret", "token", "api")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_PERCENTS = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LINES = [re.compile(rf"[{c}]{{16,}}(?:[ \t]*(?:\r\n|\n|\r)[ \t]*[{c}]+)+={{0,2}}") for c in ("A-Za-z0-9+/", "A-Za-z0-9_-")]
_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
_BASE64_LINE = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_SURROGATES = re.compile("[\udc80-\udcff]")
_PARTS = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}")

Span = tuple[int, int, int]  # start, kind, end


def _tokens(text: str, least: int) -> Iterator[tuple[int, str]]:
    """Parts of at least so many characters between white space, with their places."""
    at = 0
    for part in text.split():
        if len(part) >= least:
            at = text.index(part, at)
            yield at, part
            at += len(part)


def scan(text: str) -> list[Span]:
    """Spans of the three kinds in one text: leftmost, not overlapping within a kind, those that are too short dropped."""
    found: list[Span] = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    for at, part in _tokens(text, LEAST["hex"]):
        found += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(part) if m.end() - m.start() >= LEAST["hex"]]
    return found


def _members(data: bytes) -> Iterator[bytes]:
    """What compressed data holds, member by member, in pieces of at most STEP bytes; nothing if it is not compressed."""
    while data:
        if data[:4] == b"\x28\xb5\x2f\xfd" or data[1:4] == b"\x2a\x4d\x18":
            reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
            while piece := reader.read(STEP):
                yield piece
            return
        if data[:2] == b"\x1f\x8b":
            unpack = zlib.decompressobj(31)
        elif data[:1] == b"\x78" and len(data) > 6 and int.from_bytes(data[:2], "big") % 31 == 0:
            unpack = zlib.decompressobj()
        elif data[:3] == b"BZh":
            unpack = bz2.BZ2Decompressor()
        elif data[:6] == b"\xfd7zXZ\x00":
            unpack = lzma.LZMADecompressor()
        else:
            return
        while not unpack.eof:
            piece = unpack.decompress(data, STEP)
            data = getattr(unpack, "unconsumed_tail", b"")
            if piece:
                yield piece
            elif not data and getattr(unpack, "needs_input", True):
                return  # it breaks off
        data = unpack.unused_data.lstrip(b"\0")


def _inflate(data: bytes) -> Iterator[bytes]:
    """What compressed data holds, as far as it is sound."""
    try:
        yield from _members(data)
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
        pass


def _word_start(text: str, at: int) -> int:
    """Where the run without white space that ends at a place begins: looked for near to it first, so that it costs its length."""
    size = 256
    while True:
        low = max(0, at - size)
        last = max(text.rfind(c, low, at) for c in " \t\n\r")
        if last >= 0 or not low:
            return last + 1
        size *= 2


def _unit_start(text: str, at: int) -> int:
    """Where the word at a place begins, or the lines of base64 that it goes on."""
    while at:
        begin = _word_start(text, at)
        if not begin or text[begin - 1] not in "\n\r":
            return begin
        above = begin
        while above and text[above - 1] in " \t\r\n":
            above -= 1
        if not above or not _BASE64_LINE.fullmatch(text, _word_start(text, above), above):
            return begin
        at = above
    return 0


def _windows(pieces: Iterator[bytes]) -> Iterator[str]:
    """Text in windows that overlap. No word and no lines of base64 are cut: a window grows until they end."""
    decoder = codecs.getincrementaldecoder("utf-8")("surrogateescape")
    held, least = "", 0
    for piece in pieces:
        held += decoder.decode(piece)
        if len(held) < max(least, 2 * OVERLAP):
            continue
        tail = _unit_start(held, len(held))
        keep = _unit_start(held, max(tail - OVERLAP, 0))
        if keep * 2 < len(held):
            least = 2 * len(held)
            continue
        yield held[:tail]
        held, least = held[keep:], 0
    held += decoder.decode(b"", True)
    if held:
        yield held


def _is_text(text: str) -> bool:
    """Some text, with next to no control characters or bytes that were not UTF-8."""
    odd = sum(not (c.isprintable() or c in "\t\n\r") for c in text)
    return bool(text) and odd * 20 <= len(text)


Decoded = tuple[str, np.ndarray, np.ndarray]  # a layer's text; for each character, start and end in the text decoded


def _from_bytes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[Decoded]:
    """Decoded bytes as a layer, and what they hold if compressed. starts, ends: where each byte came from."""
    for text in _windows(_inflate(data)):
        if _is_text(text):  # any character depends on the whole run
            yield _SURROGATES.sub("\ufffd", text), np.broadcast_to(starts[0], len(text)), np.broadcast_to(ends[-1], len(text))
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return
    if _is_text(text):
        widths = np.array([len(c.encode()) for c in text])
        stop = np.cumsum(widths)
        yield text, starts[stop - widths], ends[stop - 1]


def _percent(run: str) -> Iterator[Decoded]:
    data, starts, ends, at = bytearray(), [], [], 0
    for m in [*_PERCENT.finditer(run), None]:
        plain = run[at : m.start() if m else len(run)]
        for k, c in enumerate(plain):
            raw = c.encode()
            data += raw
            starts += [at + k] * len(raw)
            ends += [at + k + 1] * len(raw)
        if m:
            data.append(int(m[0][1:], 16))
            starts.append(m.start())
            ends.append(m.end())
            at = m.end()
    yield from _from_bytes(bytes(data), np.array(starts), np.array(ends))


def _escapes(run: str) -> Decoded:
    return _replaced(run, _escape_pieces(run))


def _base64(run: str) -> Iterator[Decoded]:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except ValueError:
        return
    if not data:
        return
    at = np.arange(len(data))
    yield from _from_bytes(data, at * 8 // 6, np.minimum(-(-(at + 1) * 8 // 6), len(run)))


def _replaced(text: str, pieces: Iterator[tuple[int, int, str, list[int], list[int]]]) -> Decoded:
    """A text in which pieces (start, end, what stands for it, where each character of that came from) are replaced."""
    out, starts, ends, at = [], [], [], 0
    for start, stop, inside, begun, ended in pieces:
        plain = np.arange(at, start)
        out += [text[at:start], inside]
        starts += [plain, np.array(begun, np.int64)]
        ends += [plain + 1, np.array(ended, np.int64)]
        at = stop
    plain = np.arange(at, len(text))
    return "".join([*out, text[at:]]), np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1])


def _percent_pieces(text: str) -> Iterator[tuple[int, int, str, list[int], list[int]]]:
    """Percent-encoded runs; bytes that are not UTF-8 stay as they are."""
    for m in _PERCENTS.finditer(text):
        out, starts, ends, at = [], [], [], m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            if "\udc80" <= c <= "\udcff":
                out.append(text[at : at + 3])
                starts += range(at, at + 3)
                ends += range(at + 1, at + 4)
                at += 3
            else:
                out.append(c)
                starts.append(at)
                at += 3 * len(c.encode())
                ends.append(at)
        yield m.start(), m.end(), "".join(out), starts, ends


def _escape_pieces(text: str) -> Iterator[tuple[int, int, str, list[int], list[int]]]:
    for m in _ESCAPE.finditer(text):
        code = int(m[5]) if m[5] else int(next(g for g in m.groups() if g), 16)
        yield m.start(), m.end(), chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "\ufffd", [m.start()], [m.end()]


def _joined(text: str) -> Iterator[tuple[int, int, Decoded]]:
    """(start, end, layer) of base64 that goes over several lines.

    Words beside it may look like more of it, so it is also tried without the first or the last line, and where it goes on
    in lines of one length and a last one that is not longer.
    """
    groups = {(m.start(), m.end()) for kind in _LINES for m in kind.finditer(text)}
    for first, end in sorted(groups):
        lines = [(first + m.start(), first + m.end()) for m in _LINE.finditer(text[first:end])]
        n = len(lines)
        tried = {(0, n), (1, n), (0, n - 1), (1, n - 1)}
        width, k = [b - a for a, b in lines], 0
        while k < n:
            j = k + 1
            while j < n and width[j] == width[k]:
                j += 1
            tried |= {(k, j), (k, j + (j < n and width[j] < width[k]))}
            k = j
        for i, j in sorted(tried):
            if j - i < 2:
                continue
            place = np.concatenate([np.arange(a, b) for a, b in lines[i:j]])
            for inside, starts, ends in _base64("".join(text[a:b] for a, b in lines[i:j])):
                at = lines[i][0]
                yield at, lines[j - 1][1], (inside, place[starts] - at, place[ends - 1] + 1 - at)


def unwrap(text: str) -> Iterator[tuple[int, int, Decoded]]:
    """(start, end, layer) of each encoded run of one text, and of the whole text with all its escapes of a sort decoded."""
    percent, escaped, long = "%" in text, "\\" in text or "&#" in text, False
    if percent and _PERCENT.search(text):
        yield 0, len(text), _replaced(text, _percent_pieces(text))
    if escaped and _ESCAPE.search(text):
        yield 0, len(text), _replaced(text, _escape_pieces(text))
    for at, part in _tokens(text, 3 if percent or escaped else 16):
        if percent and _PERCENT.search(part):
            for layer in _percent(part):
                yield at, at + len(part), layer
        if escaped and _ESCAPE.search(part):
            yield at, at + len(part), _escapes(part)
        if len(part) >= 16:
            for m in _BASE64.finditer(part):
                long, whole = True, False
                for layer in _base64(m[0]):
                    whole = True
                    yield at + m.start(), at + m.end(), layer
                if not whole and not m[0].isalnum():
                    for p in _PARTS.finditer(m[0]):
                        for layer in _base64(p[0]) if p[0] != m[0] else ():
                            yield at + m.start() + p.start(), at + m.start() + p.end(), layer
    if long and ("\n" in text or "\r" in text):
        yield from _joined(text)


@dataclass
class _Layer:
    key: tuple[str | bytes, int]  # its text (a long one's digest), and how much of that stands before the run
    text: str
    spans: set[Span]  # found in it and in the layers below it, at their places in its text
    runs: Iterator[tuple[int, int, Decoded]]
    starts: np.ndarray | None = None  # for each character, where it came from in the layer above
    ends: np.ndarray | None = None
    partial: bool = False  # a layer below was not taken, as it is one of those above

    def take(self, spans: set[Span], starts: np.ndarray, ends: np.ndarray) -> None:
        self.spans.update((int(starts[a]), kind, int(ends[b - 1])) for a, kind, b in spans)  # neither ever falls


def _key(text: str, ahead: int) -> tuple[str | bytes, int]:
    return text if len(text) <= 4096 else hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), ahead


def _layer(text: str, ahead: int, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> _Layer:
    # what ends in the part before the run is the upper layer's
    return _Layer(_key(text, ahead), text, {s for s in scan(text) if s[2] > ahead}, unwrap(text), starts, ends)


def scan_layers(text: str) -> tuple[list[Span], list[Span]]:
    """(spans in the text itself, spans in it and all its layers), each in order."""
    top = _layer(text, 0)
    base = sorted(top.spans)
    chain, depth = [top], {top.key: 0}  # the open layers, each inside the one before it
    done: dict[tuple[str | bytes, int], set[Span]] = {}  # equal layers are scanned once and reported at each of their places
    while chain:
        layer = chain[-1]
        run = next(layer.runs, None)
        if run is None:
            chain.pop()
            del depth[layer.key]
            if len(done) >= MAX_DONE:
                done.clear()
            if not layer.partial:
                done[layer.key] = layer.spans
            if chain:
                chain[-1].take(layer.spans, layer.starts, layer.ends)
            continue
        start, stop, (inside, starts, ends) = run
        around, ahead = layer.text, layer.key[1]
        if stop <= ahead or inside == around[start:stop]:
            continue
        left = start
        while left and around[left - 1] in _BETWEEN:  # however far a value stands from its name
            left -= 1
        left = max(left - CONTEXT, 0)
        before = start - left if start else int(np.searchsorted(ends, ahead, "right"))  # of the whole text, what came from there
        whole = around[left:start] + inside
        key = _key(whole, before)
        if key in depth:
            for between in chain[depth[key] + 1 :]:
                between.partial = True
            continue
        own_starts = np.concatenate([np.arange(left, start), start + starts])
        own_ends = np.concatenate([np.arange(left, start) + 1, start + ends])
        if key in done:
            layer.take(done[key], own_starts, own_ends)
        else:
            depth[key] = len(chain)
            chain.append(_layer(whole, before, own_starts, own_ends))
    return base, sorted(top.spans)


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, shas, shown = [[], [], []], [], []
        for text in batch.column("text"):
            base, spans = scan_layers(text.as_py() or "")
            for k in range(3):
                counts[k].append(sum(s[1] == k for s in base))
            shas.append(hashlib.sha256(render(base).encode()).hexdigest())
            shown.append(render(spans))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(shown, pa.string())], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_assign``, ``n_access``, ``n_hex`` (in the text itself), ``base_sha256``, ``spans``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return rows.mapInArrow(_scan_batches, schema).withColumnRenamed("id", id_col)
