"""Token ids of texts by a public word-level BPE vocabulary, with a cache of words.

The vocabulary drops white space and never merges across it, so a text's ids are those of its white-space-separated
parts, one after another, and frequent parts need not be encoded again. A part of plain letters (ASCII and Latin-1) is
normalised here and its pieces go straight to the vocabulary's merge model; any other part goes through the whole
tokenizer. ``tests/llm`` compares both with the tokenizer run on whole texts.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
CACHE_WORDS = 300_000  # about 65 MB a worker, and half as much again at most for their pieces
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")  # fixed value: the vocabulary's own rule
_LONG = 64  # longer words are not kept
_SPACES, _CONTROLS = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[\x1c-\x1f]")
_PLAIN = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff]*")


def _byte_letters() -> dict[int, str]:
    """The vocabulary spells bytes as letters: printable Latin-1 as itself, the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of whole texts as packed little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str | None = None, width: int = 4, cache_words: int = CACHE_WORDS):
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(WORD_BPE))
        self.model, self.dtype, self.limit = self.tokenizer.model, f"<u{width}", cache_words
        self.code = {2: "H", 4: "I"}[width]
        self.letters, self.words, self.pieces = _byte_letters(), {}, {}

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        if (packed := self.pieces.get(piece)) is None:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
            packed = self._pack([t.id for t in self.model.tokenize(spelled)])
            if len(self.pieces) < self.limit // 2 and len(piece) <= _LONG:
                self.pieces[piece] = packed
        return packed

    def _word(self, word: str) -> bytes:
        if "<|" in word or not _PLAIN.fullmatch(word):
            packed = self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
        else:
            packed = b"".join([self._piece(p) for p in _PIECES.findall(word.lower())])
        if len(self.words) < self.limit and len(word) <= _LONG:
            self.words[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        known, encode = self.words.get, self._word
        # str.split() also drops U+001C to U+001F, which the vocabulary keeps
        parts = _SPACES.split(text) if _CONTROLS.search(text) else text.split()
        return b"".join([p if (p := known(w)) is not None else encode(w) for w in parts])


@lru_cache(maxsize=2)
def encoder(path: str | None = None, width: int = 4) -> WordEncoder:
    """One encoder per Python worker, so that its cache lives as long as the worker."""
    return WordEncoder(path, width)
