"""Embedding models: text columns to vector columns, by vectorised UDFs or plain expressions.

Network models take a ``post`` function (url, headers, body) -> (status, text), so any transport will do.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vectorloom.errors import EmbeddingError, HttpError, JsonError

Post = Callable[[str, dict[str, str], dict], tuple[int, str]]


def http_post(url: str, headers: dict[str, str], body: dict) -> tuple[int, str]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request) as reply:
            return reply.status, reply.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")
    except urllib.error.URLError as e:
        raise HttpError(str(e.reason)) from e


class Embedder(ABC):
    """A model. ``embed`` works on a list of texts; ``column`` on a text column, a batch of rows at a time."""

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def embed_single(self, text: str) -> list[float]:
        found = self.embed([text])
        if not found:
            raise EmbeddingError("No embedding returned")
        return found[0]

    def column(self, text: Column) -> Column:
        model = self

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                found = model.embed(texts.fillna("").tolist())
                # as many rows must leave as came: missing vectors are null, surplus ones are dropped
                yield pd.Series([*found[: len(texts)], *[None] * (len(texts) - len(found))])

        return run(text)


class OpenAIEmbedder(Embedder):
    """One request for a batch; vectors in the order of the reply."""

    def __init__(self, api_key: str, model: str = "text-embedding-ada-002", base_url: str = "https://api.openai.com/v1", post: Post = http_post):
        self.api_key, self.model, self.base_url, self.post = api_key, model, base_url, post

    def embed(self, texts: list[str]) -> list[list[float]]:
        status, text = self.post(f"{self.base_url}/embeddings", {"Authorization": f"Bearer {self.api_key}"}, {"input": texts, "model": self.model})
        if not 200 <= status < 300:
            raise EmbeddingError(text)
        return [d["embedding"] for d in _reply(text, "data")]


class OllamaEmbedder(Embedder):
    """One request per text."""

    def __init__(self, model: str, base_url: str = "http://localhost:11434", post: Post = http_post):
        self.model, self.base_url, self.post = model, base_url, post

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            status, text = self.post(f"{self.base_url}/api/embeddings", {}, {"model": self.model, "prompt": t})
            if not 200 <= status < 300:
                raise EmbeddingError(text)
            out.append(_reply(text, "embedding"))
        return out


def _reply(text: str, key: str):
    try:
        return json.loads(text)[key]
    except (ValueError, KeyError, TypeError) as e:
        raise JsonError(str(e)) from e


class ByteEmbedder(Embedder):
    """A text's bytes divided by 255: as many numbers as bytes, so vectors differ in length."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[b / 255 for b in t.encode()] for t in texts]


LETTERS = "abcdefghijklmnopqrstuvwxyz"


class LetterEmbedder(Embedder):
    """How often each of the letters a to z occurs, in lower case: no network, and plain expressions in Spark."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.lower().count(c)) for c in LETTERS] for t in texts]

    def column(self, text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("float") for c in LETTERS])


