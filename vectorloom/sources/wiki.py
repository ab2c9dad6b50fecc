"""Encyclopedia summaries over a REST API: one row per title, fetched in tasks by a function (url) -> (status, body)."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from vectorloom.errors import EmbeddingError, HttpError

Fetch = Callable[[str], tuple[int, str]]


def http_get(url: str) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(url) as reply:
            return reply.status, reply.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, ""
    except urllib.error.URLError as e:
        raise HttpError(str(e.reason)) from e


def _slug(title: str) -> str:
    return quote(title.replace(" ", "_"), safe="")


def summary(title: str, language: str, fetch: Fetch) -> tuple[str, str, dict[str, str]]:
    """(content, source, metadata) of one page."""
    status, text = fetch(f"https://{language}.wikipedia.org/api/rest_v1/page/summary/{_slug(title)}")
    if not 200 <= status < 300:
        raise EmbeddingError(f"Wiki API returned status: {status}")
    try:
        body = json.loads(text)
    except ValueError as e:
        raise HttpError(str(e)) from e
    found = body if isinstance(body, dict) else {}
    name = found["title"] if isinstance(found.get("title"), str) else title
    content = found.get("extract")
    if not isinstance(content, str) or not content:
        raise EmbeddingError("Wiki page has no extractable content")
    return content, name, {"format": "wiki", "language": language, "url": f"https://{language}.wikipedia.org/wiki/{_slug(name)}"}


def read_wiki(spark: SparkSession, titles: list[str] | DataFrame, language: str = "en", fetch: Fetch = http_get) -> DataFrame:
    """(content, source, metadata), a row per title; titles are a list or a DataFrame with a ``title`` column."""
    if not isinstance(titles, DataFrame):
        titles = spark.createDataFrame([(t,) for t in titles], "title string").repartition(max(1, len(titles)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [summary(t, language, fetch) for t in batch["title"]]
            yield pd.DataFrame(rows, columns=["content", "source", "metadata"])

    return titles.select("title").mapInPandas(run, "content string, source string, metadata map<string,string>")
