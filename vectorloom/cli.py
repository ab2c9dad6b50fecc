"""Command line: add a file, query, list, count. ``--store`` keeps the collection between calls, as Parquet."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from vectorloom.functions.chunkers import FixedSizeChunker, ParagraphChunker
from vectorloom.operators.embedders import Embedder
from vectorloom.operators.retriever import Retriever
from vectorloom.operators.store import DataFrameStore
from vectorloom.rpc import default_model


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vectorloom")
    top.add_argument("--store", help="folder of the collection; without it every call begins with none")
    commands = top.add_subparsers(dest="command", required=True)
    add = commands.add_parser("add")
    add.add_argument("--file", required=True)
    add.add_argument("--source", default="document")
    query = commands.add_parser("query")
    query.add_argument("--query", required=True)
    query.add_argument("--top-k", type=int, default=5)
    page = commands.add_parser("list")
    page.add_argument("--limit", type=int, default=10)
    page.add_argument("--offset", type=int, default=0)
    commands.add_parser("count")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None, model: Embedder | None = None, show=print) -> None:
    asked = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("vectorloom").getOrCreate()
    model = model or default_model(os.environ.get("OLLAMA_URL"))
    store = DataFrameStore.load_parquet(spark, asked.store) if asked.store and os.path.isdir(asked.store) else DataFrameStore(spark)
    show(f"Using embedding model: {type(model).__name__.removesuffix('Embedder')}")
    if asked.command == "add":
        text = spark.read.text(asked.file, wholetext=True).head()
        show(f"Adding document: {asked.file}")
        ids = Retriever(model, store, ParagraphChunker()).add_document_with_metadata(text[0] if text else "", [("source", asked.source), ("path", asked.file)])
        if asked.store:
            _keep(store, asked.store)
        show(f"Document added successfully. Chunk IDs: {ids}\nSource: {asked.source}")
    elif asked.command == "query":
        show(f"Query: {asked.query}")
        found = Retriever(model, store, FixedSizeChunker(500, 50), asked.top_k).retrieve_with_scores(asked.query).orderBy("rank").collect()
        show(f"\nFound {len(found)} relevant chunks:\n" if found else "No results found.")
        for r in found:
            show(f"{r['rank']}. Score: {r['score']:.4f}\n   {r['content']}\n")
    elif asked.command == "list":
        rows = store.list(asked.limit, asked.offset).collect()
        show(f"Showing {len(rows)} documents (total: {store.count()}):")
        for i, r in enumerate(rows):
            more = f"   Metadata: {r['metadata']}\n" if r["metadata"] else ""
            show(f"{i + 1 + asked.offset}. ID: {r['id']}\n   Content: {r['content'][:100]}...\n{more}")
    else:
        show(f"Total documents in store: {store.count()}")


def _keep(store: DataFrameStore, path: str) -> None:
    """Write beside the old collection, then take its place: the new rows are read from the old ones."""
    new, old = f"{path}.new", f"{path}.old"
    store.save_parquet(new)
    if os.path.isdir(path):
        os.rename(path, old)
    os.rename(new, path)
    if os.path.isdir(old):
        for name in os.listdir(old):
            os.remove(os.path.join(old, name))
        os.rmdir(old)


if __name__ == "__main__":
    main()
