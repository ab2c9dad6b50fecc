"""Ingest and query texts: chunk, embed, store, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.chunkers import Chunker, FixedSizeChunker
from vectorloom.operators import search
from vectorloom.operators.embedders import Embedder
from vectorloom.operators.shared import checkpointed
from vectorloom.operators.store import DataFrameStore
from vectorloom.types import empty_metadata, put


def chunk_rows(df: DataFrame, chunker: Chunker, model: Embedder, text_col: str = "content", id_col: str | None = None) -> DataFrame:
    """Documents from texts, one per chunk: ``id``, ``content``, ``metadata``, ``embedding``, ``pos`` and the input's columns
    but the text. Ids are ``<id>#<pos>`` where the input has an id, else random.
    """
    kept = [c for c in df.columns if c not in (text_col, "content", "metadata", "embedding", "pos", "id") or c == id_col]
    rows = df.withColumn("_meta", F.col("metadata") if "metadata" in df.columns else empty_metadata())
    rows = rows.select(*[F.col(c).alias(f"_k_{c}") for c in kept], "_meta", F.posexplode(chunker.chunks(F.col(text_col))).alias("pos", "_chunk"))
    ident = F.concat(F.col(f"_k_{id_col}").cast("string"), F.lit("#"), F.col("pos").cast("string")) if id_col else F.expr("uuid()")
    extra = [F.col(f"_k_{c}").alias(c) for c in kept if c != "id"]
    return rows.select(ident.alias("id"), F.col("_chunk").alias("content"), F.col("_meta").alias("metadata"), model.column(F.col("_chunk")).alias("embedding"), "pos", *extra)


def chunk_ids(chunks: DataFrame, by: str) -> DataFrame:
    """(by, ids): each text's chunk ids, comma-joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "id")))
    return chunks.groupBy(by).agg(F.array_join(F.transform(parts, lambda p: p["id"]), ",").alias("ids"))


class Retriever:
    """A model, a store, a chunker and a default k."""

    def __init__(self, model: Embedder, store: DataFrameStore, chunker: Chunker | None = None, top_k: int = 5):
        self.embedding_model, self.vector_store = model, store
        self.chunker, self.top_k = chunker or FixedSizeChunker(), top_k

    def with_chunker(self, chunker: Chunker) -> Retriever:
        self.chunker = chunker
        return self

    def with_top_k(self, k: int) -> Retriever:
        self.top_k = k
        return self

    def add_document(self, text: str) -> str:
        """Store one text's chunks; their ids, comma-joined in order."""
        return self.add_document_with_metadata(text, [("source", "document")])

    def add_document_with_metadata(self, text: str, metadata: list[tuple[str, str]]) -> str:
        """The same with the given metadata only; of pairs that repeat a key the later wins."""
        spark = self.vector_store.spark
        found = empty_metadata()
        for k, v in metadata:
            found = put(found, k, v)
        texts = spark.createDataFrame([(text,)], "content string").withColumn("metadata", found)
        # a chunk for which the model gave no vector is left out
        rows = chunk_rows(texts, self.chunker, self.embedding_model).filter(F.col("embedding").isNotNull())
        # one text's chunks: made once, so that ids are the same in the store and in the answer
        made = spark.createDataFrame(rows.orderBy("pos").collect(), rows.schema)
        self.vector_store.add_batch(made.withColumn("seq", F.col("pos").cast("long")))
        return ",".join(r["id"] for r in made.orderBy("pos").collect())

    def add_documents(self, texts: DataFrame, text_col: str = "content", id_col: str | None = None) -> None:
        """Store the chunks of many texts at once; ``texts`` may be what a source extracts. The model is asked once for each
        chunk: what it gave is written to the shared folder before it is stored.
        """
        rows = chunk_rows(texts, self.chunker, self.embedding_model, text_col, id_col)
        made = checkpointed(rows.select("id", "content", "metadata", "embedding"))
        self.vector_store.add_batch(made.filter(F.col("embedding").isNotNull()))

    def _found(self, query: str) -> DataFrame:
        return search.with_rank(self.vector_store.search(self.embedding_model.embed_single(query), self.top_k))

    def retrieve(self, query: str) -> DataFrame:
        return self._found(query).select("rank", "content")

    def retrieve_with_scores(self, query: str) -> DataFrame:
        return self._found(query).select("rank", "content", "score")

    def retrieve_filtered(self, query: str, part: str) -> DataFrame:
        """Of the best 2 k rows, the best k with ``part`` in some metadata value."""
        vector = self.embedding_model.embed_single(query)
        store = self.vector_store
        found = search.top_k_containing(store.frame, vector, self.top_k, part, store.metric)
        return search.with_rank(found).select("rank", "content")
