import io
import json

import pytest

from vectorloom import cli
from vectorloom.errors import EmbeddingError, InvalidConfig
from vectorloom.functions.chunkers import FixedSizeChunker, ParagraphChunker
from vectorloom.operators.embedders import ByteEmbedder, Embedder, LetterEmbedder, OllamaEmbedder, OpenAIEmbedder
from vectorloom.operators.retriever import Retriever, chunk_ids, chunk_rows
from vectorloom.operators.store import DataFrameStore
from vectorloom.rpc import ToolServer
from vectorloom.streaming.ingest import chunk_stream, upsert_stream, write_stream


def test_add_and_retrieve(spark):
    r = Retriever(ByteEmbedder(), DataFrameStore(spark), FixedSizeChunker(2, 0), 2)
    made = r.add_document("one two three four five")
    rows = {d["id"]: d for d in r.vector_store.list(10).collect()}
    assert [rows[i]["content"] for i in made.split(",")] == ["one two", "three four", "five"]
    assert all(d["metadata"] == {"source": "document"} for d in rows.values())
    assert r.add_document("") == ""
    assert r.retrieve("one two").filter("rank = 1").head()["content"] == "one two"
    assert r.retrieve_with_scores("one two").columns == ["rank", "content", "score"]


def test_metadata_and_filter(spark):
    r = Retriever(ByteEmbedder(), DataFrameStore(spark), ParagraphChunker(), 5)
    r.add_document_with_metadata("special text", [("tag", "x"), ("tag", "special")])
    r.add_document("common text")
    assert [x["content"] for x in r.retrieve_filtered("special text", "special").collect()] == ["special text"]
    with pytest.raises(InvalidConfig):
        r.with_chunker(FixedSizeChunker(5, 10)).add_document("x")


def test_many_texts_and_ids(spark):
    texts = spark.createDataFrame([(7, "a b c"), (8, "")], "doc_id int, content string")
    rows = chunk_rows(texts, FixedSizeChunker(1, 0), LetterEmbedder(), id_col="doc_id")
    assert [tuple(r) for r in chunk_ids(rows, "doc_id").collect()] == [(7, "7#0,7#1,7#2")]
    r = Retriever(LetterEmbedder(), DataFrameStore(spark))
    r.add_documents(texts, id_col="doc_id")
    assert [d["id"] for d in r.vector_store.list(5).collect()] == ["7#0"]


class CountingEmbedder(LetterEmbedder):
    """Counts in a file of this machine how many texts it was asked for, over all workers."""

    def __init__(self, path):
        self.path = path

    def embed(self, texts):
        with open(self.path, "a") as out:
            out.write("x" * len(texts))
        return super().embed(texts)

    def column(self, text):
        return Embedder.column(self, text)


def test_chunks_are_embedded_once(spark, tmp_path):
    path = tmp_path / "asked"
    r = Retriever(CountingEmbedder(str(path)), DataFrameStore(spark), FixedSizeChunker(1, 0), 2)
    r.add_documents(spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id int, content string"), id_col="doc_id")
    for _ in range(3):
        r.retrieve("a").collect()
        r.vector_store.count()
    assert len(path.read_text()) == 5 + 3  # one for each chunk, one for each question


def test_remote_models_map_requests_and_replies():
    asked = []

    def post(url, headers, body):
        asked.append((url, headers, body))
        if "bad" in str(body):
            return 500, "broken"
        return 200, json.dumps({"data": [{"embedding": [1.0]}, {"embedding": [2.0]}], "embedding": [3.0]})

    assert OpenAIEmbedder("key", post=post).embed(["a", "b"]) == [[1.0], [2.0]]
    assert asked[0] == ("https://api.openai.com/v1/embeddings", {"Authorization": "Bearer key"}, {"input": ["a", "b"], "model": "text-embedding-ada-002"})
    assert OllamaEmbedder("m", post=post).embed(["a", "b"]) == [[3.0], [3.0]]
    assert [a[2] for a in asked[1:]] == [{"model": "m", "prompt": "a"}, {"model": "m", "prompt": "b"}]
    with pytest.raises(EmbeddingError, match="broken"):
        OllamaEmbedder("m", post=post).embed_single("bad")


def test_letter_column_equals_model(spark):
    texts = ["Hello, World", "", "ZzZ"]
    got = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in got.select(LetterEmbedder().column(got["t"])).collect()] == LetterEmbedder().embed(texts)


def test_rpc_session(spark):
    server = ToolServer(LetterEmbedder(), DataFrameStore(spark), prefix="x_")
    say = lambda method, params=None: server.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    call = lambda name, args=None: say("tools/call", {"name": name, "arguments": args})
    assert say("ping")["result"] == {"status": "ok"} and say("ping")["error"] is None
    assert say("initialize")["result"]["protocolVersion"] == "2024-11-05"
    assert [t["name"] for t in say("tools/list")["result"]["tools"]] == ["x_add_document", "x_query", "x_list_documents", "x_count"]
    assert say("nope")["error"] == {"code": -32601, "message": "Method not found: nope"}
    assert say("tools/call")["error"] == {"code": -32602, "message": "Missing params"}
    assert call("x_nope")["error"] == {"code": -32601, "message": "Unknown tool: x_nope"}
    assert call("x_query")["error"]["message"] == "Missing arguments"
    assert call("x_add_document", {})["error"]["message"] == "Missing content"
    added = call("x_add_document", {"content": "aaa\n\nbbb"})["result"]
    assert added["success"] and len(added["chunk_ids"].split(",")) == 2
    assert call("x_query", {"query": "a", "top_k": 1})["result"]["results"] == [{"rank": 1, "content": "aaa", "score": 1.0}]
    assert len(call("x_query", {"query": "a", "top_k": -1.5})["result"]["results"]) == 2
    listed = call("x_list_documents")["result"]["documents"]
    assert [(d["content"], d["metadata"]) for d in listed] == [("aaa...", {"source": "unknown"}), ("bbb...", {"source": "unknown"})]
    assert call("x_count")["result"] == {"total_documents": 2}


def test_serve_skips_blank_and_broken_lines(spark):
    out, log = io.StringIO(), io.StringIO()
    lines = io.StringIO('\n{"broken\n{"jsonrpc": "2.0", "id": 3, "method": "ping"}\n')
    ToolServer(LetterEmbedder(), DataFrameStore(spark)).serve(lines, out, log)
    assert [json.loads(x)["id"] for x in out.getvalue().splitlines()] == [3] and "Failed to parse" in log.getvalue()


def test_command_line(spark, tmp_path):
    (tmp_path / "t.txt").write_text("first part\n\nsecond part")
    kept, shown = str(tmp_path / "store"), []
    run = lambda *a: (shown.clear(), cli.main([*a], spark, LetterEmbedder(), shown.append), "\n".join(shown))[2]
    run("--store", kept, "add", "--file", str(tmp_path / "t.txt"))
    assert "Total documents in store: 2" in run("--store", kept, "count")
    run("--store", kept, "add", "--file", str(tmp_path / "t.txt"), "--source", "again")
    assert "total: 4" in run("--store", kept, "list", "--limit", "1", "--offset", "1")
    assert "1. Score: 1.0000\n   first part" in run("--store", kept, "query", "--query", "first part")
    assert "Total documents in store: 0" in run("count") and "No results found." in run("query", "--query", "x")


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", "x y"), ("b", "z")], "id string, content string").write.json(str(tmp_path / "in"))
    stream = lambda: chunk_stream(spark.readStream.schema("id string, content string").json(str(tmp_path / "in")), FixedSizeChunker(1, 0), LetterEmbedder())
    write_stream(stream(), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a#0", "a#1", "b#0"]
    store = DataFrameStore(spark)
    upsert_stream(stream(), store, str(tmp_path / "c2")).awaitTermination()
    assert store.count() == 3
