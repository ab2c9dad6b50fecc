"""A JSON-RPC tool server over a retriever, one request and one answer per line."""

from __future__ import annotations

import json
import os
import sys
from typing import Any, TextIO

from vectorloom.errors import LoomError
from vectorloom.functions.chunkers import ParagraphChunker
from vectorloom.functions.metadata import preview
from vectorloom.operators import search
from vectorloom.operators.embedders import Embedder, OllamaEmbedder, OpenAIEmbedder
from vectorloom.operators.retriever import Retriever
from vectorloom.operators.store import DataFrameStore

NO_METHOD, BAD_PARAMS, INTERNAL = -32601, -32602, -32603


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code, self.message = code, message


def _text(args: dict | None, name: str) -> str:
    if args is None:
        raise RpcError(BAD_PARAMS, "Missing arguments")
    if not isinstance(args, dict) or not isinstance(args.get(name), str):
        raise RpcError(BAD_PARAMS, f"Missing {name}")
    return args[name]


def _count(args: Any, name: str, default: int) -> int:
    """A whole number that is not negative, else the default."""
    value = args.get(name) if isinstance(args, dict) else None
    return value if type(value) is int and value >= 0 else default


_STRING, _NUMBER = "string", "number"
_TOOLS = {
    "add_document": ("Store a document", {"content": (_STRING, "Text of the document"), "source": (_STRING, "Where it is from")}, ["content"]),
    "query": ("Find the stored chunks nearest to a text", {"query": (_STRING, "Text to search for"), "top_k": (_NUMBER, "How many results (5)")}, ["query"]),
    "list_documents": ("List stored chunks", {"limit": (_NUMBER, "How many (10)"), "offset": (_NUMBER, "How many to skip (0)")}, None),
    "count": ("Count stored chunks", {}, None),
}


class ToolServer:
    """Answers requests. ``prefix`` is put before the tools' names."""

    def __init__(self, model: Embedder, store: DataFrameStore, prefix: str = "", name: str = "vectorloom", version: str = "0.1.0"):
        self.retriever = Retriever(model, store, ParagraphChunker(), 5)
        self.prefix, self.info = prefix, {"name": name, "version": version}

    def handle(self, request: dict) -> dict:
        answer = {"jsonrpc": "2.0", "id": request.get("id"), "result": None, "error": None}
        try:
            answer["result"] = self._dispatch(request.get("method"), request.get("params"))
        except RpcError as e:
            answer["error"] = {"code": e.code, "message": e.message}
        except LoomError as e:
            answer["error"] = {"code": INTERNAL, "message": str(e)}
        return answer

    def _dispatch(self, method: Any, params: Any) -> Any:
        if method == "ping":
            return {"status": "ok"}
        if method == "initialize":
            return {"protocolVersion": "2024-11-05", "serverInfo": self.info, "capabilities": {"tools": {"listChanged": False}}}
        if method == "tools/list":
            return {"tools": [self._describe(name, *spec) for name, spec in _TOOLS.items()]}
        if method == "tools/call":
            return self._call(params)
        raise RpcError(NO_METHOD, f"Method not found: {method}")

    def _describe(self, name: str, what: str, fields: dict, required: list[str] | None) -> dict:
        schema = {"type": "object", "properties": {k: {"type": t, "description": d} for k, (t, d) in fields.items()}}
        return {"name": self.prefix + name, "description": what, "inputSchema": schema | ({"required": required} if required else {})}

    def _call(self, params: Any) -> dict:
        if params is None:
            raise RpcError(BAD_PARAMS, "Missing params")
        name = params.get("name") if isinstance(params, dict) else None
        if not isinstance(name, str):
            raise RpcError(BAD_PARAMS, "Missing tool name")
        tool = name.removeprefix(self.prefix) if name.startswith(self.prefix) else ""
        if tool not in _TOOLS:
            raise RpcError(NO_METHOD, f"Unknown tool: {name}")
        return getattr(self, f"_{tool}")(params.get("arguments"))

    def _add_document(self, args: Any) -> dict:
        content = _text(args, "content")
        source = args["source"] if isinstance(args.get("source"), str) else "unknown"
        try:
            ids = self.retriever.add_document_with_metadata(content, [("source", source)])
        except LoomError as e:
            raise RpcError(INTERNAL, f"Failed to add document: {e}") from e
        return {"success": True, "message": "Document added successfully", "chunk_ids": ids}

    def _query(self, args: Any) -> dict:
        text = _text(args, "query")
        try:
            vector = self.retriever.embedding_model.embed_single(text)
        except LoomError as e:
            raise RpcError(INTERNAL, f"Embedding generation failed: {e}") from e
        found = search.with_rank(self.retriever.vector_store.search(vector, _count(args, "top_k", 5))).orderBy("rank").collect()
        return {"query": text, "results": [{"rank": r["rank"], "content": r["content"], "score": r["score"]} for r in found]}

    def _list_documents(self, args: Any) -> dict:
        page = self.retriever.vector_store.list(_count(args, "limit", 10), _count(args, "offset", 0))
        return {"documents": [r.asDict() for r in page.select("id", preview(page["content"]).alias("content"), "metadata").collect()]}

    def _count(self, args: Any) -> dict:
        return {"total_documents": self.retriever.vector_store.count()}

    def serve(self, lines: TextIO = sys.stdin, out: TextIO = sys.stdout, log: TextIO = sys.stderr) -> None:
        """Answer line by line; blank lines are passed over, and so, with a note to the log, are lines that are no request."""
        for line in lines:
            if not line.strip():
                continue
            try:
                request = json.loads(line)
                if not isinstance(request, dict) or not isinstance(request.get("method"), str):
                    raise ValueError("not a request")
            except ValueError as e:
                print(f"Failed to parse request: {e}", file=log)
                continue
            print(json.dumps(self.handle(request), ensure_ascii=False), file=out, flush=True)


def default_model(ollama_url: str | None = None) -> Embedder:
    """The remote model if OPENAI_API_KEY is set, else the local one."""
    if key := os.environ.get("OPENAI_API_KEY"):
        return OpenAIEmbedder(key)
    return OllamaEmbedder("nomic-embed-text", ollama_url or "http://localhost:11434")
