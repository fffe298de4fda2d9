"""HTTP surface: GET /health, POST /index, /query and /ask with JSON bodies.  Standard library only."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from .functions.predicates import MetadataFilters
from .operators.prompt import matches_json
from .plans import ask as asking
from .plans import index as indexing
from .settings import Settings, load_settings
from .sources.repository import index_name


def respond(spark: SparkSession, settings: Settings, method: str, path: str, body: dict) -> tuple[int, dict]:
    """Status and payload of one request."""
    if (method, path) == ("GET", "/health"):
        return 200, {"status": "ok"}
    if method != "POST" or path not in ("/index", "/query", "/ask"):
        return 404, {"detail": "not found"}
    needed = {"/index": ("repo",), "/query": ("question",), "/ask": ("repo", "question")}[path]
    if lacking := [k for k in needed if not isinstance(body.get(k), str) or not body[k]]:
        return 422, {"detail": f"missing: {', '.join(lacking)}"}
    store = body.get("store", "cosine")
    name = body.get("index_name") or (index_name(body["repo"]) if body.get("repo") else "repository")
    f = MetadataFilters(body.get("language"), body.get("chunk_type"), body.get("path"))
    options = {"k": int(body.get("top_k", 5)), "filters": f if f.active else None}
    if path == "/index":
        return 200, {"index_name": name, "chunks": indexing.index_repository(spark, body["repo"], store, settings, name)}
    if path == "/ask":
        return 200, {"prompt": asking.ask(spark, body["repo"], body["question"], store, settings, name, **options)}
    rows = [r.asDict() for r in asking.query(spark, body["question"], name, store, settings, **options).orderBy("rank").collect()]
    return 200, {"matches": json.loads(matches_json(rows))}


def serve(spark: SparkSession, host: str = "127.0.0.1", port: int = 8000, settings: Settings | None = None) -> ThreadingHTTPServer:
    """A server that is ready for serve_forever()."""
    s = settings or load_settings()

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                status, payload = respond(spark, s, self.command, self.path, body)
            except ValueError as error:
                status, payload = 400, {"detail": str(error)}
            data = json.dumps(payload).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _do  # noqa: N815

    return ThreadingHTTPServer((host, port), Handler)
