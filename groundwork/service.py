"""One question at a time: a Python call and an HTTP service on the standard library."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame

from .plans import answering
from .settings import Settings

SNIPPET = 240


class Invalid(ValueError):
    """A request that doesn't have the right shape."""


class Service:
    """Answers against a held index, with the seconds of each stage."""

    def __init__(self, index: dict[str, DataFrame], how: Settings, version: str = "0.1.0"):
        self.index, self.how, self.version = index, how, version
        self.chunks = index["chunks"].count()

    def health(self) -> dict[str, Any]:
        return {"status": "ok", "config": self.how.name, "num_chunks": self.chunks, "version": self.version}

    def query(self, body: Any) -> dict[str, Any]:
        if not isinstance(body, dict) or not isinstance(body.get("query"), str) or not body["query"]:
            raise Invalid("query must be a text that isn't empty")
        top_k = body.get("top_k")
        if top_k is not None and (isinstance(top_k, bool) or not isinstance(top_k, int) or top_k <= 0):
            raise Invalid("top_k must be a positive whole number")
        spark, how = self.index["chunks"].sparkSession, self.how
        asked = spark.createDataFrame([("q", body["query"])], "question_id string, question string")
        said, took = answering.one(asked, self.index, how, top_k)
        return {
            "query": body["query"],
            "answer": said["answer"],
            "citations": list(said["citations"]),
            "abstained": said["abstained"],
            "contexts": [
                {"chunk_id": c["chunk_id"], "doc_id": c["doc_id"], "title": c["title"] or "", "score": round(c["score"], 6), "snippet": c["text"][:SNIPPET]} for c in said["contexts"]
            ],
            "latencies": took,
            "usage": {k: said[k] for k in ("prompt_tokens", "completion_tokens", "cost_usd")},
        }


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: Any) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._send(200, service.health()) if self.path == "/health" else self._send(404, {"detail": "not found"})

        def do_POST(self) -> None:
            if self.path != "/query":
                return self._send(404, {"detail": "not found"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"null")
                self._send(200, service.query(body))
            except (Invalid, json.JSONDecodeError) as wrong:
                self._send(422, {"detail": str(wrong)})

        def log_message(self, *_: Any) -> None:
            pass

    return Handler


def serve(service: Service, host: str, port: int) -> None:
    ThreadingHTTPServer((host, port), handler(service)).serve_forever()
