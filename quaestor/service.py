"""Answering questions over HTTP with the standard library, and the same as a callable."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from quaestor.operators.embed import Embedder, HashEmbedder
from quaestor.operators.prompt import Answerer, ExtractiveAnswerer, PromptTemplate
from quaestor.plans.pipeline import answer
from quaestor.plans.ship import ship


class EmptyQuery(ValueError):
    """A question that is missing or empty."""


class Chat:
    """One question at a time over an index: ``chat("...")`` gives ``{"answer": ..., "sources": [...]}``.

    Sources stand in rank order and are repeated where several hits have the same.  An empty question is
    an ``EmptyQuery``; one of nothing but white space is a question.
    """

    def __init__(
        self,
        spark: SparkSession,
        index: str,
        no_hit: str = "Nothing was found.",
        apology: str = "No answer could be made.",
        top_k: int = 5,
        embedder: Callable[[], Embedder] = HashEmbedder,
        answerer: Callable[[], Answerer] = ExtractiveAnswerer,
        template: PromptTemplate = PromptTemplate(),
    ) -> None:
        ship(spark)
        self.spark, self.index, self.no_hit, self.apology, self.top_k = spark, index, no_hit, apology, top_k
        self.embedder, self.answerer, self.template = embedder, answerer, template

    def __call__(self, query: str | None, field_of_study: str | None = None, semester: str | None = None) -> dict:
        if not query:
            raise EmptyQuery("the query is empty")
        asked = self.spark.createDataFrame([(1, query, field_of_study, semester)], "query_id long, query string, field_of_study string, semester string")
        row = answer(self.spark, asked, self.index, self.no_hit, self.apology, self.top_k, self.embedder, self.answerer, self.template).first()
        return {"answer": row["answer"], "sources": list(row["sources"] or [])}


def handler(chat: Callable[[str], dict]) -> type[BaseHTTPRequestHandler]:
    """``POST /chat`` with ``{"query": ...}``: 200 with the answer, 400 for an empty query, 422 for what is no such object, 404 elsewhere."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            if self.path.rstrip("/") != "/chat":
                return self._send(404, {"detail": "not found"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                query = body["query"]
                if not isinstance(query, str):
                    raise TypeError
            except (ValueError, KeyError, TypeError):
                return self._send(422, {"detail": "an object with a query is expected"})
            try:
                self._send(200, chat(query))
            except EmptyQuery as e:
                self._send(400, {"detail": str(e)})

        def _send(self, status: int, content: dict) -> None:
            data = json.dumps(content, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def serve(chat: Callable[[str], dict], host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server for ``chat``; its ``serve_forever`` runs it."""
    return ThreadingHTTPServer((host, port), handler(chat))
