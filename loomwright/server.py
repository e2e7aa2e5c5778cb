"""A thin HTTP front: /, /health, /stats, POST /query and POST /refresh, as JSON over the command line's functions."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomwright import cli
from loomwright.functions import text as T
from loomwright.operators import deltas, rag


class Service:
    """What the endpoints do; each call has its own settings, so calls do not disturb one another."""

    def __init__(self, spark: SparkSession, path: str, docs: str | None = None, collection: str = "docs"):
        self.spark, self.path, self.docs, self.collection = spark, path, docs, collection
        self._busy = threading.Lock()

    def health(self) -> dict:
        return {"status": "healthy", "collection": self.collection}

    def stats(self) -> dict:
        return deltas.DeltaCollection(self.spark, self.path, self.collection).stats()

    def query(self, body: dict) -> tuple[int, dict]:
        question, top_k = body.get("question"), body.get("top_k", 5)
        if not isinstance(question, str) or not question or not isinstance(top_k, int) or not 1 <= top_k <= rag.MOST_REST:
            return 422, {"answer": "", "sources": [], "error": f"ValueError: question has to be filled and top_k from 1 to {rag.MOST_REST}"}
        try:
            hits, reply = cli.ask(self.spark, self.path, question, top_k, body.get("domain"), self.collection)
            cut = hits.withColumn("content", T.truncate(F.col("content"), 200)).orderBy("rank")
            rows = [{"title": r.title, "url": r.url, "heading": r.heading, "score": r.score, "content": r.content} for r in cut.collect()]
            return 200, {"answer": reply.first().answer, "sources": rows, "error": None}
        except ValueError as e:
            return 400, {"answer": "", "sources": [], "error": f"{type(e).__name__}: {e}"}

    def refresh(self) -> tuple[int, dict]:
        """Bring the index to the folder of documents; a second call meanwhile is refused, and readers keep the old version."""
        if not self.docs:
            return 400, {"status": "error", "message": "no folder of documents"}
        if not self._busy.acquire(blocking=False):
            return 409, {"status": "in_progress"}
        try:
            return 200, {"status": "done", **cli.build(self.spark, self.docs, self.path, collection=self.collection)}
        finally:
            self._busy.release()


def serve(service: Service, port: int = 8000) -> ThreadingHTTPServer:
    """A server that is bound but not started; call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: dict) -> None:
            raw = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            ways = {"/": lambda: {"name": "loomwright", "endpoints": ["/health", "/stats", "/query", "/refresh"]}, "/health": service.health, "/stats": service.stats}
            way = ways.get(self.path)
            self._send(*((200, way()) if way else (404, {"error": "not found"})))

        def do_POST(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                body = json.loads(raw or b"{}")
            except ValueError:
                return self._send(400, {"error": "not JSON"})
            if self.path == "/query":
                return self._send(*service.query(body))
            if self.path == "/refresh":
                return self._send(*service.refresh())
            return self._send(404, {"error": "not found"})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
