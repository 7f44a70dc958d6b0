"""A small front end over the stages: pages, status, and starting a stage in the background."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

from .runner import StageRunner


@dataclass
class FrontEnd:
    """What is served: pages by path (each makes HTML), counts for the status, and stages by name.

    A stage is called with the limit that the request gives, or None. Counts and pages are made anew for each request.
    """

    runner: StageRunner
    pages: dict[str, Callable[[], str]]
    counts: Callable[[], dict[str, int]]
    stages: dict[str, Callable[[int | None], object]] = field(default_factory=dict)

    def get(self, path: str) -> tuple[int, str, str]:
        """Status, kind and body of an answer to GET."""
        if path == "/api/status":
            state = {"running": self.runner.current, "log": self.runner.recent()}
            return 200, "application/json", json.dumps(self.counts() | state)
        if path in self.pages:
            return 200, "text/html; charset=utf-8", self.pages[path]()
        return 404, "application/json", json.dumps({"error": "not found"})

    def post(self, path: str, body: str = "") -> tuple[int, str, str]:
        """POST /api/run/<stage>, with ``limit=n`` in the form if wanted; started is false while another stage runs."""
        name = path.removeprefix("/api/run/")
        if path == name or name not in self.stages:
            return 404, "application/json", json.dumps({"error": "not found"})
        limit = parse_qs(body).get("limit", [""])[0]
        wanted = int(limit) if limit.isdigit() else None
        return 200, "application/json", json.dumps({"started": self.runner.start(name, lambda: self.stages[name](wanted))})


def server(front: FrontEnd, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """An HTTP server for ``front``; the caller runs serve_forever and shuts it down."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, kind: str, body: str) -> None:
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self._answer(*front.get(self.path.split("?")[0]))

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            self._answer(*front.post(self.path.split("?")[0], body))

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
