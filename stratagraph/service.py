"""REST over the engine (I3-I7): JSON in and out, lists in pages, 404 for what is unknown, 409 for what is not ready, 400 for bad requests."""

from __future__ import annotations

import json
import os
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.plans.engine import Engine
from stratagraph.sources.store import NotFound, NotReady

#: Rows of a page.
PAGE = 1_000


def _rows(df: DataFrame) -> list[dict]:
    """All rows of a list that its operator bounds."""
    return [r.asDict(recursive=True) for r in df.collect()]


def page(df: DataFrame, keys: list[str], after: str | None = None, size: int = PAGE) -> dict:
    """The `size` rows that follow the mark `after`, by keys that tell every row, and the mark to go on with, null at the end.

    A mark is the last row's keys as JSON, so a page costs the same wherever it is, and rows that come or go do not shift it.
    """
    kinds = dict(df.dtypes)
    key = [F.coalesce(F.col(k), F.lit("" if kinds[k] == "string" else 0).cast(kinds[k])) for k in keys]
    if after is not None:
        given = json.loads(after)
        if not isinstance(given, list) or len(given) != len(keys):
            raise ValueError("after: not a mark of this list")
        df = df.where(F.struct(*key) > F.struct(*[F.lit(v).cast(kinds[k]) for k, v in zip(keys, given)]))
    mark = F.to_json(F.array(*[k.cast("string") for k in key]))
    found = df.withColumn("__mark", mark).orderBy(*key).limit(size + 1).collect()
    rows = [{k: v for k, v in r.asDict(recursive=True).items() if not k.startswith("__")} for r in found[:size]]
    return {"rows": rows, "next": found[size - 1]["__mark"] if len(found) > size else None}


class Service:
    """Routes; `answer` is the whole of a request but for the socket."""

    def __init__(self, engine: Engine, workspace: str, background: bool = True, folders: str | None = None, size: int = PAGE):
        """folders: a folder of the server under which clients may name folders to index; none by default."""
        self.engine, self.workspace, self.background, self.folders, self.size = engine, workspace, background, folders, size
        e = engine
        one = lambda r: r"/repositories/(?P<rid>[0-9a-f]+)" + r
        self.routes = [
            ("GET", r"/health", lambda a, b: (200, e.health())),
            ("GET", r"/config", lambda a, b: (200, e.config())),
            ("POST", r"/repositories", self._register),
            ("GET", r"/repositories", lambda a, b: self._page(e.store.repositories().withColumn("__newest", -F.col("created")), a, "__newest", "repository_id")),
            ("GET", one(""), lambda a, b: (200, self._known(a["rid"]))),
            ("GET", one("/status"), lambda a, b: (200, {k: self._known(a["rid"])[k] for k in ("status", "error")})),
            ("GET", one("/overview"), lambda a, b: (200, {"overview": e.overview(a["rid"])})),
            ("DELETE", one(""), self._delete),
            ("POST", one("/query"), self._query),
            ("GET", one("/files"), lambda a, b: self._page(e.files(a["rid"]), a, "file_path")),
            ("GET", one("/file"), lambda a, b: self._first(e.file(a["rid"], a["path"]))),
            ("GET", one("/graph"), lambda a, b: (200, {"files": page(e.graph_overview(a["rid"]), ["file_path"], a.get("after"), self.size), "statistics": _rows(e.statistics(a["rid"]))})),
            ("GET", one("/graph/network"), self._network),
            ("GET", one("/graph/file"), lambda a, b: self._first(e.file_contents(a["rid"], a["path"]))),
            ("GET", one("/graph/class"), lambda a, b: self._page(e.class_info(a["rid"], a["name"]), a, "file_path", "start_line", "node_id")),
            ("GET", one("/graph/callers"), lambda a, b: self._page(e.callers(a["rid"], a["name"]), a, "file_path", "start_line", "node_id")),
            ("GET", one("/graph/callees"), lambda a, b: self._page(e.callees(a["rid"], a["name"]), a, "file_path", "start_line", "node_id")),
            ("GET", one("/graph/importers"), lambda a, b: self._page(e.importers(a["rid"], a["path"]), a, "file_path", "module", "line")),
            ("GET", one("/graph/imports"), lambda a, b: self._page(e.imports(a["rid"], a["path"]), a, "file_path", "module", "line")),
            ("GET", one("/graph/path"), lambda a, b: self._first(e.path(a["rid"], a["source"], a["target"]))),
        ]

    def _known(self, repository_id: str) -> dict:
        row = self.engine.store.get(repository_id)
        if row is None:
            raise NotFound(repository_id)
        return row

    def _page(self, df: DataFrame, a: dict, *keys: str) -> tuple[int, object]:
        return 200, page(df, list(keys), a.get("after"), self.size)

    def _folder(self, name: str) -> str:
        """A folder that a client names, links resolved; refused unless it lies under the folder that the server allows."""
        allowed = os.path.realpath(self.folders) if self.folders else None
        path = os.path.realpath(name)
        if allowed is None or os.path.commonpath([allowed, path]) != allowed:
            raise ValueError("folder: this server does not index it")
        return path

    @staticmethod
    def _first(df: DataFrame) -> tuple[int, object]:
        rows = df.limit(1).collect()
        return (200, rows[0].asDict(recursive=True)) if rows else (404, {"error": "not found"})

    def _register(self, a: dict, body: dict) -> tuple[int, object]:
        folder = self._folder(body["folder"]) if body.get("folder") else None
        repository_id = self.engine.register(body["url"])

        def work() -> None:
            self.engine.index(repository_id, folder or self.engine.fetch(repository_id, self.workspace))

        if self.background:
            threading.Thread(target=work, daemon=True).start()
        else:
            work()
        return 202, self._known(repository_id)

    def _delete(self, a: dict, body: dict) -> tuple[int, object]:
        self._known(a["rid"])
        self.engine.delete(a["rid"])
        return 204, None

    def _query(self, a: dict, body: dict) -> tuple[int, object]:
        mode = body.get("mode", "hybrid")
        if mode not in ("hybrid", "vector"):
            raise ValueError(f"mode: hybrid or vector, not {mode!r}")
        return self._first(self.engine.ask(a["rid"], [body["question"]], mode, generate=body.get("generate", True)))

    def _network(self, a: dict, body: dict) -> tuple[int, object]:
        nodes, edges = self.engine.network(a["rid"], a.get("focus"), int(a.get("depth", 1)))
        return 200, {"nodes": _rows(nodes), "edges": _rows(edges)}

    def answer(self, method: str, target: str, body: bytes = b"") -> tuple[int, object]:
        url = urlsplit(target)
        for verb, pattern, run in self.routes:
            m = re.fullmatch(pattern, url.path.rstrip("/"))
            if verb == method and m:
                try:
                    given = json.loads(body or b"{}")
                    return run({k: v[0] for k, v in parse_qs(url.query).items()} | m.groupdict(), given if isinstance(given, dict) else {})
                except NotFound as e:
                    return 404, {"error": f"unknown: {e.args[0]}"}
                except NotReady as e:
                    return 409, {"error": str(e)}
                except KeyError as e:
                    return 400, {"error": f"missing: {e.args[0]}"}
                except ValueError as e:
                    return 400, {"error": str(e)}
        return 404, {"error": "no such route"}

    def server(self, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _do(self) -> None:
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                code, found = service.answer(self.command, self.path, body)
                raw = b"" if found is None else json.dumps(found, default=str).encode()
                self.send_response(code)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            do_GET = do_POST = do_DELETE = _do

            def log_message(self, *_: object) -> None:
                pass

        return ThreadingHTTPServer((host, port), Handler)
