"""The engine's tools as JSON calls, over HTTP, and from a command line.

``Service.call`` is the one way in: a method and its parameters give a result
or an error with a code. Results are rows as JSON values, at most ``limit`` of
them, which is the call's own parameter.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Mapping
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame

from .engine import Engine
from .plans.parser import CypherError, WriteQueryError

# Codes of errors, their HTTP status, and routes.
INTERNAL, UNKNOWN_METHOD, INVALID, NO_REPOSITORY, BLOCKED, INCOMPATIBLE = -32603, -32601, -32602, -32001, -32002, -32003
STATUS = {INTERNAL: 500, UNKNOWN_METHOD: 404, INVALID: 400, NO_REPOSITORY: 404, BLOCKED: 403, INCOMPATIBLE: 409}
ROUTE = "/api/"
#: Tools with their parameters: name, type, whether it must be there.
TOOLS: dict[str, dict[str, tuple[str, bool]]] = {
    "query": {"query": ("string", True), "limit": ("integer", False), "tests": ("boolean", False)},
    "context": {"name": ("string", True), "file": ("string", False), "tests": ("boolean", False)},
    "impact": {"name": ("string", True), "direction": ("string", False), "depth": ("integer", False), "file": ("string", False), "tests": ("boolean", False)},
    "cypher": {"query": ("string", True), "limit": ("integer", False)},
    "cat": {"files": ("array", True), "lines": ("string", False)},
    "schema": {},
    "status": {},
}
TYPES = {"string": str, "integer": int, "boolean": bool, "array": list}


class ServiceError(Exception):
    """An error of a call, with its code."""

    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def rows(df: DataFrame, limit: int | None = None) -> list[dict]:
    found = df.limit(limit) if limit is not None else df
    return [r.asDict(recursive=True) for r in found.collect()]


def tools() -> list[dict]:
    """The tools as JSON schemas, for clients that list them."""
    return [{"name": n, "inputSchema": {"type": "object", "properties": {"repo": {"type": "string"}, **{k: {"type": t} for k, (t, _) in p.items()}}, "required": [k for k, (_, must) in p.items() if must]}} for n, p in TOOLS.items()]


class Service:
    """Tools over the engines of several repositories, by name."""

    def __init__(self, engines: Mapping[str, Engine]) -> None:
        self.engines = dict(engines)

    def engine(self, repo: str | None) -> Engine:
        if repo is None and len(self.engines) == 1:
            return next(iter(self.engines.values()))
        if repo not in self.engines:
            raise ServiceError(NO_REPOSITORY, f"repository {repo!r} not indexed")
        return self.engines[repo]

    def call(self, method: str, params: Mapping | None = None) -> dict:
        """``{"result": ...}`` or ``{"error": {"code", "message"}}``."""
        try:
            return {"result": self._call(method, dict(params or {}))}
        except ServiceError as e:
            return {"error": {"code": e.code, "message": str(e)}}
        except WriteQueryError as e:
            return {"error": {"code": BLOCKED, "message": str(e)}}
        except (CypherError, ValueError, KeyError) as e:
            return {"error": {"code": INVALID, "message": str(e)}}
        except Exception as e:  # whatever fails inside is the caller's answer, too
            return {"error": {"code": INTERNAL, "message": str(e)}}

    def _call(self, method: str, params: dict):
        if method not in TOOLS:
            raise ServiceError(UNKNOWN_METHOD, f"unknown method {method!r}")
        repo = params.pop("repo", None)
        for name, (kind, must) in TOOLS[method].items():
            if must and not params.get(name):
                raise ServiceError(INVALID, f"{name} is required")
            if name in params and not isinstance(params[name], TYPES[kind]):
                raise ServiceError(INVALID, f"{name} isn't a {kind}")
        engine = self.engine(repo) if method != "status" else None
        if method == "query":
            return {k: rows(v) for k, v in engine.query(params["query"], params.get("limit", 10), tests=params.get("tests", False)).items()}
        if method == "context":
            return rows(engine.context(params["name"], params.get("file"), params.get("tests", False)))
        if method == "impact":
            return rows(engine.impact(params["name"], params.get("direction", "downstream"), params.get("depth", 5), params.get("file"), params.get("tests", False)).select("id", "name", "label", "filePath", "depth"))
        if method == "cypher":
            return rows(engine.cypher(params["query"]), params.get("limit"))
        if method == "cat":
            return rows(engine.cat(params["files"], params.get("lines")))
        if method == "schema":
            return {k: rows(v) for k, v in engine.schema().items()}
        return {"repositories": sorted(self.engines)}


def server(service: Service, host: str = "127.0.0.1", port: int = 0) -> HTTPServer:
    """An HTTP server: POST /api/<method> with parameters as JSON."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                answer = service.call(self.path.removeprefix(ROUTE), body) if self.path.startswith(ROUTE) and isinstance(body, dict) else {"error": {"code": INVALID, "message": "not a call"}}
            except json.JSONDecodeError as e:
                answer = {"error": {"code": INVALID, "message": str(e)}}
            data = json.dumps(answer, default=str).encode()
            self.send_response(STATUS[answer["error"]["code"]] if "error" in answer else 200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return HTTPServer((host, port), Handler)


def main(argv: list[str] | None = None) -> int:
    """``analyze FOLDER OUT``, or a tool over a saved graph with its parameters as JSON."""
    from pyspark.sql import SparkSession

    from .operators import build
    from .operators.graph import PropertyGraph
    from .sources.memory import FolderSource

    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("command", choices=["analyze", "serve", *TOOLS])
    p.add_argument("graph", help="folder of source files (analyze) or of a saved graph")
    p.add_argument("rest", nargs="?", default="{}", help="where to save (analyze), a port (serve), or parameters as JSON")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "analyze":
        build.from_files(FolderSource(a.graph).files(spark)).save(a.rest)
        return 0
    service = Service({"graph": Engine(PropertyGraph.load(spark, a.graph))})
    if a.command == "serve":
        server(service, port=int(a.rest if a.rest != "{}" else 0)).serve_forever()
    answer = service.call(a.command, json.loads(a.rest))
    print(json.dumps(answer, default=str))
    return 1 if "error" in answer else 0


if __name__ == "__main__":
    raise SystemExit(main())
