"""Boosts, multi-field search and the query tool."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import ranking
from graphloom.operators.graph import PropertyGraph


def test_intents_and_words():
    assert ranking.intent("authenticate a session") == "sign-in" and ranking.intent("authenticate") is None
    assert ranking.intent("DispatcherServlet") == "dispatch" and ranking.intent("container refresh") == "lifecycle"
    assert ranking.expand("x") == "x" and ranking.expand("login request").startswith("login request authentication")
    assert ranking.query_words("show handleRequest in the server") == ["handle", "request", "server"]


def test_paths(spark):
    paths = {"a/tests/x.go": True, "conftest.py": True, "a/x_test.go": True, "web/app.spec.ts": True, "test_x.py": True, "src/testimony.go": False, "attest/x.go": False, None: False}
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", text.is_test_path(F.col("p")).alias("t"), text.is_command_path(F.col("p")).alias("c"))
    assert {r["p"]: r["t"] for r in df.collect()} == paths


def test_query_finds_definitions_and_their_flows(spark):
    rows = [("m", "Function", "main", "main.go", None), ("h", "Function", "handleRequest", "server.go", "reads the request"), ("v", "Function", "validate", "auth.go", None), ("t", "Function", "handleRequest", "tests/server_test.go", None), ("p", "Process", "handleRequest-flow", None, None)]
    nodes = spark.createDataFrame(rows, "id string, label string, name string, filePath string, description string").withColumns({"stepCount": F.when(F.col("label") == "Process", 3), "entryPoint": F.when(F.col("label") == "Process", "h")})
    edges = [("m", "h", "CALLS", None), ("h", "v", "CALLS", None), *((s, "p", "STEP_IN_PROCESS", i + 1) for i, s in enumerate("hvm"))]
    g = PropertyGraph.of(nodes, spark.createDataFrame([(str(i), *e) for i, e in enumerate(edges)], "edge_id string, src string, dst string, type string, step int"))
    out = ranking.query(g, "handle request server")
    assert [r["id"] for r in out["definitions"].collect()] == ["h"]
    assert [(r["id"], r["matched"]) for r in out["processes"].collect()] == [("p", 1)] and out["test_flows"].isEmpty()
    assert {r["id"] for r in out["symbols"].collect()} == {"m", "v"}
    assert ranking.definitions(g, "", 5).isEmpty()
