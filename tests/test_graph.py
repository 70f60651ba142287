"""Graph, query language, traversal and search on small hand-made graphs."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest

from graphloom.operators import search, traverse
from graphloom.operators.graph import PropertyGraph, federate
from graphloom.plans.cypher import cypher
from graphloom.plans.parser import CypherError, WriteQueryError, is_write_query


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [
        ("func:main", "Function", "main", "main.go", False, 3.0), ("func:handle", "Function", "handleRequest", "server.go", True, 1.0), ("func:validate", "Function", "validate", "auth.go", True, 2.0),
        ("func:helper", "Function", "helper", "utils.go", False, None), ("file:main.go", "File", "main.go", "main.go", None, None), ("file:server.go", "File", "server.go", "server.go", None, None), ("process:main-flow", "Process", "main-flow", None, None, None),
    ]
    edges = [("func:main", "func:handle", "CALLS", None), ("func:handle", "func:validate", "CALLS", None), ("file:server.go", "file:main.go", "IMPORTS", None)] + [(s, "process:main-flow", "STEP_IN_PROCESS", k + 1) for k, s in enumerate(["func:main", "func:handle", "func:validate"])]
    n = spark.createDataFrame(nodes, "id string, label string, name string, filePath string, isExported boolean, importance double")
    e = spark.createDataFrame([(f"e{i}", *x) for i, x in enumerate(edges)], "edge_id string, src string, dst string, type string, step int")
    return PropertyGraph.of(n, e)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "query, expected",
    [
        ("MATCH (n:Function) RETURN n.name AS n ORDER BY n", [("handleRequest",), ("helper",), ("main",), ("validate",)]),
        ("MATCH (n:Function {name:'validate'}) RETURN n.filePath", [("auth.go",)]),
        ("MATCH (n:Function) RETURN n.name ORDER BY n.name SKIP 1 LIMIT 2", [("helper",), ("main",)]),
        ("MATCH (a)-[:CALLS]->(b) RETURN a.name, b.name ORDER BY a.name", [("handleRequest", "validate"), ("main", "handleRequest")]),
        ("MATCH (n:Function) RETURN count(n) AS cnt", [(4,)]),
        ("MATCH (n:Class) RETURN count(*) AS cnt", [(0,)]),
        ("MATCH (f:Function) WHERE NOT ()-[:CALLS]->(f) RETURN f.name AS n ORDER BY n", [("helper",), ("main",)]),
        ("MATCH (f:Function) WHERE NOT (f)-[:CALLS]->() RETURN f.name AS n ORDER BY n", [("helper",), ("validate",)]),
        ("MATCH (f:Function) RETURN f.name ORDER BY f.importance DESC, f.name", [("helper",), ("main",), ("validate",), ("handleRequest",)]),
        ("MATCH p = (a:Function {name:'main'})-[:CALLS*1..5]->(b) RETURN [n IN nodes(p) | n.name] AS names, length(p) AS d ORDER BY d", [(["main", "handleRequest"], 1), (["main", "handleRequest", "validate"], 2)]),
        ("MATCH (a:Function)-[:CALLS*0..2]->(b:Function {name:'validate'}) RETURN a.name AS n ORDER BY n", [("handleRequest",), ("main",), ("validate",)]),
        ("MATCH (f:Function) OPTIONAL MATCH (f)-[:CALLS]->(g) RETURN f.name AS n, g.name AS m ORDER BY n", [("handleRequest", "validate"), ("helper", None), ("main", "handleRequest"), ("validate", None)]),
        ("MATCH (s)-[r:STEP_IN_PROCESS]->(p:Process) RETURN s.name, r.step ORDER BY r.step", [("main", 1), ("handleRequest", 2), ("validate", 3)]),
        ("MATCH (s)-[:STEP_IN_PROCESS]->(p) WITH p, count(s) AS n, collect(s.name) AS names WHERE n > 2 RETURN p.name, n, size(names)", [("main-flow", 3, 3)]),
        ("MATCH (a:Function)-[:CALLS]-(b:Function {name:'handleRequest'}) RETURN a.name AS n ORDER BY n", [("main",), ("validate",)]),
        ("MATCH (n:Function) WHERE n.isExported AND n.name CONTAINS 'val' RETURN id(n), labels(n)[0]", [("func:validate", "Function")]),
    ],
)
def test_cypher(graph, query, expected):
    assert rows(cypher(graph, query)) == expected


@pytest.mark.parametrize("query, write", [("MATCH (n) DELETE n", True), ("match (n) set n.x = 1", True), ("MATCH (n {name:'CREATE'}) RETURN n", False), ("MATCH (n) WHERE n.set = 1 RETURN n.create", False)])
def test_write_guard(graph, query, write):
    assert is_write_query(query) is write
    if write:
        with pytest.raises(WriteQueryError):
            cypher(graph, query)


def test_bad_queries(graph):
    for q in ("MATCH (n", "RETURN", "MATCH (n) RETURN nope(n)", "FOO"):
        with pytest.raises(CypherError):
            cypher(graph, q)


def test_predicates_reach_the_scan(graph, spark, tmp_path):
    graph.save(str(tmp_path / "g"))
    back = PropertyGraph.load(spark, str(tmp_path / "g"), check=True)
    assert back.nodes.count() == 7 and back.edges.count() == 6
    plan = cypher(back, "MATCH (a:Function)-[:CALLS]->(b) RETURN a.name")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(type" in plan and "content" not in plan


def test_graph_tools(graph, spark):
    assert dict(rows(graph.label_counts())) == {"Function": 4, "File": 2, "Process": 1}
    assert {r["id"]: r["degree"] for r in graph.degree("CALLS").collect()}["func:handle"] == 2
    keys = {r[0] for r in graph.property_keys().collect()}
    assert {"name", "filePath", "isExported"} <= keys and "content" not in keys
    less = graph.remove(graph.by_id("func:handle").select("id"))
    assert less.nodes.count() == 6 and less.edges.count() == 3
    both = federate({"a": graph, "b": graph})
    assert both.nodes.count() == 14 and both.dangling().isEmpty()
    start = graph.by_name("handleRequest").select("id")
    assert rows(traverse.impact(graph, start).select("name", "depth")) == [("main", 1)]
    assert rows(traverse.impact(graph, start, "upstream").select("name", "depth")) == [("validate", 1)]
    assert {(r["section"], r["name"]) for r in traverse.context(graph, start).collect()} == {("callers", "main"), ("callees", "validate"), ("processes", "main-flow")}
    assert {r["name"] for r in traverse.entry_points(graph).collect()} == {"main", "helper"}


def test_modularity_bounds(spark):
    clique = lambda k: [(i, j) for i in range(k, k + 5) for j in range(i + 1, k + 5)]
    pairs = [*clique(0), *clique(5), (0, 5)]
    adj = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "src long, dst long, w double")
    member = spark.createDataFrame([(i, i // 5) for i in range(10)], "id long, community long")
    assert traverse.modularity(adj, member).first()[0] == pytest.approx(19 / 42, abs=1e-3)


def test_range_join_against_all_pairs(spark):
    rng = random.Random(4)
    points = [(i, rng.choice(["a", "b", None]), rng.choice([*range(30), None])) for i in range(200)]
    spans = [(rng.randrange(40), rng.choice("abc"), x, x + rng.randrange(-2, 12)) for x in rng.choices(range(30), k=60)]
    out = traverse.tightest_enclosing(spark.createDataFrame(points, "point long, file string, line int"), spark.createDataFrame(spans, "span int, file string, first int, last int"))
    want = {p: min([(b - a, s) for s, g, a, b in spans if g == f and x is not None and a <= x <= b], default=(0, None))[1] for p, f, x in points}
    assert {r["point"]: r["span"] for r in out.collect()} == want
    # Points meet spans in a sweep, not in a join on the file.
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_nearest_compares_few_vectors_at_once(monkeypatch):
    rng = np.random.default_rng(1)
    v, shapes, cut = rng.normal(size=(100, 4)), [], np.partition
    monkeypatch.setattr(search.np, "partition", lambda a, *x, **k: shapes.append(a.shape) or cut(a, *x, **k))
    monkeypatch.setattr(search, "SLICE", 7, raising=False)
    sent = type("Sent", (), {"value": (list(range(10)), list(v[:10]))})
    out = pd.concat(search._nearest(sent, 3, -1.0)(iter([pd.DataFrame({"id": range(100), "vector": list(v)})])))
    u = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    for q in range(10):
        got = out[out["query"] == q].sort_values(["score", "id"], ascending=[False, True])["id"].tolist()[:3]
        assert got == sorted(range(100), key=lambda i: (-round(u[q] @ u[i], 9), i))[:3]
    assert max(n for _, n in shapes) <= 7


def test_range_and_containment(spark):
    points = spark.createDataFrame([(1, "a", 12), (2, "a", 99)], "point long, file string, line long")
    spans = spark.createDataFrame([("outer", "a", 1, 50), ("inner", "a", 10, 15)], "span string, file string, first long, last long")
    assert {(r["point"], r["span"]) for r in traverse.tightest_enclosing(points, spans).collect()} == {(1, "inner"), (2, None)}
    left = spark.createDataFrame([("S", "a"), ("S", "b"), ("T", "a")], "owner string, item string")
    right = spark.createDataFrame([("I", "a"), ("I", "b")], "whole string, item string")
    assert rows(traverse.set_containment(left, right)) == [("S", "I")]


def test_search(spark):
    lists = spark.createDataFrame([("a", "x", 3.0, 1.0), ("a", "y", 2.0, 1.0), ("b", "y", 9.0, 0.0)], "list_id string, id string, score double, weight double")
    got = {r["id"]: r["score"] for r in search.reciprocal_rank_fusion(lists).collect()}
    assert got["y"] == pytest.approx(1 / 62 + 1 / 61) and got["x"] == pytest.approx(1 / 61)
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, None)], "id long, text string")
    score = {r["id"]: r["score"] for r in search.bm25(docs, ["red"]).collect()}
    assert list(score) == [1] and score[1] == pytest.approx(math.log(1 + 2.5 / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / (5 / 3))))
    assert rows(search.phrase(docs, ["blue", "fox"])) == [(2, 1)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0])], "id long, vector array<float>")
    assert rows(search.vector_top(v, [1.0, 0.0], 2, 0.1)) == [(1, 1.0)]
