"""Patterns that the reviewed queries got wrong."""

from __future__ import annotations

import random

import pytest

from graphloom.operators.graph import PropertyGraph
from graphloom.plans import cypher as compiler
from graphloom.plans.cypher import cypher


@pytest.fixture(scope="module")
def ring(spark):
    nodes = spark.createDataFrame([(x, "N", x.upper(), i) for i, x in enumerate("abcd")], "id string, label string, name string, size long")
    edges = spark.createDataFrame([("a", "b", "T"), ("b", "a", "T"), ("b", "c", "T"), ("c", "d", "U")], "src string, dst string, type string")
    return PropertyGraph.of(nodes, edges)


def rows(g, q):
    return sorted(tuple(r) for r in cypher(g, q).collect())


def test_no_relationship_twice(ring):
    assert rows(ring, "MATCH (x {id:'a'})-[:T]->(y)-[:T*1..3]->(z) RETURN id(y) AS y, id(z) AS z") == [("b", "a"), ("b", "c")]
    assert rows(ring, "MATCH (x {id:'a'})-[:T*1..3]->(y)-[:T*1..3]->(z) RETURN id(y) AS y, id(z) AS z") == [("a", "a")] * 0 + [("b", "a"), ("b", "c")]
    assert rows(ring, "MATCH (x {id:'a'})-[:T*]->(z) RETURN id(z) AS z") == [("a",), ("b",), ("c",)]
    assert rows(ring, "MATCH (x {id:'a'})-[*]->(z {id:'d'}) RETURN id(z) AS z") == [("d",)]
    assert rows(ring, "MATCH (x {id:'a'})-[:T*1..2]->(z), (x)-[:T]->(w) RETURN id(z) AS z, id(w) AS w") == []


def test_patterns_as_conditions(ring):
    every = [("a",), ("b",), ("c",), ("d",)]
    assert rows(ring, "MATCH (n:N) WHERE (:N)-[:T]->() RETURN id(n) AS id") == every
    assert rows(ring, "MATCH (n:N) WHERE NOT (:N)-[:T]->() RETURN id(n) AS id") == []
    assert rows(ring, "MATCH (n:N) WHERE (:Q)-[:T]->() RETURN id(n) AS id") == []
    assert rows(ring, "MATCH (n:N) WHERE NOT (:Q)-[:T]->() RETURN id(n) AS id") == every
    assert rows(ring, "MATCH (n:N) WHERE (n)-[:U]->() OR n.size = 0 RETURN id(n) AS id") == [("a",), ("c",)]
    assert rows(ring, "MATCH (n:N) WHERE (n)-[:U]->() OR NOT (n)-[:T]->() RETURN id(n) AS id") == [("c",), ("d",)]
    assert rows(ring, "MATCH (n:N) WHERE (:Q)-[:U]->() OR n.size = 1 RETURN id(n) AS id") == [("b",)]


def test_edge_ids_are_stable(spark):
    nodes = spark.createDataFrame([("a", "N"), ("b", "N")], "id string, label string")
    data = [("a", "b", "T", {"k": "1"}), ("a", "b", "T", {"k": "1"}), ("a", "b", "T", {"k": "2"}), ("b", "a", "T", None)]
    schema = "src string, dst string, type string, props map<string,string>"
    ids = [{r["edge_id"] for r in PropertyGraph.of(nodes, spark.createDataFrame(d, schema).repartition(n)).edges.collect()} for d, n in ((data, 1), (data[::-1], 4))]
    assert ids[0] == ids[1] and len(ids[0]) == 4


def test_order(spark):
    g = PropertyGraph.of(spark.createDataFrame([(str(i), "N", i * 7 % 5) for i in range(12)], "id string, label string, size long"), spark.createDataFrame([], "src string, dst string, type string"))
    got = [(r["s"], r["id"]) for r in cypher(g, "MATCH (n:N) RETURN n.size AS s, id(n) AS id ORDER BY n.size DESC, id(n)").collect()]
    assert got == sorted(got, key=lambda x: (-x[0], x[1]))


def test_nodes_of_a_path_join_only_if_their_properties_are_read(spark):
    nodes = spark.createDataFrame([(x, "T", x.upper()) for x in "abc"], "id string, label string, name string")
    g = PropertyGraph.of(nodes, spark.createDataFrame([("1", "a", "b", "R"), ("2", "b", "c", "R")], "edge_id string, src string, dst string, type string"))
    joins = {}
    for key in ("id", "name"):
        out = cypher(g, f"MATCH p = (a:T)-[:R*1..2]->(b:T) RETURN id(a) AS a, length(p) AS n, [x IN nodes(p) | x.{key}] AS way")
        up = (lambda w: w) if key == "id" else (lambda w: [x.upper() for x in w])
        assert {(r["a"], r["n"], tuple(r["way"])) for r in out.collect()} == {("a", 1, tuple(up(["a", "b"]))), ("b", 1, tuple(up(["b", "c"]))), ("a", 2, tuple(up(["a", "b", "c"])))}
        joins[key] = out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")
    assert joins == {"id": 4, "name": 7}


@pytest.mark.parametrize(
    "query,apart",
    [
        ("MATCH (n:N)<-[:A]-(a:X)-[:D]->(d:N), (n)<-[:B]-(b:X) RETURN n.name AS n, count(DISTINCT a.name) AS x, size(collect(DISTINCT b.name)) AS y, max(d.name) AS z", True),
        ("MATCH (a:X)-[:A]->(n:N)<-[:A]-(b:X) WHERE a <> b RETURN n.name AS n, count(*) AS c ORDER BY c DESC, n", True),
        ("MATCH (a:X)-[:A]->(n:N)<-[:B]-(b:X) WHERE a.name < 'x6' AND n.name <> 'q' RETURN n.name AS n, count(*) AS c", True),
        ("MATCH (a:X)-[:A]->(n:N)<-[:A]-(b:X) RETURN n.name AS n, count(*) AS c", False),
        ("MATCH (a:X)-[:A]->(n:N)<-[:B]-(b:X) WHERE a.name < b.name RETURN n.name AS n, count(*) AS c", False),
        ("MATCH (a:X)-[:A]->(n:N)<-[:B]-(b:X) RETURN n.name AS n, count(a.name) AS c, min(b.name) AS m", False),
    ],
)
def test_branches_are_aggregated_apart(spark, monkeypatch, query, apart):
    rng = random.Random(7)
    nodes = [(f"n{i}", "N", "pqr"[i % 3] if i else None) for i in range(5)] + [(f"x{i}", "X", f"x{i % 7}") for i in range(9)]
    edges = [(f"x{rng.randrange(9)}", f"n{rng.randrange(5)}", rng.choice("AABBD")) for _ in range(60)]
    g = PropertyGraph.of(spark.createDataFrame(nodes, "id string, label string, name string"), spark.createDataFrame(edges, "src string, dst string, type string"))
    kept, said = compiler._Lowering.factored, []
    monkeypatch.setattr(compiler._Lowering, "factored", lambda self, *a: said.append(kept(self, *a)) or said[-1])
    got = cypher(g, query)
    assert said == [apart]
    monkeypatch.setattr(compiler._Lowering, "factored", lambda self, *a: False)
    want = cypher(g, query)
    assert got.dtypes == want.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count()
