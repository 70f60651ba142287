"""Communities, flows, classes and resolution against brute force."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.operators import classes, communities, flows, resolve, traverse
from graphloom.operators.graph import PropertyGraph

# The karate club.
KARATE = "1-2 1-3 1-4 1-5 1-6 1-7 1-8 1-9 1-11 1-12 1-13 1-14 1-18 1-20 1-22 1-32 2-3 2-4 2-8 2-14 2-18 2-20 2-22 2-31 3-4 3-8 3-9 3-10 3-14 3-28 3-29 3-33 4-8 4-13 4-14 5-7 5-11 6-7 6-11 6-17 7-17 9-31 9-33 9-34 10-34 14-34 15-33 15-34 16-33 16-34 19-33 19-34 20-34 21-33 21-34 23-33 23-34 24-26 24-28 24-30 24-33 24-34 25-26 25-28 25-32 26-32 27-30 27-34 28-34 29-32 29-34 30-33 30-34 31-33 31-34 32-33 32-34 33-34"


def graph(spark, nodes, edges):
    """Nodes (id, label, name, filePath) and edges (src, dst, type, confidence)."""
    n = spark.createDataFrame(nodes, "id string, label string, name string, filePath string")
    return PropertyGraph.of(n, spark.createDataFrame([(str(i), *e) for i, e in enumerate(edges)], "edge_id string, src string, dst string, type string, confidence double"))


def adjacency(spark, pairs, w=1.0):
    both = [(a, b, w) for a, b in pairs] + [(b, a, w) for a, b in pairs]
    ids = sorted({x for p in pairs for x in p})
    return spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(both, "src string, dst string, w double")


@pytest.mark.parametrize("task_edges", [10**6, 0])
def test_communities_of_known_graphs(spark, task_edges):
    clique = [(f"{a}", f"{b}") for a in range(5) for b in range(a)] + [(f"{a}", f"{b}") for a in range(5, 10) for b in range(5, a)]
    nodes, adj = adjacency(spark, [*clique, ("0", "5")], 2.0)
    got = communities.leiden(nodes, adj, task_edges=task_edges)
    assert {(r["id"], r["community"]) for r in got.collect()} == {(str(i), "0" if i < 5 else "5") for i in range(10)}
    assert abs(traverse.modularity(adj, got).first()[0] - 19 / 42) < 1e-9
    nodes, adj = adjacency(spark, [tuple(e.split("-")) for e in KARATE.split()])
    q = traverse.modularity(adj, communities.leiden(nodes, adj, task_edges=task_edges)).first()[0]
    assert abs(q - 0.41979) < 0.005 or task_edges == 0 and q > 0.38


def test_communities_without_links_or_with_bad_weights(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    for w in (math.nan, math.inf, -1.0):
        adj = spark.createDataFrame([("a", "b", w), ("b", "a", w)], "src string, dst string, w double")
        assert {tuple(r) for r in communities.leiden(nodes, adj).collect()} == {("a", "a"), ("b", "b")}
    assert communities.leiden(nodes, adj.limit(0)).count() == 2
    with pytest.raises(ValueError):
        communities.leiden(nodes, adj, "other")


def test_components_of_chains_and_hubs(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("h", f"s{i}") for i in range(30)] + [("x", "x")]
    random.Random(1).shuffle(chain)
    nodes, adj = adjacency(spark, chain)
    got = {r["id"]: r["component"] for r in communities.components(nodes, adj).collect()}
    assert all(v == {"c": "c000", "h": "h", "s": "h", "x": "x"}[k[0]] for k, v in got.items()) and len(got) == 93


def brute_flow(adj, root, depth=10, branch=4):
    seen, line, out = {root}, [(root, 0)], []
    while line:
        v, d = line.pop(0)
        out.append((v, d))
        used = 0
        for _, u in sorted((-c, u) for u, c in adj[v].items()) if d < depth else []:
            if used == (2 * branch if d == 0 else branch):
                break
            if u not in seen:
                seen.add(u)
                line.append((u, d + 1))
                used += 1
    return out


def test_flows_against_brute_force(spark):
    rng = random.Random(3)
    names = [f"f{i:02}" for i in range(40)]
    edges = [(rng.choice(names[:30]), rng.choice(names[3:]), rng.choice(["CALLS", "CALLS", "SPAWNS", "DELEGATES_TO"]), rng.choice([None, 0.3, 0.5, 0.8, 0.9])) for _ in range(160)]
    g = graph(spark, [(n, "Function", n, f"pkg{i % 5}/a.go" if i % 9 else "tests/x.py") for i, n in enumerate(names)], edges)
    kinds = flows.starts(g).cache()
    steps = flows.trace(g, kinds)
    adj = {n: {} for n in names}
    for s, d, _, c in edges:
        if c is None or c >= 0.5:
            adj[s][d] = max(adj[s].get(d, 0), c or 0)
    want, seen = {}, set()
    for root in sorted(r["id"] for r in kinds.collect()):
        f = brute_flow(adj, root)
        key = frozenset(v for v, _ in f)
        if len(f) >= 3 and key not in seen:
            seen.add(key)
            want[root] = f
    got = defaultdict(list)
    for r in steps.orderBy("flow", "pos").collect():
        got[r["flow"]].append((r["node"], r["depth"]))
    assert want and dict(got) == want
    # Effective callers and steps by hand.
    share = defaultdict(int)
    for f in want.values():
        for v, _ in f:
            share[v] += 1
    scores = {r["flow"]: r for r in flows.importance(g, steps, kinds).collect()}
    assert set(scores) == set(want) and all(r["importance"] >= 0 for r in scores.values())
    for root, f in want.items():
        inner = {v for v, _ in f}
        assert scores[root]["callers"] == len({s for s, d, _, _ in edges if d in inner and s not in inner})
    seed = {k: r["importance"] for k, r in scores.items()}
    rank = dict(seed)
    outs = {k: sum(v in seed for v, _ in f) for k, f in want.items()}
    for _ in range(10):
        rank = {k: 0.15 * seed[k] + 0.85 * sum(rank[j] / outs[j] for j in want if j != k and any(v == k for v, _ in want[j])) for k in want}
    final = {k: seed[k] * (1 + math.log1p(rank[k] / seed[k] - 1)) if seed[k] > 0 and rank[k] > seed[k] else seed[k] for k in want}
    ranked = flows.page_rank(spark.createDataFrame(sorted(seed.items()), "flow string, importance double"), steps)
    assert {r["flow"]: round(r["importance"], 9) for r in ranked.collect()} == {k: round(v, 9) for k, v in final.items()}


def test_flows_by_number_and_callers_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(flows, "CHUNK", 3)
    edges = [("r", x, "CALLS", 0.9) for x in "ab"] + [(f"c{i}", "b", "CALLS", 0.9) for i in range(8)] + [("c1", "a", "CALLS", 0.9), ("a", "b", "CALLS", 0.9)]
    g = graph(spark, [(x, "Function", x, f"{x}.go") for x in ["r", "a", "b", *(f"c{i}" for i in range(8))]], edges)
    n, ids = flows.numbered(g)
    assert [r["id"] for r in ids.orderBy("n").collect()] == sorted(["r", "a", "b", *(f"c{i}" for i in range(8))])
    kinds = flows.starts(g)
    by_name = flows.trace(g, kinds)
    by_number = flows.named(flows.steps_of(flows.traced(n, flows.starts(n))), ids, "flow", "node")
    assert {tuple(r) for r in by_number.collect()} == {tuple(r) for r in by_name.collect()} and by_number.dtypes == by_name.dtypes
    scores = {r["flow"]: r["callers"] for r in flows.importance(g, by_name, kinds).collect()}
    # c1 calls two steps of the flow and counts once; r and a are steps themselves.
    assert scores["r"] == 8


def test_importance_of_a_plain_chain(spark):
    g = graph(spark, [(x, "Function", x, f"{x}.go") for x in "abc"], [("a", "b", "CALLS", 0.9), ("b", "c", "CALLS", 0.9)])
    kinds = flows.starts(g)
    assert [tuple(r) for r in kinds.collect()] == [("a", "entry")]
    row = flows.importance(g, flows.trace(g, kinds), kinds).first()
    assert abs(row["importance"] - 0.3 * math.log1p(3) * math.log1p(3) * 1.3) < 1e-9 and row["steps"] == 3
    whole = flows.add_flows(g)
    head = whole.by_label("Process").first()
    assert (head["id"], head["name"], head["entryPoint"], head["stepCount"]) == ("process:a-flow", "a-flow", "a", 3)
    assert [(r["src"], r["step"]) for r in whole.edges_of("STEP_IN_PROCESS").orderBy("step").collect()] == [("a", 1), ("b", 2), ("c", 3)]


def test_call_tree_shows_each_once_and_counts_the_rest(spark):
    g = graph(spark, [(f"n{i:02}", "Function", f"n{i:02}", "a.go") for i in range(30)], [("n00", f"n{i:02}", "CALLS", 1.0) for i in range(1, 26)] + [("n01", "n26", "CALLS", 1.0), ("n26", "n00", "CALLS", 1.0)])
    rows = list(flows.call_tree(g, "n00"))
    assert [r["id"] for r in rows][:3] == ["n01", "n26", "n02"] and rows[-1]["pruned"] == 5 and sum(r["id"] is not None for r in rows) == 21


def test_classes(spark):
    lang = {"C": "python", "J": "java", "R": "rust"}
    nodes = [(c, "Class", c, None) for c in "CJRPQ"] + [("I", "Interface", "I", None)] + [(f"{c}.m", "Method", "m", None) for c in "PQI"]
    edges = [(c, p, "IMPLEMENTS" if p == "I" else "EXTENDS", None) for c, ps in (("C", "QPI"), ("J", "PI"), ("R", "PQ")) for p in ps] + [(c, f"{c}.m", "HAS_METHOD", None) for c in "PQI"]
    g = graph(spark, nodes, edges)
    g = PropertyGraph(g.nodes.drop("language").join(spark.createDataFrame(list(lang.items()), "id string, language string"), "id", "left"), g.edges)
    got = {r["child"]: (r["n"], r["resolved"]) for r in classes.ambiguities(g).collect()}
    assert got == {"C": (3, "P.m"), "J": (2, "P.m"), "R": (2, None)}
    assert {(r["src"], r["dst"]) for r in classes.override_edges(classes.ambiguities(g)).collect()} == {("C", "P.m"), ("J", "P.m")}
    assert classes.linearize("D", {"D": ["B", "C"], "B": ["A"], "C": ["A"]}) == ["D", "B", "C", "A"]
    for bad in ({"D": ["A", "B"], "B": ["A"]}, {"D": ["E"], "E": ["D"]}):
        with pytest.raises(ValueError):
            classes.linearize("D", bad)
    types = spark.createDataFrame([("1", "Base", "Trait"), ("2", "Base", "Class"), ("3", "Shape", "Interface")], "id string, name string, label string")
    rec = spark.createDataFrame([("x", "Base", "extends"), ("x", "Shape", "extends"), ("x", "None", "extends")], "child string, parentName string, kind string")
    assert {tuple(r) for r in classes.heritage(rec, types).collect()} == {("x", "2", "EXTENDS"), ("x", "3", "IMPLEMENTS")}


def test_calls_against_all_pairs(spark):
    rng = random.Random(5)
    files = ["a/x.go", "a/y.go", "b/x.go", "c/z.go", ""]
    symbols = [(f"s{i:02}", rng.choice("fgh"), rng.choice(["Function", "Class", "Method"]), rng.choice(files), rng.choice(["", "Owner", None])) for i in range(25)]
    found = [(i, rng.choice("fghq"), rng.choice([None, "", "g"]), rng.choice(files), rng.choice(["", "ow", "own", "zzz"]), rng.choice([None, "Owner"])) for i in range(80)]
    imports = [(f, t) for f in files for t in files if rng.random() < 0.2]
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    want = {}
    for call, callee, original, file, recv, kind in found:
        for i, name, label, at, owner in symbols:
            if name not in (callee, original):
                continue
            owner = owner or ""
            score = 10 * (label != "Class") + 200 * (owner != "" and owner == kind)
            score += 100 * (at == file and (not recv or not owner or len(recv) <= 2 or owner.lower().startswith(recv)))
            score += 50 if (file, at) in imports else 45 if any(f == file and folder(t) == folder(at) for f, t in imports) else 0
            score += 40 * (folder(at) == folder(file) and at != file)
            want[call] = min(want.get(call, (1, "")), (-score, i))
    got = resolve.calls(
        spark.createDataFrame(found, "call long, callee string, original string, file string, receiver string, receiverType string"),
        spark.createDataFrame(symbols, "id string, name string, label string, file string, owner string"),
        spark.createDataFrame(imports, "file string, target string"),
    )
    assert {r["call"]: (-r["score"], r["id"]) for r in got.collect()} == want


def test_calls_of_a_frequent_name_meet_few_symbols(spark):
    # 300 calls ask three questions of one name with 300 symbols in six places.
    found = spark.range(300).select(F.col("id").alias("call"), F.lit("f").alias("callee"), F.lit(None).cast("string").alias("original"), F.concat(F.lit("a/"), F.col("id") % 3, F.lit(".py")).alias("file"), F.lit("").alias("receiver"), F.lit("o1").alias("receiverType"))
    symbols = spark.range(300).select(F.format_string("s%03d", "id").alias("id"), F.lit("f").alias("name"), F.lit("Method").alias("label"), F.concat(F.lit("a/"), F.col("id") % 6, F.lit(".py")).alias("file"), F.concat(F.lit("o"), F.col("id") % 2).alias("owner"))
    out = resolve.calls(found, symbols, spark.createDataFrame([], "file string, target string"))
    got = {r["call"]: (r["id"], r["score"]) for r in out.collect()}
    assert got == {i: [("s001", 250), ("s001", 310), ("s001", 250)][i % 3] for i in range(300)}
    rows = []

    def walk(p):
        while p.nodeName() == "AdaptiveSparkPlan" or "QueryStage" in p.nodeName():
            p = p.executedPlan() if p.nodeName() == "AdaptiveSparkPlan" else p.plan()
        if "Join" in p.nodeName():
            rows.append(p.metrics().get("numOutputRows").get().value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(out._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= 300


def test_imports(spark):
    files = spark.createDataFrame([(p,) for p in "pkg/a.py pkg/sub/__init__.py pkg/sub/b.py web/app.ts web/lib/index.ts src/main/java/org/x/Y.java crate/net/mod.rs".split()], "path string")
    rows = [(1, "pkg/sub/b.py", "..a", "python"), (2, "pkg/a.py", "pkg.sub", "python"), (3, "web/app.ts", "./lib", "typescript"), (4, "web/lib/index.ts", "../app", "typescript"), (5, "Z.java", "org.x.Y", "java"), (6, "m.rs", "crate::net", "rust"), (7, "pkg/a.py", "os", "python")]
    got = resolve.imports(spark.createDataFrame(rows, "imp long, file string, source string, language string"), files)
    assert {r["imp"]: r["path"] for r in got.collect()} == {1: "pkg/a.py", 2: "pkg/sub/__init__.py", 3: "web/lib/index.ts", 4: "web/app.ts", 5: "src/main/java/org/x/Y.java", 6: "crate/net/mod.rs"}
