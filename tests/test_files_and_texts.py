"""File sources, edit distance, embedding texts and module roll-ups."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import distance
from graphloom.operators import embedding, modules
from graphloom.operators.graph import PropertyGraph
from graphloom.sources import files


def brute(a: str, b: str) -> int:
    """The same distance by the recursive definition."""
    from functools import cache

    @cache
    def d(i: int, j: int) -> int:
        if not i or not j:
            return i + j
        out = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        return min(out, d(i - 2, j - 2) + 1) if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] else out

    return d(len(a), len(b))


def test_edit_distance_is_the_recursive_one(spark):
    rng = random.Random(3)
    some = ["", "a", "ab", "ba", "ca", "abc", "éa", "aé"] + ["".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(25)]
    df = spark.createDataFrame([*itertools.product(some, some), (None, "a"), ("a", None)], "a string, b string")
    for r in df.withColumn("d", distance.edit_distance(F.col("a"), F.col("b"))).collect():
        assert r["d"] == (None if r["a"] is None or r["b"] is None else brute(r["a"], r["b"])), r


def test_closest_name(spark):
    names = spark.createDataFrame([("acme/rocket",), ("acme/anvil",), (None,)], "name string")
    asked = spark.createDataFrame([("rokcet",), ("ACME/anvl",), ("zebra",), (None,)], "asked string")
    assert {(r[0], r[1], r[2]) for r in distance.closest(names, asked).collect()} == {("rokcet", "rocket", 1), ("ACME/anvl", "acme/anvil", 1)}


def test_skipped_paths_languages_and_addresses(spark):
    want = {
        "src/a.go": (False, "go"), "vendor/a.go": (True, "go"), "x/vendor": (False, ""), "a.MIN.js": (True, "javascript"), "img/x.PNG": (True, ""), "LICENSE": (True, ""), "license": (False, ""), "a\\dist\\b.ts": (True, "typescript"),
        "x.pb.go": (True, "go"), "Cargo.lock": (True, ""), "": (False, ""), None: (False, None), "App.tsx": (False, "typescript"),
    }
    df = spark.createDataFrame([(p,) for p in want], "p string").select("p", files.is_skipped(F.col("p")), files.language(F.col("p")))
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == want
    urls = {"https://host.org/a/b.git": "host.org/a/b", "git@host.org:a/b.git": "host.org/a/b", "ssh://git@host.org:a/b": "host.org/a/b", "host.org/a/b/": "host.org/a/b", None: None}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", files.git_import_path(F.col("u")))
    assert {r[0]: r[1] for r in df.collect()} == urls


def test_file_tree_and_cat(spark, tmp_path):
    for p, c in {"a/x.py": b"one\ntwo\nthree\n", "a/y.txt": b"bad \xff", ".hid/z.py": b"", "node_modules/q.js": b"", "logs/l.txt": b"", "keep.log": b"k", "drop.log": b"d", "big.py": b"x" * 100}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(c)
    tree = files.file_tree(spark, str(tmp_path), ["# note", "logs/", "*.log", "!keep.log"], max_bytes=50)
    assert {(r["filePath"], r["name"], r["size"], r["language"]) for r in tree.collect()} == {("a/x.py", "x.py", 14, "python"), ("a/y.txt", "y.txt", 5, ""), ("keep.log", "keep.log", 1, "")}
    ask = spark.createDataFrame([("a/x.py",), ("a/y.txt",), ("none",)], "filePath string")
    got = {r["filePath"]: (r["content"], r["lineCount"], r["error"]) for r in files.cat(tree, "2-3", ask).collect()}
    assert got == {"a/x.py": ("two\nthree", 3, None), "a/y.txt": ("bad �", 1, None), "none": (None, None, "file not found: none")}
    assert files.line_range("") is None
    for bad in ("3-2", "0-1", "x"):
        with pytest.raises(ValueError):
            files.line_range(bad)


def test_content_store(spark, tmp_path):
    store = files.ContentStore(spark, f"file://{tmp_path}/store")
    assert store.count() == 0 and store.get("a") is None
    store.put(spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3"), (None, "x")], "filePath string, content string"))
    store.put(spark.createDataFrame([("a", "4")], "filePath string, content string"))
    assert store.get("a") == "4" and store.get("b") == "3" and store.count() == 2
    store.delete("b")
    assert not store.has("b") and store.has("a")


def sample(spark):
    nodes = [
        ("f", "File", "x.py", "src/pkg/x.py", "python", None, "About x", None, None, None),
        ("k", "Class", "Box", "src/pkg/x.py", None, None, None, "class Box", True, None),
        ("m", "Method", "authUser", "src/pkg/x.py", None, "authUser(a)", "Checks é", "line one\n" * 400, True, None),
        ("g", "Function", "go", "lib/y.py", None, None, None, None, False, False),
        ("t", "Function", "tiny", "lib/y.py", None, None, None, None, None, True),
        ("c1", "Community", "M1", None, None, None, None, None, None, None),
        ("c2", "Community", "M2", None, None, None, None, None, None, None),
        ("p", "Process", "authUser-flow", None, None, None, None, None, None, None),
    ]
    n = spark.createDataFrame(nodes, "id string, label string, name string, filePath string, language string, signature string, description string, content string, isExported boolean, isTest boolean")
    n = n.withColumn("heuristicLabel", F.when(F.col("id") == "p", "Authentication")).withColumn("importance", F.when(F.col("id") == "p", 2.0))
    edges = [("f", "m", "CONTAINS"), ("f", "k", "CONTAINS"), ("k", "m", "HAS_METHOD"), ("m", "g", "CALLS"), ("m", "g", "CALLS"), ("t", "m", "CALLS"), ("m", "p", "STEP_IN_PROCESS"), ("m", "c1", "MEMBER_OF"), ("g", "c2", "MEMBER_OF")]
    return PropertyGraph.of(n, spark.createDataFrame([(str(i), *e) for i, e in enumerate(edges)], "edge_id string, src string, dst string, type string"))


def test_embedding_choice_and_texts(spark):
    g = sample(spark)
    assert {(r[0], r[1], r[2]) for r in embedding.priorities(g).collect()} == {("k", 0, True), ("m", 2, True), ("g", 3, False), ("t", 3, False)}
    got = {r["id"]: r["text"] for r in embedding.texts(g).collect()}
    assert got["f"] == "File: src/pkg/x.py\nPackage: pkg\nLanguage: python\nDefines: Box, authUser\nDoc: About x\n"
    assert got["k"].startswith("Class: Box\nFile: src/pkg/x.py\nPackage: pkg\nMethods: authUser\n") and got["k"].endswith("\nclass Box")
    head = (
        "Method: authUser\nFile: src/pkg/x.py\nPackage: pkg\nSignature: authUser(a)\nCalls: go\nCalled by: tiny\nMember of: M1\nRole: Authentication\nPackage doc: About x\n"
        "Summary: Authentication method; bridges lib; part of the authUser-flow flow.\nDoc: Checks é\n\n"
    )
    assert got["m"].startswith(head)
    code = got["m"][len(head):]
    assert code.endswith("line one") and len(code) <= 4 * embedding.CODE_TOKENS < len(code) + 9


def test_budgets_cut_between_characters(spark):
    df = spark.createDataFrame([("ééé",), ("ab\ncdefg",), ("abcdef\ng",), ("",), (None,), ("abcd",)], "t string")
    assert [r[0] for r in df.select(embedding.within(F.col("t"), 1)).collect()] == ["éé", "ab\nc"[:4], "abcd", "", None, "abcd"]
    assert df.filter("t like 'abcdef%'").select(embedding.within(F.lit("abcdef\nxyz"), 2)).first()[0] == "abcdef"


def test_stale_vectors(spark):
    want = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, hash string")
    have = spark.createDataFrame([("a", "1"), ("b", "0"), ("z", "9")], "id string, hash string")
    assert {(r["id"], r["why"]) for r in embedding.stale(want, have).collect()} == {("b", "changed"), ("c", "missing")}
    assert {(r["id"], r["why"]) for r in embedding.stale(want, have, 1, 2).collect()} == {("b", "changed")}
    assert [r["id"] for r in embedding.orphans(have, want).collect()] == ["z"]
    assert embedding.stale(want.limit(0), have).isEmpty()


def test_modules(spark):
    g = sample(spark)
    assert {tuple(r) for r in modules.calls(g).select("module", "kind", "fromName", "toName").collect()} == {("M1", "out", "authUser", "go"), ("M1", "in", "tiny", "authUser"), ("M2", "in", "authUser", "go")}
    assert [tuple(r) for r in modules.between(g).collect()] == [("M1", "M2", 1)]
    page = {r[0]: r[1] for r in modules.pages(g).collect()}
    assert page["M1"] == "# M1\n\n## Files\n\n- src/pkg/x.py\n\n## Calls out\n\n- `authUser` (src/pkg/x.py) -> `go` (lib/y.py)\n\n## Calls in\n\n- `tiny` (lib/y.py) -> `authUser` (src/pkg/x.py)\n" and set(page) == {"M1", "M2"}


def test_module_calls_drop_what_is_beyond_the_cap_before_they_move(spark):
    nodes = spark.createDataFrame([(f"f{i}", "Function", f"f{i:02}", f"{i % 4}.go") for i in range(12)] + [(f"m{i}", "Community", f"M{i}", None) for i in range(3)], "id string, label string, name string, filePath string")
    edges = [(f"f{i}", f"f{j}", "CALLS") for i in range(12) for j in range(12) if (i * j) % 3 == 1] * 2 + [(f"f{i}", f"m{i % 3}", "MEMBER_OF") for i in range(9)]
    g = PropertyGraph.of(nodes, spark.createDataFrame(edges, "src string, dst string, type string"))
    name, file = (lambda i: f"f{i:02}"), (lambda i: f"{i % 4}.go")
    homes = {(f"M{i % 3}", file(i)) for i in range(9)}
    want = set()
    for s, d, t in edges:
        i, j = int(s[1:]), int(d[1:])
        if t == "CALLS":
            row = (name(i), file(i), name(j), file(j))
            want |= {(f"M{i % 3}", "intra", *row)} if i < 9 and j < 9 and i % 3 == j % 3 and file(i) != file(j) else set()
            want |= {(f"M{i % 3}", "out", *row)} if i < 9 and (f"M{i % 3}", file(j)) not in homes else set()
            want |= {(f"M{j % 3}", "in", *row)} if j < 9 and (f"M{j % 3}", file(i)) not in homes else set()
    cols = ("module", "kind", "fromName", "fromFile", "toName", "toFile")
    assert {tuple(r[c] for c in cols) for r in modules.calls(g).collect()} == want and modules.calls(g).count() == len(want)
    some = {k: sorted(w for w in want if w[:2] == k) for k in {w[:2] for w in want}}
    assert {tuple(r[c] for c in cols) for r in modules.calls(g, 2).collect()} == {w for k, v in some.items() for w in (v if k[1] == "intra" else v[:2])}
    assert "WindowGroupLimit" in modules.pages(g)._jdf.queryExecution().executedPlan().toString().split("Window [dense_rank", 1)[1]


def test_edges_of_texts_move_twice(spark):
    files = {"a": "src/p/a.go", "b": "q/b.go", "c": "r/c.go", "d": "p/d.go", "e": "s/e.go", "f": "t/f.go"}
    nodes = spark.createDataFrame([(x, "Function", x, f) for x, f in files.items()], "id string, label string, name string, filePath string")
    edges = [("a", x, "CALLS") for x in "bcdef"] + [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("b", "gone", "CALLS"), ("gone", "c", "CALLS")] + [("b", "c", "CALLS")] * 3
    out = embedding.texts(PropertyGraph.of(nodes, spark.createDataFrame(edges, "src string, dst string, type string")))
    got = {r["id"]: r["text"] for r in out.collect()}
    assert "Calls: b, c, d, e, f\n" in got["a"] and "bridges q, r, s; orchestrates 6 downstream functions" in got["a"]
    assert "Calls: c\n" in got["b"] and "bridges r; orchestrates 5 downstream" in got["b"] and "called from 6 call sites" in got["c"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 9


def test_calls_of_a_module_without_a_name(spark):
    nodes = spark.createDataFrame([("a", "Function", "a", "a.go"), ("b", "Function", "b", "b.go"), ("m", "Community", None, None)], "id string, label string, name string, filePath string")
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("a", "m", "MEMBER_OF"), ("b", "m", "MEMBER_OF")], "src string, dst string, type string")
    got = modules.calls(PropertyGraph.of(nodes, edges)).select("module", "kind", "fromName", "toName")
    assert {tuple(r) for r in got.collect()} == {(None, "out", "a", "b"), (None, "in", "a", "b")}
