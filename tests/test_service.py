"""Stores, sources, the registry and the tools as calls."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import service
from graphloom.engine import Engine
from graphloom.functions import distance
from graphloom.operators import build, search
from graphloom.sources import memory, remote, vectors
from graphloom.sources.registry import Entry, Registry


def test_targets():
    assert remote.parse("git@github.com:a/b.git") == remote.Repository("github.com/a/b", "a/b", "git@github.com:a/b.git")
    assert remote.parse("https://user:key@gitlab.com/x/y/z/", "v1").canonical == "gitlab.com/x/y/z@v1" and remote.parse("ssh://git@h.org/a/b").name == "a/b"
    assert remote.is_host_path("github.com/a/b") and not remote.is_host_path("github.com/") and remote.is_shorthand("a/b") and not remote.is_shorthand("a/b/c")
    assert remote.split_ref("a/b@main") == ("a/b", "main") and remote.split_ref("git@h:a/b") == ("git@h:a/b", "") and remote.split_ref("a@") == ("a@", "")
    assert remote.clone_url("a/b") == "https://github.com/a/b" and remote.clone_url("github.com/a/b") == "https://github.com/a/b" and remote.is_project_name("name") and not remote.is_project_name("..")
    for bad in ("ftp://x/y", "https://host"):
        with pytest.raises(ValueError):
            remote.parse(bad)


def test_registry(tmp_path):
    r = Registry(str(tmp_path))
    for e in (Entry("o/one", "/1", "aaaa1111", url="https://h.org/o/one"), Entry("o/two", "/2", "aaaa2222", url="git@h.org:o/two.git"), Entry("p/one", "/3", "bbbb")):
        r.add(e)
    assert Registry(str(tmp_path)).list() == r.list() and r.resolve("aaaa1").name == "o/one" and r.resolve("two").hash == "aaaa2222" and r.get("nothing") is None
    for key in ("aaaa", "one", "twoo", "zzzzzzzzz"):
        with pytest.raises(LookupError):
            r.resolve(key)
    with pytest.raises(LookupError, match="did you mean 'o/two'"):
        r.resolve("tow")
    r.link("o/one", "o/two")
    assert r.linked("o/two") == ["aaaa1111"]
    with pytest.raises(ValueError):
        r.link("o/one", "o/one")
    r.update_embedding("o/one", status="complete", model="m")
    r.add(Entry("o/one", "/new", "aaaa1111", url="https://h.org/o/one"))
    assert r.resolve("o/one").embedding["model"] == "m" and r.by_url("ssh://git@h.org/o/two").name == "o/two"
    assert r.by_import_path("h.org/o/one/pkg/x")[1] == "pkg/x" and r.by_import_path("other/x") is None
    r.remove("o/one")
    assert r.linked("o/two") == [] and len(r.list()) == 2
    assert distance.distance("abcd", "acbd") == 1 and distance.distance("", "xy") == 2


def test_vector_store(spark, tmp_path):
    s = vectors.VectorStore(spark, f"file://{tmp_path}/v")
    assert s.count() == 0 and s.get("a") is None
    s.put(spark.createDataFrame([("a", [1.0, 0.0], "h1"), ("b", [0.0, 1.0], None), (None, [0.0, 0.0], "x")], "id string, vector array<double>, hash string"))
    s.put(spark.createDataFrame([("a", [0.5, 0.5])], "id string, vector array<double>"))
    keys = spark.createDataFrame([("a",), ("c",)], "id string")
    assert s.get("a") == [0.5, 0.5] and {r["id"]: r["hash"] for r in s.hashes(keys).collect()} == {"a": "h1"} and [r["id"] for r in s.has(keys).collect()] == ["a"]
    texts = spark.createDataFrame([("a", "alpha", "h1"), ("p:1", "beta", "h2"), ("p:2", None, "h3")], "id string, text string, hash string")
    assert s.upsert(texts, vectors.embed) == 2 and s.upsert(texts, vectors.embed) == 0 and s.count() == 4
    s.delete_prefix("p:")
    s.delete(keys)
    assert [r["id"] for r in s.ids().collect()] == ["b"]
    s.clear()
    assert s.count() == 0
    v = vectors.HashingProvider(64).embed(["read a file", "read the file", "zebra", None])
    assert v[0] @ v[1] > v[0] @ v[2] and np.allclose((v[:3] ** 2).sum(axis=1), 1) and not v[3].any()


def test_memory_source_and_contents(spark):
    found = memory.MemorySource({"a.py": "x = 1", "node_modules/b.js": "y", ".hidden.py": "z", "c.txt": b"\xff"}, ignore=["*.txt"]).files(spark)
    assert [(r["filePath"], r["language"], r["size"]) for r in found.collect()] == [("a.py", "python", 5)]
    other = spark.createDataFrame([("a.py", "old"), ("d.py", "d")], "filePath string, content string")
    got = {r["filePath"]: (r["content"], r["error"]) for r in memory.resolve(spark.createDataFrame([("a.py",), ("d.py",), ("e.py",)], "filePath string"), found, other).collect()}
    assert got == {"a.py": ("x = 1", None), "d.py": ("d", None), "e.py": (None, "not found: e.py")}


def test_vector_search_of_a_set(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)] + [(120, None), (121, [0.0] * 6), (122, [1.0, 2.0])]
    rows.append((123, rows[0][1]))
    v = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    got: dict = {}
    for r in search.vector_top_all(v, v.filter("id % 20 = 0"), 5, 0.1, block=3).collect():
        got.setdefault(r["query"], {})[r["id"]] = r["score"]
    m = {i: np.array(x) for i, x in rows if x is not None}

    def cos(a, b):
        n = np.sqrt(a @ a) * np.sqrt(b @ b) if len(a) == len(b) else 0
        return round(float(a @ b / n), 9) if n else 0.0

    for q in range(0, 120, 20):
        best = sorted(((-cos(m[q], x), i) for i, x in m.items() if cos(m[q], x) >= 0.1))[:5]
        assert set(got[q]) == {i for _, i in best} and all(got[q][i] == pytest.approx(-s) for s, i in best)
    assert got.keys() == set(range(0, 120, 20))
    assert search.vector_top_all(v, v.filter("false"), 5).count() == 0


def test_calls(spark, tmp_path):
    files = spark.createDataFrame([("src/a.py", "def one():\n    return two()\n\ndef two():\n    pass\n")], "filePath string, content string")
    g = build.from_files(files)
    s = service.Service({"app": Engine(g, files)})
    assert {r["name"] for r in s.call("context", {"name": "one"})["result"]} == {"two"}
    assert s.call("impact", {"name": "two"})["result"][0]["name"] == "one"
    assert s.call("cypher", {"query": "MATCH (f:Function) RETURN f.name AS n ORDER BY n"})["result"] == [{"n": "one"}, {"n": "two"}]
    assert s.call("cat", {"files": ["src/a.py"], "lines": "1-1"})["result"][0]["content"] == "def one():"
    assert s.call("status")["result"] == {"repositories": ["app"]} and "labels" in s.call("schema")["result"]
    assert [x["id"] for x in s.call("query", {"query": "one"})["result"]["definitions"]][:1]
    codes = [s.call(*x)["error"]["code"] for x in [("nope",), ("cypher", {}), ("cypher", {"query": 3}), ("cypher", {"query": "CREATE (n)"}), ("schema", {"repo": "other"}), ("cypher", {"query": "MATCH"})]]
    assert codes == [service.UNKNOWN_METHOD, service.INVALID, service.INVALID, service.BLOCKED, service.NO_REPOSITORY, service.INVALID]
    assert {t["name"] for t in service.tools()} == set(service.TOOLS)
    http = service.server(s)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{http.server_port}/api/"
    try:
        with urllib.request.urlopen(urllib.request.Request(url + "status", data=b"{}")) as r:
            assert json.load(r) == {"result": {"repositories": ["app"]}}
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(url + "none", data=b"{}"))
        assert e.value.code == 404
    finally:
        http.shutdown()
    g.save(f"file://{tmp_path}/g")
    assert service.main(["cypher", f"file://{tmp_path}/g", json.dumps({"query": "MATCH (f:Function) RETURN count(f) AS n"})]) == 0
    assert service.main(["nope-not"] if False else ["cypher", f"file://{tmp_path}/g", json.dumps({"query": "DELETE n"})]) == 1


def test_orphans_and_context_leave_tests_out(spark):
    files = spark.createDataFrame([("a.py", "def one():\n    pass\n"), ("tests/test_a.py", "from a import one\ndef test_one():\n    one()\n")], "filePath string, content string")
    e = Engine(build.from_files(files))
    assert e.context("one").filter(F.col("section") == "callers").count() == 0 and [r["name"] for r in e.context("one", tests=True).filter("section = 'callers'").collect()] == ["test_one"]
    assert e.impact("one").count() == 0 and "test_one" in {r["name"] for r in e.impact("one", tests=True).collect()}
