"""Manifests and the engine's tools."""

from __future__ import annotations

import pytest

from graphloom.engine import Engine
from graphloom.operators.graph import PropertyGraph
from graphloom.sources import manifests


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [
        ("go.mod", "module x\nrequire a.org/b v1.0.0 // indirect\nrequire (\n c.org/d v2.0.0\n e.org/f v1.1.0\n)\nreplace (\n c.org/d => ../d\n e.org/f v1.1.0 => g.org/h v9.0.0\n)\nreplace e.org/f => no.org/no v0.0.1\n",
         [("a.org/b", "v1.0.0", False), ("../d", "v2.0.0", False), ("g.org/h", "v9.0.0", False)]),
        ("package.json", '{"dependencies": {"a": "^1"}, "devDependencies": {"b": "~2"}}', [("a", "^1", False), ("b", "~2", True)]),
        ("package.json", '{"engines": {"vscode": "1"}, "dependencies": {"a": "^1"}}', []),
        ("package.json", "{", []),
        ("Cargo.toml", '[dependencies]\na = "1"\nb = { git = "u" }\nc = { path = "x" }\n[dev-dependencies]\nd = { version = "2" }\n', [("a", "1", False), ("b", "", False), ("d", "2", True)]),
        ("composer.json", '{"require": {"php": "8", "ext-x": "*", "v/p": "1"}, "require-dev": {"v/q": "2"}}', [("v/p", "1", False), ("v/q", "2", True)]),
        ("Gemfile", "source 'x'\n  gem 'rails', '~> 7'\ngem \"pg\"\n# gem 'no'\n", [("rails", "~> 7", False), ("pg", "", False)]),
        ("pyproject.toml", '[project]\ndependencies = ["a[x]>=1; python_version>\'3\'", "b"]\n[project.optional-dependencies]\ntests = ["c==2"]\ndocs = ["d"]\n', [("a", ">=1", False), ("b", "", False), ("c", "==2", True), ("d", "", False)]),
        ("pyproject.toml", '[tool.poetry.dependencies]\npython = "^3"\na = "^1"\nb = { git = "u" }\n[tool.poetry.group.dev.dependencies]\nc = { version = "2" }\n', [("a", "^1", False), ("b", "git:u", False), ("c", "2", True)]),
        ("requirements.txt", "a==1 # note\n-r x.txt\n--index-url u\nb[z] >= 2 ; m --hash=x\nc \\\n ~= 3\nhttps://x/y\n#no\n", [("a", "==1", False), ("b", ">= 2", False), ("c", "~= 3", False)]),
        ("go.mod", "", []),
    ],
)
def test_manifests(kind, text, want):
    assert manifests.parse(kind, text) == want


def test_dependencies_of_a_tree(spark):
    files = [("requirements.txt", "a\n-r more/b.txt\n"), ("more/b.txt", "b\n-c c.txt\n-r ../requirements.txt"), ("more/c.txt", "c"), ("more/other.txt", "no"), ("sub/go.mod", "require x v1"), ("Gemfile", "gem 'g'"), ("package.json", None)]
    found = manifests.dependencies(spark.createDataFrame(files, "filePath string, content string"))
    assert {(r["filePath"], r["source"], r["name"]) for r in found.collect()} == {
        ("requirements.txt", "requirements.txt", "a"), ("more/b.txt", "requirements.txt", "b"), ("more/c.txt", "requirements.txt", "c"), ("Gemfile", "Gemfile", "g"),
    }
    nodes = spark.createDataFrame([("f", "File", "Gemfile", "Gemfile")], "id string, label string, name string, filePath string")
    g = PropertyGraph.of(nodes, spark.createDataFrame([], "edge_id string, src string, dst string, type string"))
    both = manifests.add_dependencies(g, found)
    assert [(r["src"], r["dst"]) for r in both.edges_of("DEPENDS_ON").collect()] == [("f", "dep:Gemfile:g")] and both.by_label("Dependency").count() == 4
    assert manifests.dependencies(spark.createDataFrame([], "filePath string, content string")).isEmpty()


def test_engine(spark):
    nodes = [("1", "Function", "run", "tests/x_test.go"), ("2", "Function", "run", "src/x.go"), ("3", "Function", "Walk", "src/y.go"), ("4", "Function", "run", "lib/z.go")]
    n = spark.createDataFrame(nodes, "id string, label string, name string, filePath string")
    g = PropertyGraph.of(n, spark.createDataFrame([("e", "3", "2", "CALLS")], "edge_id string, src string, dst string, type string"))
    e = Engine(g, spark.createDataFrame([("src/x.go", "a\nb")], "filePath string, content string"))
    one = lambda *a: [r["id"] for r in e.symbol(*a).collect()]
    assert (one("run"), one("walk"), one("3"), one("run", "z.go"), one("none")) == (["2"], ["3"], ["3"], ["4"], [])
    assert [r["id"] for r in e.impact("run").collect()] == ["3"] and "3" in {r["id"] for r in e.context("run").collect()}
    assert e.cypher("MATCH (a)-[:CALLS]->(b) RETURN count(a) AS n").first()[0] == 1
    assert [tuple(r) for r in e.cat(["src/x.go"], "2-9").collect()] == [("src/x.go", "b", 2, None)]
    assert {tuple(r) for r in e.schema()["types"].collect()} == {("CALLS", 1)}
    with pytest.raises(ValueError):
        Engine(g).cat(["x"])
