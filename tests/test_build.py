"""Extraction from source text, graphs of files, names of communities, postings and entry scores."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import build, naming, postings, search
from graphloom.operators.graph import PropertyGraph
from graphloom.sources import extract, manifests

GO = '''package main

import (
	"fmt"
	u "example.com/app/src/util"
)

// Service runs things.
type Service struct {
	name string
}

type Runner interface {
	Run(n int) error
}

// Run starts the service.
func (s *Service) Run(n int) error {
	fmt.Println("helper(")
	helper(n)
	go s.loop()
	return nil
}

func (s *Service) loop() {}

func helper(n int) string {
	x := Service{}
	x.Run(n)
	register(helper)
	return ""
}
'''
PY = '''"""Doc."""
import os
from .base import Base as B
from pkg import tools

LIMIT = 3


class Child(B):
    """A child."""

    size: int

    def act(self, other: B) -> int:
        x = Child()
        y = x
        self.size = tools.load(other)
        y.act(x)
        return helper(y)


def helper(v):
    import threading

    threading.Thread(target=work).start()
    return [work(i) for i in range(3)]


def work(i=0):
    pass
'''
TS = """import { Base as Root, other } from './base';
import helper from "../lib/helper";

export interface Shape { area(): number }

export class Circle extends Root implements Shape {
  constructor(private radius: number) { super(); }
  // area of a "circle {"
  public area(): number { return compute(this.radius); }
}

export const compute = (r: number): number => { return r * other(r); };

function hidden() {}
"""
JAVA = """package a.b;
import a.b.c.Helper;

/** Docs of <b>Job</b>. */
public class Job extends Base implements Runnable, Shape {
    private int count;
    public Job(int count) { this.count = count; }
    @Override
    public void run() { Helper h = new Helper(); h.help(count); }
    private static String name(String a, int b) { return a; }
}
record Point(int x, int y) {}
"""
RUST = """use crate::util::load;
pub struct Engine { size: u32 }
impl Drop for Engine { fn drop(&mut self) {} }
impl Engine {
    pub fn start(&self, n: u32) -> u32 { let e = Engine::new(); load(n); n }
    fn new() -> Engine { Engine { size: 1 } }
}
trait Go { fn go(&self); }
"""
RUBY = """require_relative 'base'
module Tools
  class Worker < Base
    include Comparable
    attr_accessor :name, :age
    def run(x)
      helper(x)
    end
  end
end
"""
CPP = """#include "base.h"
namespace app {
class Shape : public Base {
 public:
  virtual double area() { return 0; }
};
}
double Shape::grow(int by) { return scale(by); }
static int scale(int by) { return by * 2; }
"""
KOTLIN = """package a
import a.b.Base
data class User(val name: String, private val age: Int) : Base(), Shown {
    fun greet(who: String): String { return hello(who) }
}
fun hello(s: String) = s
"""


def rows(lang, source, path="f"):
    return extract.records_of(path, lang, source)


def symbols(lang, source):
    return {(r["label"], r.get("owner") or "", r["name"]) for r in rows(lang, source) if r["kind"] == "symbol"}


def of(lang, source, kind):
    return {(r["name"], r.get("receiver") or "", r.get("owner") or "") for r in rows(lang, source) if r["kind"] == kind}


def heritage(lang, source):
    return {(r["name"], r["other"], r["label"]) for r in rows(lang, source) if r["kind"] == "heritage"}


def test_go():
    assert symbols("go", GO) >= {("Struct", "", "Service"), ("Interface", "", "Runner"), ("Method", "Runner", "Run"), ("Method", "Service", "Run"), ("Method", "Service", "loop"), ("Function", "", "helper")}
    calls = of("go", GO, "call")
    assert ("helper", "", "Service.Run") in calls and ("Println", "fmt", "Service.Run") in calls and ("Run", "x", "helper") in calls and len([c for c in calls if c[0] == "helper"]) == 1
    assert of("go", GO, "spawn") == {("loop", "s", "Service.Run")}
    assert ("helper", "", "helper") in of("go", GO, "delegate")
    assert {(r["name"], r["receiver"]) for r in rows("go", GO) if r["kind"] == "import"} == {("fmt", "fmt"), ("example.com/app/src/util", "u")}
    assert {(r["owner"], r["name"], r["other"]) for r in rows("go", GO) if r["kind"] == "binding"} >= {("Service.Run", "s", "Service"), ("helper", "x", "Service")}
    run = next(r for r in rows("go", GO) if r["kind"] == "symbol" and r["name"] == "Run" and r["owner"] == "Service")
    assert run["exported"] and run["parameterTypes"] == "n:int" and run["parameterCount"] == 1 and run["returnType"] == "error" and run["description"] == "Run starts the service." and run["endLine"] - run["line"] == 5


def test_python():
    assert symbols("python", PY) == {("Class", "", "Child"), ("Property", "Child", "size"), ("Method", "Child", "act"), ("Function", "", "helper"), ("Function", "", "work"), ("Const", "", "LIMIT")}
    assert heritage("python", PY) == {("Child", "B", "extends")}
    assert {("load", "tools", "Child.act"), ("act", "y", "Child.act"), ("helper", "", "Child.act"), ("work", "", "helper")} <= of("python", PY, "call")
    assert of("python", PY, "spawn") == {("work", "", "helper")}
    assert of("python", PY, "assignment") == {("size", "self", "Child.act")}
    assert {(r["name"], r["other"]) for r in rows("python", PY) if r["kind"] == "binding"} >= {("x", "Child"), ("y", "Child"), ("other", "B"), ("self", "Child")}
    assert rows("python", "def (")[0]["kind"] == "error" and rows("python", "") == []


def test_other_languages():
    ts = symbols("typescript", TS)
    assert ts >= {("Interface", "", "Shape"), ("Class", "", "Circle"), ("Method", "Circle", "area"), ("Property", "Circle", "radius"), ("Function", "", "compute"), ("Function", "", "hidden")}
    assert heritage("typescript", TS) == {("Circle", "Root", "extends"), ("Circle", "Shape", "implements")}
    assert {(r["receiver"], r["other"]) for r in rows("typescript", TS) if r["kind"] == "import"} == {("Root", "Base"), ("other", "other"), ("helper", "helper")}
    assert {r["name"]: bool(r["exported"]) for r in rows("typescript", TS) if r["kind"] == "symbol" and r["label"] == "Function"} == {"compute": True, "hidden": False}
    java = symbols("java", JAVA)
    assert java >= {("Class", "", "Job"), ("Constructor", "Job", "Job"), ("Method", "Job", "run"), ("Method", "Job", "name"), ("Property", "Job", "count"), ("Record", "", "Point"), ("Property", "Point", "x")}
    assert heritage("java", JAVA) == {("Job", "Base", "extends"), ("Job", "Runnable", "implements"), ("Job", "Shape", "implements")}
    assert ("help", "h", "Job.run") in of("java", JAVA, "call") and ("count", "this", "Job.Job") in of("java", JAVA, "assignment")
    assert next(r for r in rows("java", JAVA) if r["name"] == "Job" and r["kind"] == "symbol" and r["label"] == "Class")["description"] == "Docs of Job."
    rust = symbols("rust", RUST)
    assert rust >= {("Struct", "", "Engine"), ("Method", "Engine", "start"), ("Method", "Engine", "new"), ("Method", "Engine", "drop"), ("Trait", "", "Go"), ("Method", "Go", "go")}
    assert heritage("rust", RUST) == {("Engine", "Drop", "implements")}
    ruby = symbols("ruby", RUBY)
    assert ruby >= {("Module", "", "Tools"), ("Class", "Tools", "Worker"), ("Method", "Worker", "run"), ("Property", "Worker", "name"), ("Property", "Worker", "age")}
    assert heritage("ruby", RUBY) == {("Worker", "Base", "extends"), ("Worker", "Comparable", "implements")}
    cpp = symbols("cpp", CPP)
    assert cpp >= {("Class", "", "Shape"), ("Method", "Shape", "area"), ("Method", "Shape", "grow"), ("Function", "", "scale")} and heritage("cpp", CPP) == {("Shape", "Base", "extends")}
    kotlin = symbols("kotlin", KOTLIN)
    assert kotlin >= {("Class", "", "User"), ("Property", "User", "name"), ("Method", "User", "greet"), ("Function", "", "hello")} and ("User", "Base", "extends") in heritage("kotlin", KOTLIN)
    assert ("Function", "", "frob") in symbols("elixir", "def frob(x)\n  call(x)\nend\n")


def test_graph_of_files(spark):
    files = spark.createDataFrame(
        [("src/app/main.go", GO), ("src/pkg/child.py", PY), ("src/pkg/base.py", "class Base:\n    def act(self):\n        pass\n"), ("src/pkg/tools.py", "def load(x):\n    return x\n"), ("tests/test_child.py", "def test_it():\n    pass\n"), ("README.md", "# Hi"), (None, "x"), ("bad.py", "def ("), ("data.bin", None)],
        "filePath string, content string",
    )
    g = build.from_files(files)
    nodes = {r["id"]: r for r in g.nodes.collect()}
    assert {r["id"] for r in nodes.values() if r["label"] == "Folder"} == {"folder:src", "folder:src/app", "folder:src/pkg", "folder:tests"}
    assert nodes["file:README.md"]["content"] == "# Hi" and nodes["file:src/app/main.go"]["content"] is None
    named = {(r["label"], r["name"], r["filePath"]): k for k, r in nodes.items()}
    edges = {(r["src"], r["type"], r["dst"]) for r in g.edges.collect()}
    at = lambda label, name, path="src/pkg/child.py": named[label, name, path]
    child, act, helper, work = at("Class", "Child"), at("Method", "act"), at("Function", "helper"), at("Function", "work")
    assert {(child, "HAS_METHOD", act), (child, "HAS_PROPERTY", at("Property", "size")), (act, "CALLS", helper), (helper, "CALLS", work), (helper, "SPAWNS", work), ("file:src/pkg/child.py", "DEFINES", child), ("folder:src", "CONTAINS", "folder:src/pkg"), ("folder:src/pkg", "CONTAINS", "file:src/pkg/child.py")} <= edges
    assert ("file:src/pkg/child.py", "IMPORTS", "file:src/pkg/base.py") in edges and ("file:src/pkg/child.py", "IMPORTS", "file:src/pkg/tools.py") in edges
    assert (act, "CALLS", at("Function", "load", "src/pkg/tools.py")) in edges and (act, "USES", child) in edges and (act, "ACCESSES", at("Property", "size")) in edges
    go = "src/app/main.go"
    assert (at("Struct", "Service", go), "IMPLEMENTS", at("Interface", "Runner", go)) in edges and (at("Function", "helper", go), "DELEGATES_TO", at("Function", "helper", go)) not in edges
    assert not nodes[at("Function", "test_it", "tests/test_child.py")]["isExported"] and nodes[at("Function", "test_it", "tests/test_child.py")]["isTest"]
    assert g.dangling().isEmpty() and g.edges.select("edge_id").distinct().count() == len(edges) == g.edges.count()
    empty = build.from_files(files.filter("false"))
    assert empty.nodes.isEmpty() and empty.edges.isEmpty()


def test_manifests_of_other_tools():
    parse = manifests.parse
    assert parse("*.csproj", '<Project xmlns="x"><ItemGroup><PackageReference Include="A" Version="1"/><PackageReference Update="B"><Version>2</Version></PackageReference><PackageReference Include="$(C)"/></ItemGroup></Project>') == [("A", "1", False), ("B", "2", False)]
    assert parse("Package.swift", '.package(url: "https://h/o/Kit.git", from: "1.2"), .package(url: "https://h/o/Two", .upToNextMajor(from: "3.0"))') == [("Kit", "1.2", False), ("Two", "3.0", False)]
    pom = "<project><groupId>g</groupId><version>9</version><properties><v>1.0</v></properties><dependencies><dependency><groupId>${project.groupId}</groupId><artifactId>a</artifactId><version>${v}</version></dependency><dependency><groupId>t</groupId><artifactId>t</artifactId><scope>test</scope></dependency><dependency><groupId>p</groupId><artifactId>p</artifactId><scope>provided</scope></dependency><dependency><groupId>${u}</groupId><artifactId>x</artifactId></dependency></dependencies><dependencyManagement><dependencies><dependency><groupId>m</groupId><artifactId>m</artifactId><version>2</version></dependency></dependencies></dependencyManagement></project>"
    assert parse("pom.xml", pom) == [("g:a", "1.0", False), ("t:t", "", True), ("m:m", "2", False)] and parse("pom.xml", "<project>") == []
    assert parse("build.gradle", "implementation 'a:b:1'\ntestImplementation(\"c:d:2\")\napi \"e:f:$v\"") == [("a:b", "1", False), ("c:d", "2", True)]
    assert parse("gradle.lockfile", "# x\na:b:1=compileClasspath,testRuntime\nc:d:2=testCompile\nempty=") == [("a:b", "1", False), ("c:d", "2", True)]
    assert parse("vcpkg.json", '{"dependencies": ["zlib", {"name": "fmt", "version>=": "9"}, 3]}') == [("zlib", "", False), ("fmt", "9", False)]


def test_settings_of_imports(spark):
    files = [
        ("go.mod", "module example.com/app\n"), ("cmd/main.go", 'package main\n\nimport (\n\t"fmt"\n\t"example.com/app/internal/db"\n)\n\nfunc main() { db.Open(); fmt.Println() }\n'), ("internal/db/open.go", "package db\n\nfunc Open() {}\n"), ("fmt/x.go", "package fmt\n\nfunc Println() {}\n"),
        ("tsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["src/lib/*"]}}}'), ("web/a.ts", "import { b } from '@lib/b';\nfunction a() { return b(1); }\n"), ("src/lib/b.ts", "export function b(x: number) { return x; }\n"),
        ("composer.json", '{"autoload": {"psr-4": {"App\\\\": "php/"}}}'), ("php/Job.php", "<?php\nnamespace App;\nclass Job {}\n"), ("run.php", "<?php\nuse App\\Job;\n"),
    ]
    g = build.from_files(spark.createDataFrame(files, "filePath string, content string"))
    got = {(r["src"], r["dst"]) for r in g.edges_of("IMPORTS").collect() if r["src"].startswith("file:")}
    assert got == {("file:cmd/main.go", "file:internal/db/open.go"), ("file:web/a.ts", "file:src/lib/b.ts"), ("file:run.php", "file:php/Job.php")}
    names = {r["id"]: r["name"] for r in g.nodes.collect()}
    assert {(names[r["src"]], names[r["dst"]]) for r in g.edges_of("CALLS").collect()} == {("main", "Open"), ("a", "b")}


def test_paths(spark):
    tests = "a/foo_test.go a/src/test/B.java x/FooTest.java x/FooTests.swift x/BarSpec.kt x/BazSuite.scala x/foo_unittest.cc x/y.test.ts x/App.Tests/y.cs x/uitests/a.swift test.go test_a.py".split()
    plain = "a/foo.go src/main/B.java x/Testing.java x/latest.py contest.rb testable.go".split()
    got = {r["p"]: r["t"] for r in spark.createDataFrame([(p,) for p in tests + plain], "p string").select("p", text.is_test_path(F.col("p")).alias("t")).collect()}
    assert [p for p in tests if not got[p]] == [] and [p for p in plain if got[p]] == []
    cases = {"a/x_example.go": True, "example_x.py": True, "a/OrderDemo.java": True, "a/b.stories.ts": True, "demo.c": True, "examples/a.c": True, "a/b.c": False, "a/exampled.go": False}
    got = {r["p"]: r["t"] for r in spark.createDataFrame([(p,) for p in cases], "p string").select("p", text.is_example_path(F.col("p")).alias("t")).collect()}
    assert got == cases
    more = spark.createDataFrame([("a/utils/x.go", "README.md"), ("a/string_utils.py", "docs/x.md"), ("a/b.py", "x.md"), (None, None)], "u string, d string")
    assert [tuple(r) for r in more.select(text.is_utility_path(F.col("u")), text.is_document_path(F.col("d"))).collect()] == [(True, True), (True, True), (False, False), (False, False)]


def test_entry_score(spark):
    rows_ = [("main", "go", False, 0, 4, "cmd/main.go"), ("getName", "java", True, 1, 4, "a.java"), ("get_users", "python", True, 0, 2, "api/users.py"), ("x", None, None, None, None, None), ("plain", "c", False, 1, 2, "a.c")]
    df = spark.createDataFrame(rows_, "name string, language string, exported boolean, callers int, callees int, path string")
    got = [r[0] for r in df.select(text.entry_score(*[F.col(c) for c in df.columns])).collect()]
    assert [round(r["score"], 6) for r in got] == [6.0, 1.2, 9.0, 0.0, 1.0]
    assert got[2]["reasons"] == ["exported", "entry-pattern", "framework:api-handler"] and got[3]["reasons"] == ["no-outgoing-calls"]
    assert text.is_prose("how does the login work") and not text.is_prose("getUserName") and text.is_prose("find the user") and not text.is_prose("user login")


def test_names_of_communities():
    make = lambda folders, exported=None, size=None: (folders, exported or {}, size or sum(folders.values()))
    named = naming.unique_names([(f"community-{i}", *x) for i, x in enumerate([make({"a/auth": 5, "a/util": 9}), make({"a/auth": 5}, {"Login": 2, "Out": 1}), make({}), make({"zed": 9, "zed/web": 3, "zed/api": 2}), make({"x/util": 4}), make({"x/one": 2, "y/two": 2, "z/three": 2})])])
    assert list(named.values()) == ["auth+a/util", "auth", "community-2", "web+api", "x/util", "one+two"]
    again = naming.unique_names([("community-0", {"a/auth": 3}, {}, 3), ("community-1", {"b/auth": 3}, {"Login": 1}, 3), ("community-2", {"c/auth": 3}, {}, 3)])
    assert list(again.values()) == ["auth", "Login", "community-2"]


def test_communities_as_nodes(spark):
    nodes = spark.createDataFrame([("f1", "Function", "A", "src/auth/a.go", True), ("f2", "Function", "B", "src/auth/b.go", False), ("f3", "Function", "C", "src/db/c.go", True)], "id string, label string, name string, filePath string, isExported boolean")
    g = PropertyGraph.of(nodes, spark.createDataFrame([], "src string, dst string, type string"))
    out = naming.apply(g, spark.createDataFrame([("f1", 0), ("f2", 0), ("f3", 1), ("gone", 1)], "id string, community int"), 0.12345)
    assert {(r["id"], r["name"], r["communitySize"], r["modularity"]) for r in out.by_label("Community").collect()} == {("community:0", "auth", 2, 0.123), ("community:1", "db", 2, 0.123)}
    assert {(r["src"], r["dst"]) for r in out.edges_of("MEMBER_OF").collect()} == {("f1", "community:0"), ("f2", "community:0"), ("f3", "community:1")}


@pytest.mark.parametrize("word,stem", [x.split(":") for x in "caresses:caress ponies:poni cats:cat agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop falling:fall filing:file happy:happi relational:relat rational:ration digitizer:digit operator:oper triplicate:triplic electrical:electr hopefulness:hope revival:reviv adoption:adopt probate:probat controll:control roll:roll".split()])
def test_stems(word, stem):
    assert postings.stem(word) == stem


def test_postings(spark, tmp_path):
    docs = [("a", "the quick brown foxes"), ("b", "Quick foxes, quick!"), ("c", None), ("d", "brown fox's den of the brown fox"), (None, "fox")]
    frame = spark.createDataFrame(docs, "id string, body string")
    ix = postings.Index(spark, f"file://{tmp_path}/ix").build(frame, ["body"])
    assert ix.count() == 4
    assert {r["id"] for r in ix.search("body", "fox").collect()} == {"a", "b", "d"} and ix.search("body", "the of").count() == 0 and ix.search("body", "").count() == 0
    assert {r["id"]: r["times"] for r in ix.phrase("body", "brown foxes").collect()} == {"a": 1, "d": 2}
    assert {r["id"] for r in ix.phrase("body", "quick brown").collect()} == {"a"}
    # Without an analyzer the scores are those of the scan.
    plain = postings.Index(spark, f"file://{tmp_path}/plain").build(frame, ["body"], plain=True)
    want = {r["id"]: r["score"] for r in search.bm25(frame.filter("id is not null"), ["quick", "foxes"], "id", "body").collect()}
    got = {r["id"]: r["score"] for r in plain.search("body", "quick foxes", plain=True).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert "PartitionFilters: [isnotnull(bucket" in plain._of("body", ["quick"])._jdf.queryExecution().toString() or re.search(r"PartitionFilters: \[[^\]]*bucket", plain._of("body", ["quick"])._jdf.queryExecution().toString())
    ix.delete()
    assert not (tmp_path / "ix").exists()


def test_postings_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(postings, "BATCH_PLACES", 11)
    texts = [f"w{i} x w{i % 3} été x" for i in range(40)] + [None, ""]
    sent = list(postings._indexed(["t", "u"], True)([pa.RecordBatch.from_pydict({"id": list(range(42)), "t": texts, "u": texts[::-1]})]))
    assert len(sent) > 20 and max(sum(map(len, b.column("places").to_pylist())) for b in sent) < 11 + 10
    got = {(r["id"], r["field"], r["term"]): (r["bucket"], r["length"], r["places"]) for b in sent for r in b.to_pylist()}
    want = {}
    for f, ts in (("t", texts), ("u", texts[::-1])):
        for i, t in enumerate(ts):
            own = (t or "").split()
            want |= {(i, f, w): (postings.bucket_of(f, w), len(own), [k for k, x in enumerate(own) if x == w]) for w in ["", *own]}
    assert got == want and sum(b.num_rows for b in sent) == len(want)


def test_index_documents(spark):
    nodes = spark.createDataFrame([("file:a/userStore.go", "File", "userStore.go", "a/userStore.go", None), ("f", "Function", "getUser", "a/userStore.go", "func getUser(id int)"), ("file:b.go", "File", "b.go", "lib/dbPool.go", None)], "id string, label string, name string, filePath string, signature string")
    edges = spark.createDataFrame([("file:a/userStore.go", "f", "CONTAINS"), ("file:a/userStore.go", "file:b.go", "IMPORTS")], "src string, dst string, type string")
    got = {r["id"]: r for r in postings.documents(PropertyGraph.of(nodes, edges)).collect()}
    assert got["f"]["name"] == "getUser get User a userStore user Store" and got["f"]["signature"].startswith("func getUser(id int) func get User id int")
    assert set(got["file:a/userStore.go"]["content"].split()) >= {"getUser", "get", "User", "b.go"}
