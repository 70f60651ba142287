"""Outside packages that a project's manifest files ask for."""

from __future__ import annotations

import json
import posixpath
import re
import tomllib
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..operators.graph import PropertyGraph
from ..operators.traverse import reach

# Manifest names, and version signs in the order they are looked for.
REQUIREMENTS = "requirements.txt requirements-dev.txt requirements-test.txt requirements-prod.txt requirements_dev.txt requirements_test.txt".split()
MANIFESTS = "go.mod package.json Cargo.toml composer.json Gemfile pyproject.toml Package.swift pom.xml build.gradle gradle.lockfile vcpkg.json".split()
#: Names of files that hold the same kind of manifest.
ALIASES = {"build.gradle.kts": "build.gradle", "buildscript-gradle.lockfile": "gradle.lockfile"}
SIGNS = "=== == >= <= ~= != > <".split()

Found = tuple[str, str, bool]  # name, version, whether for development only


def requirement(spec: str) -> tuple[str, str]:
    """Name and version of ``name[extras]>=1; marker``; the sign stays with the version."""
    spec = re.sub(r"\[[^\]]*\]", "", spec.split(";")[0], count=1).strip()
    sign = next((s for s in SIGNS if s in spec), None)
    at = spec.index(sign) if sign else len(spec)
    return spec[:at].strip(), spec[at:].strip()


def _go(text: str) -> Iterator[Found]:
    """Required modules, with replacements; one for a version goes before one for all."""
    text = re.sub(r"//[^\n]*", "", text)
    lines = []
    for word, block, single in re.findall(r"^\s*(require|replace)\s*(?:\(([^)]*)\)|([^\n(]+))", text, re.M):
        lines += [(word, line.split()) for line in (block or single).splitlines() if line.strip()]
    swaps = {}
    for word, f in lines:
        if word == "replace" and "=>" in f:
            cut = f.index("=>")
            swaps[tuple(f[:cut])] = f[cut + 1 :]
    for word, f in lines:
        if word == "require" and len(f) > 1:
            new = swaps.get((f[0], f[1])) or swaps.get((f[0],)) or f[:2]
            yield new[0], new[1] if len(new) > 1 else f[1], False


def _table(rows, dev: bool = False) -> Iterator[Found]:
    """Rows of a table of versions; ones that aren't text are left out."""
    for name, version in (rows if isinstance(rows, dict) else {}).items():
        if isinstance(version, str):
            yield name, version, dev


def _npm(text: str) -> Iterator[Found]:
    d = json.loads(text)
    # Extensions of an editor and game packages share the file's name.
    if "vscode" in (d.get("engines") or {}) or d.get("contributes") or d.get("unity"):
        return
    yield from _table(d.get("dependencies"))
    yield from _table(d.get("devDependencies"), True)


def _composer(text: str) -> Iterator[Found]:
    d = json.loads(text)
    for key in ("require", "require-dev"):
        yield from (x for x in _table(d.get(key), key != "require") if x[0] != "php" and not x[0].startswith(("ext-", "lib-")))


def _cargo(text: str) -> Iterator[Found]:
    d = tomllib.loads(text)
    for key in ("dependencies", "dev-dependencies", "build-dependencies"):
        for name, value in d.get(key, {}).items():
            spec = value if isinstance(value, dict) else {"version": value}
            # Without a version or a repository it is a local folder.
            if spec.get("version") or spec.get("git"):
                yield name, spec.get("version") or "", key != "dependencies"


def _gems(text: str) -> Iterator[Found]:
    for name, version in re.findall(r"""^[^\S\n]*gem\s+['"]([^'"]+)['"](?:\s*,\s*['"]([^'"]+)['"])?""", text, re.M):
        yield name, version, False


def _for_development(group: str) -> bool:
    return "dev" in group or "test" in group


def _pyproject(text: str) -> Iterator[Found]:
    d = tomllib.loads(text)
    project, poetry = d.get("project", {}), d.get("tool", {}).get("poetry", {})
    if project.get("dependencies") or project.get("optional-dependencies"):
        groups = [(False, project.get("dependencies", []))] + [(_for_development(g), deps) for g, deps in project.get("optional-dependencies", {}).items()]
        yield from ((*requirement(s), dev) for dev, deps in groups for s in deps if requirement(s)[0])
    elif poetry.get("dependencies"):
        tables = [(False, poetry["dependencies"])] + [(_for_development(g), x.get("dependencies", {})) for g, x in poetry.get("group", {}).items()]
        for dev, table in tables:
            for name, value in table.items():
                spec = value if isinstance(value, dict) else {"version": value if isinstance(value, str) else ""}
                if name.lower() != "python":
                    yield name, spec.get("version") or ("git:" + spec["git"] if spec.get("git") else ""), dev


def _requirement_lines(text: str) -> Iterator[str]:
    for line in re.sub(r"\\[ \t]*\n", "", text).splitlines():
        line = re.sub(r"(^|\s+)#.*$", "", line).strip()
        if line:
            yield line


def _requirements(text: str) -> Iterator[Found]:
    for line in _requirement_lines(text):
        name, version = requirement(line.split(" --")[0])
        if not line.startswith("-") and re.fullmatch(r"[a-zA-Z0-9]([a-zA-Z0-9._-]*[a-zA-Z0-9])?", name):
            yield name, version, False


def _xml(text: str) -> ElementTree.Element:
    """Root of a document, its namespaces left off; ValueError if it isn't well formed or declares entities."""
    if "<!ENTITY" in text:
        raise ValueError("entities aren't read")
    try:
        root = ElementTree.fromstring(text.encode())
    except ElementTree.ParseError as e:
        raise ValueError(str(e)) from e
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    return root


def _csproj(text: str) -> Iterator[Found]:
    for e in _xml(text).iterfind("ItemGroup/PackageReference"):
        name = (e.get("Include") or e.get("Update") or "").strip()
        version = (e.get("Version") or e.findtext("Version") or "").strip()
        if name and not any(re.fullmatch(r"\$\(.*\)", x) for x in (name, version)):
            yield name, version, False


def _swift(text: str) -> Iterator[Found]:
    for url, rest in re.findall(r'\.package\s*\(\s*url:\s*"([^"]+)"\s*,\s*((?:from:|exact:|\.upToNextM(?:ajor|inor)|")[^)]*)', text):
        version = re.search(r'"([^"]+)"', rest)
        if version:
            yield url.removesuffix(".git").rsplit("/", 1)[-1] or url, version[1], False


def _maven(text: str) -> Iterator[Found]:
    root = _xml(text)
    known = {e.tag: (e.text or "").strip() for e in root.iterfind("properties/*")}
    for part in ("groupId", "artifactId", "version"):
        if root.findtext(part):
            known[f"project.{part}"] = known[f"pom.{part}"] = root.findtext(part).strip()
    full = lambda e, part: re.sub(r"\$\{([^}]+)\}", lambda m: known.get(m[1], m[0]), (e.findtext(part) or "").strip())
    for where, left_out in (("dependencies/dependency", ("provided", "system")), ("dependencyManagement/dependencies/dependency", ("import",))):
        for e in root.iterfind(where):
            name, scope = f"{full(e, 'groupId')}:{full(e, 'artifactId')}", (e.findtext("scope") or "").strip()
            if "${" not in name and scope not in left_out:
                yield name, full(e, "version"), scope == "test"


def _gradle(text: str) -> Iterator[Found]:
    for kind, group, name, version in re.findall(r"""\b(\w*(?:[iI]mplementation|[aA]pi|[cC]ompileOnly|[rR]untimeOnly|[kK]apt|annotationProcessor|ksp))\s*\(?\s*['"]([^:'"]+):([^:'"]+):([^'"]+)['"]""", text):
        if "$" not in version:
            yield f"{group}:{name}", version, "test" in kind.lower()


def _gradle_lock(text: str) -> Iterator[Found]:
    for line in map(str.strip, text.splitlines()):
        parts = line.split(":", 2)
        if line and not line.startswith("#") and len(parts) == 3:
            version, _, paths = parts[2].partition("=")
            yield ":".join(parts[:2]), version, bool(paths) and all(x.startswith("test") for x in paths.split(","))


def _vcpkg(text: str) -> Iterator[Found]:
    for d in json.loads(text).get("dependencies") or []:
        if isinstance(d, str):
            yield d, "", False
        elif isinstance(d, dict) and d.get("name"):
            yield d["name"], d.get("version>=") or d.get("version") or "", False


PARSERS = {"*.csproj": _csproj, "Package.swift": _swift, "pom.xml": _maven, "build.gradle": _gradle, "gradle.lockfile": _gradle_lock, "vcpkg.json": _vcpkg, "go.mod": _go, "package.json": _npm, "Cargo.toml": _cargo, "composer.json": _composer, "Gemfile": _gems, "pyproject.toml": _pyproject, "requirements.txt": _requirements}


def parse(kind: str, text: str) -> list[Found]:
    """Packages of one manifest; none if it isn't well formed."""
    try:
        return list(PARSERS[kind](text))
    except (ValueError, AttributeError, TypeError):
        return []


def _includes(path: str, text: str) -> Iterator[str]:
    for line in _requirement_lines(text):
        if line.startswith(("-r ", "-c ")):
            yield posixpath.normpath(posixpath.join(posixpath.dirname(path), line[3:].strip()))


def _rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(p, k, *x) for p, k, t in zip(b["filePath"], b["source"], b["content"]) for x in parse(k, t)]
        yield pd.DataFrame(out, columns=["filePath", "source", "name", "version", "devDep"])


def _links(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([(p, x) for p, t in zip(b["filePath"], b["content"]) for x in _includes(p, t)], columns=["from", "to"])


def dependencies(files: DataFrame, depth: int = 10) -> DataFrame:
    """Packages that the manifests at the top of a file tree ask for.

    Takes filePath and content; gives filePath, source, name, version, devDep.
    Requirement files include others, up to ``depth`` steps away, each read once.
    """
    rows = files.filter("content is not null").select("filePath", "content")
    kind = F.when(F.col("filePath").isin(*MANIFESTS), F.col("filePath")).when(F.col("filePath").rlike(r"^[^/]+\.csproj$"), "*.csproj")
    for name, like in ALIASES.items():
        kind = kind.when(F.col("filePath") == name, like)
    top = rows.withColumn("source", kind).filter("source is not null").select("filePath", "source", "content")
    lists = rows.filter(F.col("filePath").rlike(r"\.(txt|in)$"))
    begin = lists.filter(F.col("filePath").isin(*REQUIREMENTS)).select(F.col("filePath").alias("id"))
    more = reach(lists.mapInPandas(_links, "`from` string, `to` string"), begin, depth).select("id")
    read = lists.join(begin.union(more).distinct(), F.col("filePath") == F.col("id"), "left_semi")
    every = top.union(read.select("filePath", F.lit("requirements.txt"), "content"))
    return every.mapInPandas(_rows, "filePath string, source string, name string, version string, devDep boolean")


def settings(files: DataFrame) -> list[tuple[str, str, str]]:
    """How imports are to be read: (language, beginning of an import, what stands for it).

    From the files at the top of the tree: the module of go.mod, paths and base
    of tsconfig or jsconfig (and of the one it extends), PSR-4 folders, a
    project's root namespace, targets of a Swift package. A few files come to
    the driver, each at most a megabyte of text.
    """
    names = F.col("filePath").isin("go.mod", "tsconfig.json", "jsconfig.json", "composer.json", "Package.swift") | F.col("filePath").rlike(r"^[^/]+\.(csproj|json)$")
    own = {r["filePath"]: r["content"] for r in files.filter(names & (F.length("content") <= 1_000_000)).select("filePath", "content").collect()}
    out: list[tuple[str, str, str]] = []

    def read(name: str) -> dict:
        try:
            found = json.loads(own.get(name) or "{}")
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    module = re.search(r"^\s*module\s+(\S+)", own.get("go.mod") or "", re.M)
    if module:
        out.append(("go", module[1] + "/", "./"))
    config = read("tsconfig.json") or read("jsconfig.json")
    options = config.get("compilerOptions") or {}
    if isinstance(config.get("extends"), str) and not options.get("baseUrl") and not options.get("paths"):
        options = read(posixpath.normpath(config["extends"] if config["extends"].endswith(".json") else config["extends"] + ".json")).get("compilerOptions") or {}
    base = posixpath.normpath(options.get("baseUrl") or ".")
    for pattern, targets in sorted((options.get("paths") or {}).items(), key=lambda x: (-len(x[0]), x[0])):
        for t in targets[:1] if isinstance(targets, list) else []:
            path = posixpath.normpath(posixpath.join(base, t.removesuffix("*"))) + ("/" if t.endswith("/*") else "")
            out += [(lang, pattern.removesuffix("*"), path.removeprefix("./")) for lang in ("typescript", "javascript")]
    for prefix, paths in sorted(((read("composer.json").get("autoload") or {}).get("psr-4") or {}).items(), key=lambda x: (-len(x[0]), x[0])):
        path = paths if isinstance(paths, str) else next((p for p in paths if isinstance(p, str)), "")
        out.append(("php", prefix, path.rstrip("/") + "/" if path else ""))
    for name in sorted(n for n in own if n.endswith(".csproj")):
        root = re.search(r"<RootNamespace>([^<]+)</RootNamespace>", own[name] or "")
        if root:
            out.append(("csharp", root[1] + ".", ""))
            break
    swift = own.get("Package.swift") or ""
    for m in re.finditer(r'\.(?:target|executableTarget|testTarget)\s*\(\s*name:\s*"([^"]+)"', swift):
        path = re.search(r'path:\s*"([^"]+)"', swift[m.end() : m.end() + 200])
        out.append(("swift", m[1], path[1] if path else f"Sources/{m[1]}"))
    return out


def apply_settings(source: Column, lang: Column, rules: list[tuple[str, str, str]]) -> Column:
    """An import with the first rule that fits put into effect."""
    out = source
    for language, begin, instead in reversed(rules):
        out = F.when((lang == language) & source.startswith(begin), F.concat(F.lit(instead), F.substring(source, len(begin) + 1, 10_000))).otherwise(out)
    return out


def add_dependencies(graph: PropertyGraph, found: DataFrame) -> PropertyGraph:
    """The graph with a Dependency node per package and source, and an edge from each manifest's file.

    Of a package's rows the greatest version stays, and it is for development
    only if all of them are.
    """
    key = F.concat(F.lit("dep:"), "source", F.lit(":"), "name")
    one = found.groupBy("source", "name").agg(F.max("version").alias("version"), F.min("devDep").alias("devDep"))
    nodes = one.select(key.alias("id"), F.lit("Dependency").alias("label"), F.array(F.lit("Dependency")).alias("labels"), "name", "version", "source", "devDep")
    from_file = graph.by_label("File").select(F.col("id").alias("src"), "filePath")
    edges = found.select("filePath", key.alias("dst")).distinct().join(from_file, "filePath").select("src", "dst", F.lit("DEPENDS_ON").alias("type"))
    return graph.add(nodes, edges.withColumn("edge_id", model.edge_id("src", "dst", "type")))
