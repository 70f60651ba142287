"""A property graph from source files: structure, symbols and what links them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import text
from ..sources import extract, manifests
from ..sources import files as tree
from . import classes, resolve
from .graph import PropertyGraph
from .traverse import written

# How much of a document is kept, and what types are used.
DOCUMENT_BYTES = 50_000
USABLE = ("Class", "Struct", "Interface", "Trait", "Enum", "Record")


def folders(paths: DataFrame) -> DataFrame:
    """All folders above files (filePath): filePath, parent; null at the root."""
    parts = F.split("filePath", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    every = paths.filter("instr(filePath, '/') > 0").select(F.explode(ups).alias("filePath")).filter("filePath <> ''").distinct()
    return every.withColumn("parent", F.nullif(text.path_dir(F.col("filePath")), F.lit("")))


def structure(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File and Folder nodes and CONTAINS edges of files (filePath, size, language, content).

    Files at the root have no parent. Documents keep their first
    ``DOCUMENT_BYTES`` bytes as content.
    """
    path = F.col("filePath")
    kept = F.make_valid_utf8(F.substring(F.col("content").cast("binary"), 1, DOCUMENT_BYTES).cast("string"))
    file_nodes = found.select(F.concat(F.lit("file:"), path).alias("id"), F.lit("File").alias("label"), text.path_base(path).alias("name"), path, "language", F.col("size").cast("long").alias("size"), F.when(text.is_document_path(path), kept).alias("content"), text.is_test_path(path).alias("isTest"))
    dirs = folders(found)
    dir_nodes = dirs.select(F.concat(F.lit("folder:"), path).alias("id"), F.lit("Folder").alias("label"), text.path_base(path).alias("name"), path)
    up = lambda df, kind: df.select(F.concat(F.lit("folder:"), "parent").alias("src"), F.concat(F.lit(kind), path).alias("dst"), F.lit("CONTAINS").alias("type"))
    below = up(dirs.filter("parent is not null"), "folder:").union(up(found.select("filePath", F.nullif(text.path_dir(path), F.lit("")).alias("parent")).filter("parent is not null"), "file:"))
    return file_nodes.unionByName(dir_nodes, allowMissingColumns=True), below


def symbols(records: DataFrame) -> DataFrame:
    """Symbol nodes of extraction records, one for a qualified name and label in a file.

    Functions in tests aren't exported.
    """
    r = records.filter("kind = 'symbol'")
    test = text.is_test_path(F.col("filePath"))
    rows = r.select(
        model.symbol_id(F.col("label"), F.col("filePath"), F.col("owner"), F.col("name")).alias("id"), "label", "name", F.coalesce("owner", F.lit("")).alias("owner"), "filePath", "language", F.col("line").alias("startLine"), "endLine",
        (F.col("exported") & ~(test & F.col("label").isin("Function", "Method"))).alias("isExported"), test.alias("isTest"), "description", "signature", "parameterCount", "returnType", "parameterTypes",
    )
    cols = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct("startLine", F.coalesce("endLine", F.lit(0)), F.coalesce("signature", F.lit("")))).alias("s")).select("id", "s.*")


def _edges(df: DataFrame, kind: str, **more: Column) -> DataFrame:
    return df.select("src", "dst", F.lit(kind).alias("type"), *[c.alias(k) for k, c in more.items()]).distinct()


def from_files(found: DataFrame) -> PropertyGraph:
    """The graph of files (filePath, content): extraction runs once and is written.

    Nodes are folders, files and symbols; edges CONTAINS, DEFINES, HAS_METHOD,
    HAS_PROPERTY, IMPORTS between files and folders, CALLS, SPAWNS,
    DELEGATES_TO, EXTENDS, IMPLEMENTS, USES and ACCESSES. Files without a known
    language have a node and no symbols; a null path or an empty table gives
    nothing. Of files that repeat a path the one with the greatest content counts.
    """
    one = found.filter("filePath is not null").groupBy("filePath").agg(F.max("content").alias("content"))
    listed = one.withColumns({"language": tree.language(F.col("filePath")), "size": F.coalesce(F.octet_length("content"), F.lit(0))})
    records = written(extract.extract(one))
    file_nodes, contains = structure(listed)
    s = written(symbols(records))
    file_of = F.concat(F.lit("file:"), F.col("filePath"))
    edges = [contains, _edges(s.select(file_of.alias("src"), F.col("id").alias("dst")), "CONTAINS"), _edges(s.select(file_of.alias("src"), F.col("id").alias("dst")), "DEFINES")]
    # Owners and members: in the same file, else (methods written elsewhere) in the same folder.
    types = s.filter(F.col("label").isin(*USABLE, "Module", "Union")).select(F.col("id").alias("src"), F.col("name").alias("owner"), F.col("filePath").alias("at"), text.path_dir(F.col("filePath")).alias("dir"))
    members = s.filter("owner <> ''").select(F.col("id").alias("dst"), "owner", F.col("label").alias("kind"), "filePath", text.path_dir(F.col("filePath")).alias("dir"))
    owned = members.join(types, ["owner", "dir"]).groupBy("dst", "kind").agg(F.min_by("src", F.struct(F.col("at") != F.col("filePath"), F.col("src"))).alias("src"))
    edges.append(_edges(owned.filter("kind in ('Method', 'Constructor')"), "HAS_METHOD"))
    edges.append(_edges(owned.filter("kind = 'Property'"), "HAS_PROPERTY"))
    # Imports, as the project's settings say they are to be read.
    rules = manifests.settings(one)
    imp = records.filter("kind = 'import'").withColumn("imp", F.xxhash64("filePath", "name", "receiver", "line"))
    targets = written(resolve.imports(imp.select("imp", F.col("filePath").alias("file"), manifests.apply_settings(F.col("name"), F.col("language"), rules).alias("source"), "language"), listed.select(F.col("filePath").alias("path"))))
    pairs = imp.join(targets, "imp").filter("filePath <> path").select(F.col("filePath").alias("file"), F.col("path").alias("target")).distinct()
    edges.append(_edges(pairs.select(F.concat(F.lit("file:"), "file").alias("src"), F.concat(F.lit("file:"), "target").alias("dst")), "IMPORTS"))
    edges.append(_edges(resolve.folder_imports(pairs).filter("src <> '' and dst <> ''").select(F.concat(F.lit("folder:"), "src").alias("src"), F.concat(F.lit("folder:"), "dst").alias("dst")), "IMPORTS"))
    # Calls, with receivers' types and aliases; what goes to unresolved Go imports is left out.
    external = imp.filter("language = 'go'").join(targets.select("imp"), "imp", "left_anti").select("filePath", "receiver").distinct()
    known = records.filter("kind = 'binding'").groupBy("filePath", F.col("owner"), F.col("name").alias("receiver")).agg(F.min("other").alias("receiverType"))
    alias = imp.filter("receiver <> other").groupBy("filePath", F.col("receiver").alias("name")).agg(F.min("other").alias("original"))
    within = s.filter(F.col("label").isin(*extract.FUNCTIONS)).select("filePath", F.when(F.col("owner") == "", F.col("name")).otherwise(F.concat_ws(".", "owner", "name")).alias("owner"), F.col("id").alias("src")).groupBy("filePath", "owner").agg(F.min("src").alias("src"))
    asked = records.filter("kind in ('call', 'spawn', 'delegate')").select("kind", "filePath", "name", "receiver", "owner").distinct()
    asked = asked.join(external, ["filePath", "receiver"], "left_anti").join(within, ["filePath", "owner"])
    asked = asked.join(known, ["filePath", "owner", "receiver"], "left").join(alias, ["filePath", "name"], "left")
    asked = written(asked.withColumn("call", F.sha2(F.concat_ws("|", "kind", "filePath", "owner", "receiver", "name"), 256)))
    best = resolve.calls(asked.select("call", F.col("name").alias("callee"), "original", F.col("filePath").alias("file"), "receiver", "receiverType"), s.select("id", "name", "label", F.col("filePath").alias("file"), "owner"), pairs)
    met = written(asked.join(best, "call").join(s.select("id", "label", F.col("owner").alias("of")), "id").withColumnRenamed("id", "dst"))
    edges.append(_edges(resolve.kept_calls(met), "CALLS"))
    edges.append(_edges(met.filter("kind = 'spawn'"), "SPAWNS"))
    edges.append(_edges(resolve.kept_delegates(met), "DELEGATES_TO"))
    # Heritage, uses, accesses.
    child = s.filter(F.col("label").isin(*USABLE)).select("filePath", F.col("name"), F.col("id").alias("child")).groupBy("filePath", "name").agg(F.min("child").alias("child"))
    parents = classes.heritage(records.filter("kind = 'heritage'").select("filePath", "name", F.col("other").alias("parentName"), F.col("label").alias("kind")).join(child, ["filePath", "name"]).select("child", "parentName", "kind"), s.select("id", "name", "label"))
    edges.append(parents.select(F.col("child").alias("src"), F.col("parent").alias("dst"), "type").distinct())
    uses = records.filter("kind = 'binding'").join(within, ["filePath", "owner"]).select(F.col("src").alias("ref"), F.col("other").alias("name")).distinct()
    edges.append(_edges(resolve.first_by_name(uses, s, *USABLE).select(F.col("ref").alias("src"), F.col("id").alias("dst")), "USES"))
    sets = records.filter("kind = 'assignment'").join(within, ["filePath", "owner"]).select(F.col("src").alias("ref"), "name").distinct()
    accesses = _edges(resolve.first_by_name(sets, s, "Property").select(F.col("ref").alias("src"), F.col("id").alias("dst")), "ACCESSES", accessKind=F.lit("write"))
    every = edges[0].select("src", "dst", "type")
    for e in edges[1:]:
        every = every.unionByName(e.select("src", "dst", "type"))
    every = every.filter("src <> dst").distinct().unionByName(accesses.filter("src <> dst"), allowMissingColumns=True).withColumn("edge_id", model.edge_id("src", "dst", "type"))
    g = PropertyGraph.of(file_nodes.unionByName(s.drop("owner"), allowMissingColumns=True), written(every))
    inferred = classes.inferred_interfaces(g).select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit("IMPLEMENTS").alias("type")).withColumn("edge_id", model.edge_id("src", "dst", "type"))
    return PropertyGraph.of(g.nodes, g.edges.unionByName(inferred, allowMissingColumns=True))
