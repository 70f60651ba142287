"""Modules of a graph, its communities, and the calls in, out of and between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import PropertyGraph


def _members(graph: PropertyGraph) -> DataFrame:
    c = graph.by_label("Community").select(F.col("id").alias("dst"), F.col("name").alias("module"))
    n = graph.nodes.select(F.col("id").alias("src"), "name", "filePath")
    return graph.edges_of("MEMBER_OF").select("src", "dst").join(c, "dst").join(n, "src").select("module", F.col("src").alias("id"), "name", "filePath").distinct()


COLS = ["module", "fromName", "fromFile", "toName", "toFile"]


def _calls(graph: PropertyGraph) -> DataFrame:
    """Calls of modules, which may repeat.

    Nodes know their modules and those of their file, so an edge meets its two
    ends and nothing else.
    """
    m = _members(graph)
    n = graph.nodes.select("id", "name", "filePath")
    n = n.join(m.groupBy("id").agg(F.collect_set("module").alias("own"), F.max(F.col("module").isNull()).alias("unnamed")), "id", "left").join(m.groupBy("filePath").agg(F.collect_set("module").alias("near")), "filePath", "left")
    end = lambda key, to: n.select(F.col("id").alias(key), F.col("name").alias(f"{to}Name"), F.col("filePath").alias(f"{to}File"), F.coalesce("own", F.array()).alias(f"{to}Own"), F.coalesce("near", F.array()).alias(f"{to}Near"), F.coalesce("unnamed", F.lit(False)).alias(f"{to}Unnamed"))
    e = graph.edges_of("CALLS").select("src", "dst").join(end("src", "from"), "src").join(end("dst", "to"), "dst")
    mark = lambda kind, modules: F.transform(modules, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("module")))
    inside = F.when(F.col("fromFile") != F.col("toFile"), F.array_intersect("fromOwn", "toOwn")).otherwise(F.array().cast("array<string>"))
    # A module without a name is no file's.
    away = lambda a, b: F.concat(F.array_except(f"{a}Own", f"{b}Near"), F.when(F.col(f"{a}Unnamed"), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    each = F.concat(mark("intra", inside), mark("out", away("from", "to")), mark("in", away("to", "from")))
    return e.select(*COLS[1:], F.explode(each).alias("k")).select("k.module", *COLS[1:], "k.kind")


def _first(found: DataFrame, cap: int) -> DataFrame:
    """The first distinct calls of each module and kind; the rest is dropped before it moves."""
    rank = F.dense_rank().over(Window.partitionBy("module", "kind").orderBy(*COLS[1:]))
    return found.withColumn("_n", rank).filter(F.col("_n") <= cap).drop("_n").distinct()


def calls(graph: PropertyGraph, cap: int | None = None) -> DataFrame:
    """Calls of modules: module, kind, fromName, fromFile, toName, toFile.

    Kinds: ``intra``, between two files by members of one module; ``out`` and
    ``in``, whose other end's file has no member of the module. Each once; with
    ``cap``, out and in calls go up to that many a module, first in order.
    """
    found = _calls(graph)
    if cap is None:
        return found.distinct()
    return found.filter("kind = 'intra'").distinct().union(_first(found.filter("kind <> 'intra'"), cap))


def between(graph: PropertyGraph, cap: int | None = None) -> DataFrame:
    """Number of distinct out calls from module to module: source, target, n.

    A file belongs to the first of its modules by name.
    """
    home = _members(graph).groupBy(F.col("filePath").alias("toFile")).agg(F.min("module").alias("target"))
    e = calls(graph, cap).filter("kind = 'out'").join(home, "toFile").filter("module <> target")
    return e.groupBy(F.col("module").alias("source"), "target").agg(F.count(F.lit(1)).alias("n"))


def pages(graph: PropertyGraph, cap: int = 30) -> DataFrame:
    """A Markdown page a module, with its files and capped calls: module, page.

    Every list of a page is capped, so that a page is a small row.
    """
    part = F.concat(F.lit("- `"), "fromName", F.lit("` ("), "fromFile", F.lit(") -> `"), "toName", F.lit("` ("), "toFile", F.lit(")"))
    found = _first(_calls(graph), cap)
    lines = found.groupBy("module").agg(*[F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, part))), "\n").alias(k) for k in ("intra", "out", "in")])
    files = _members(graph).select("module", "filePath").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("module").orderBy("filePath"))).filter(F.col("_n") <= cap)
    files = files.groupBy("module").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "filePath"))), "\n").alias("files"))
    section = lambda title, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"\n## {title}\n\n"), c, F.lit("\n"))).otherwise("")
    return files.join(lines, "module", "left").select("module", F.concat(F.lit("# "), "module", F.lit("\n"), section("Files", "files"), section("Calls inside", "intra"), section("Calls out", "out"), section("Calls in", "in")).alias("page"))
