"""Communities as nodes: names from their members' folders, sizes, MEMBER_OF edges."""

from __future__ import annotations

from collections.abc import Iterable
from posixpath import basename, dirname

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import text
from .graph import PropertyGraph


def _most(counts: Iterable[tuple[str, int]], but: str = "") -> tuple[str, int]:
    """The most frequent, the first in order among equals; ('', 0) of none."""
    return min(((k, n) for k, n in counts if k != but), key=lambda x: (-x[1], x[0]), default=("", 0))


def _pair(counts: dict[str, int], but: str = "") -> str:
    """The most frequent, with the second if it is half as frequent."""
    best, n = _most(counts.items(), but)
    best, n = (best, n) if best else _most(counts.items())
    second, m = _most(counts.items(), best)
    return f"{best}+{second}" if second and 2 * m >= n else best


def _short(path: str) -> str:
    """Last part of a folder; with its parent where it says nothing by itself."""
    base, up = basename(path), dirname(path)
    return f"{basename(up)}/{base}" if base.lower() in text.GENERIC_DIRS and up not in ("", ".", "/") else base


def candidates(folders: dict[str, int], exported: dict[str, int], size: int, key: str) -> tuple[str, str]:
    """Name of a community from its members' folders, and one of its exported symbols."""
    symbol = _pair(exported) if exported else key
    return name_of(folders, symbol, size, key), symbol


def name_of(folders: dict[str, int], symbol: str, size: int, key: str, taken: str = "") -> str:
    """A name other than ``taken``.

    The folder of most members, but a generic one only if there is no other. Of
    a top-level folder the subfolders count instead; a folder with less than
    half of the members is named with the second.
    """
    if not folders:
        return key
    telling = {d: n for d, n in folders.items() if basename(d).lower() not in text.GENERIC_DIRS}
    best, n = _most((telling or folders).items())
    if "/" not in best and best != "root":
        inner: dict[str, int] = {}
        for d, k in folders.items():
            if d.startswith(best + "/"):
                sub = d[len(best) + 1 :].split("/")[0]
                inner[sub] = inner.get(sub, 0) + k
        told = {d: k for d, k in inner.items() if d.lower() not in text.GENERIC_DIRS} or inner
        if told and _pair(told, taken) != taken:
            return _pair(told, taken)
        return symbol if symbol != taken else key
    base = _short(best)
    if 2 * n >= size and base != taken:
        return base
    second, _ = _most(folders.items(), best)
    if second and f"{base}+{_short(second)}" != taken:
        return f"{base}+{_short(second)}"
    return base if base != taken else symbol


def unique_names(rows: list[tuple[str, dict[str, int], dict[str, int], int]]) -> dict[str, str]:
    """A name for each community (id, folders, exported names, size), in order of id."""
    used: set[str] = set()
    out = {}
    for key, folders, exported, size in rows:
        name, symbol = candidates(folders, exported, size, key)
        if name in used:
            other = name_of(folders, symbol, size, key, name)
            if other != name and other not in used:
                name = other
            elif symbol not in (name, key) and symbol not in used:
                name = symbol
            else:
                name = next((f"{name}-{k}" for k in range(2, 100) if f"{name}-{k}" not in used), name)
        used.add(name)
        out[key] = name
    return out


def apply(graph: PropertyGraph, member: DataFrame, quality: float | None = None) -> PropertyGraph:
    """The graph with a Community node for each community and MEMBER_OF edges.

    ``member`` is (id, community), community a number. The histograms of
    folders and exported names are made in Spark; names come from them on the
    driver, as each must differ from those before it: a few strings a
    community, as many communities as the partition has. Members that aren't
    nodes count only for the size.
    """
    n = graph.nodes.select("id", F.nullif("name", F.lit("")).alias("name"), F.col("filePath").alias("path"), F.coalesce("isExported", F.lit(False)).alias("seen"))
    m = member.select("id", "community").filter("community is not null").distinct()
    full = m.join(n, "id", "left")
    clean = F.regexp_replace(text.path_dir(F.col("path")), r"^(\./|/)", "")
    folder = F.when(F.coalesce("path", F.lit("")) == "", None).when(clean.isin("", "."), "root").otherwise(clean)
    # At most the eight commonest of each kind would name it; all are counted.
    kinds = full.select("community", F.explode(F.array(F.struct(F.lit(0).alias("kind"), folder.alias("value")), F.struct(F.lit(1).alias("kind"), F.when(F.col("seen"), F.col("name")).alias("value")))).alias("x")).select("community", "x.*").filter("value is not null")
    counts = kinds.groupBy("community", "kind", "value").count()
    sizes = m.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    found = counts.toPandas() if not counts.isEmpty() else pd.DataFrame(columns=["community", "kind", "value", "count"])
    by: dict = {}
    for c, kind, value, k in zip(found["community"], found["kind"], found["value"], found["count"]):
        by.setdefault((c, kind), {})[value] = int(k)
    rows = [(f"community:{r['community']}", by.get((r["community"], 0), {}), by.get((r["community"], 1), {}), r["size"]) for r in sorted(sizes.collect(), key=lambda r: r["community"])]
    names = unique_names([(k.replace("community:", "community-"), f, e, n) for k, f, e, n in rows])
    spark = graph.nodes.sparkSession
    nodes = spark.createDataFrame([(k, "Community", names[k.replace("community:", "community-")], n, None if quality is None else round(quality, 3)) for k, _, _, n in rows], "id string, label string, name string, communitySize int, modularity double")
    edges = full.filter("name is not null or path is not null").select(F.col("id").alias("src"), F.concat(F.lit("community:"), F.col("community").cast("string")).alias("dst"), F.lit("MEMBER_OF").alias("type")).withColumn("edge_id", model.edge_id("src", "dst", "type"))
    return PropertyGraph.of(graph.nodes.unionByName(nodes, allowMissingColumns=True), graph.edges.unionByName(edges, allowMissingColumns=True))
