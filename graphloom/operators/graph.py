"""Property graph over two DataFrames, nodes and edges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import model


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Add the schema's missing columns as nulls; other columns stay."""
    want = StructType.fromDDL(schema)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in want if f.name not in df.columns]
    return df.select("*", *missing)


@dataclass(frozen=True)
class PropertyGraph:
    """``nodes`` has id and label, ``edges`` edge_id, src, dst and type.

    Parallel edges stay apart by their edge_id.
    """

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        """A graph with all of the model's columns.

        Edges without edge_id get a hash of what they hold and of their number
        among equal ones, so that it is the same wherever it is worked out.
        """
        named = "edge_id" in edges.columns
        nodes = conform(nodes, model.NODE_SCHEMA).withColumn("labels", F.coalesce("labels", F.array("label")))
        edges = conform(edges, model.EDGE_SCHEMA)
        if named:
            return PropertyGraph(nodes, edges)
        plain = [c for c in edges.columns if c not in ("edge_id", "props")]
        equal = Window.partitionBy(*plain, F.to_json("props")).orderBy("src")
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in plain] + [F.coalesce(F.to_json("props"), F.lit("")), F.row_number().over(equal).cast("string")]
        return PropertyGraph(nodes, edges.withColumn("edge_id", model.edge_id(*parts)))

    # Scans and lookups

    @property
    def node_columns(self) -> list[str]:
        return self.nodes.columns

    @property
    def edge_columns(self) -> list[str]:
        return self.edges.columns

    def nodes_with(self, labels: list[str]) -> DataFrame:
        """Nodes of some labels; of all if none is named."""
        return self.nodes.filter(F.col("label").isin(*labels)) if labels else self.nodes

    def edges_with(self, types: list[str]) -> DataFrame:
        return self.edges.filter(F.col("type").isin(*types)) if types else self.edges

    def by_label(self, *labels: str) -> DataFrame:
        return self.nodes.filter(F.col("label").isin(*labels))

    def by_id(self, key: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == key)

    def by_name(self, name: str, label: str | None = None, any_case: bool = False) -> DataFrame:
        found = self.nodes.filter(F.lower("name") == name.lower() if any_case else F.col("name") == name)
        return found.filter(F.col("label") == label) if label else found

    def by_path(self, path: str) -> DataFrame:
        return self.nodes.filter((F.col("filePath") == path) & F.col("label").isin("File", "Folder"))

    def name_contains(self, part: str, limit: int = 10) -> DataFrame:
        return self.nodes.filter(F.lower("name").contains(part.lower())).orderBy("id").limit(limit)

    def edges_of(self, *types: str) -> DataFrame:
        return self.edges.filter(F.col("type").isin(*types)) if types else self.edges

    def neighbors(self, keys: DataFrame, direction: str = "both", *types: str) -> DataFrame:
        """Neighbours of ``keys`` (column id): id, neighbor, edge_id, type; duplicates stay."""
        e = self.edges_of(*types)
        out = e.select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), "edge_id", "type")
        back = e.select(F.col("dst").alias("id"), F.col("src").alias("neighbor"), "edge_id", "type")
        both = out if direction == "out" else back if direction == "in" else out.unionByName(back)
        return both.join(keys.select("id").distinct(), "id", "left_semi")

    # Summaries

    def degree(self, *types: str) -> DataFrame:
        """Number of edge ends at each node that has one."""
        ends = self.edges_of(*types).select(F.explode(F.array("src", "dst")).alias("id"))
        return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))

    def label_counts(self) -> DataFrame:
        return self.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")

    def type_counts(self) -> DataFrame:
        return self.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")

    def property_keys(self) -> DataFrame:
        """Distinct keys with a value on any node, in one pass."""
        plain = [c for c in self.nodes.columns if c not in ("labels", "props")]
        seen = self.nodes.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in plain]).select(F.explode(F.array(*[F.when(F.col(c), F.lit(c)) for c in plain])).alias("key")).filter("key is not null")
        if "props" not in self.nodes.columns:
            return seen.orderBy("key")
        return seen.union(self.nodes.select(F.explode(F.map_keys("props")).alias("key"))).distinct().orderBy("key")

    # Construction and removal

    def add(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> PropertyGraph:
        join = lambda a, b: a if b is None else a.unionByName(b, allowMissingColumns=True)
        return PropertyGraph(join(self.nodes, nodes), join(self.edges, edges))

    def remove(self, keys: DataFrame) -> PropertyGraph:
        """Without the nodes in ``keys`` (column id) and their edges."""
        gone = keys.select("id").distinct()
        e = self.edges
        for end in ("src", "dst"):
            e = e.join(gone.withColumnRenamed("id", end), end, "left_anti")
        return PropertyGraph(self.nodes.join(gone, "id", "left_anti"), e.select(*self.edges.columns))

    def remove_paths(self, *paths: str) -> PropertyGraph:
        return self.remove(self.nodes.filter(F.col("filePath").isin(*paths)))

    def dangling(self) -> DataFrame:
        """Edges with an end that isn't a node."""
        ids = self.nodes.select("id")
        parts = [self.edges.join(ids.withColumnRenamed("id", end), end, "left_anti").select(*self.edges.columns) for end in ("src", "dst")]
        return parts[0].union(parts[1]).dropDuplicates(["edge_id"])

    # Storage

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")

    @staticmethod
    def load(spark: SparkSession, path: str, check: bool = False) -> PropertyGraph:
        g = PropertyGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))
        if check and not g.dangling().isEmpty():
            raise ValueError("an edge has an end that isn't a node")
        return g


def federate(graphs: dict[str, PropertyGraph]) -> PropertyGraph:
    """One graph of several: ids get the repository's key, nodes its name."""

    def own(key: str, g: PropertyGraph) -> PropertyGraph:
        put = lambda c: F.concat(F.lit(f"{key}:"), F.col(c))
        nodes = g.nodes.withColumns({"id": put("id"), "repoName": F.lit(key)})
        return PropertyGraph(nodes, g.edges.withColumns({"src": put("src"), "dst": put("dst"), "edge_id": put("edge_id")}))

    parts = [own(k, g) for k, g in sorted(graphs.items())]
    union = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    return PropertyGraph(reduce(union, [p.nodes for p in parts]), reduce(union, [p.edges for p in parts]))
