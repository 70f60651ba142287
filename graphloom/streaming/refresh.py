"""Incremental refresh: a stream of changed files replaces their nodes and edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import PropertyGraph


def merge_files(graph: PropertyGraph, paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
    """The graph with the nodes of ``paths`` (filePath) replaced.

    Edges that begin in a changed file go; edges that end there stay where
    their end is among the new nodes.
    """
    changed = paths.select("filePath").distinct()
    gone = graph.nodes.join(changed, "filePath", "left_semi").select("id")
    kept_nodes = graph.nodes.join(gone, "id", "left_anti").select(*graph.nodes.columns)
    all_nodes = kept_nodes.unionByName(nodes, allowMissingColumns=True)
    kept = graph.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(all_nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(*graph.edges.columns)
    return PropertyGraph(all_nodes, kept.unionByName(edges, allowMissingColumns=True))


def refresh(stream: DataFrame, root: str, checkpoint: str, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> StreamingQuery:
    """Merge each micro-batch of files into versions ``root/v<batch>`` of a graph.

    ``extract`` turns a batch (filePath and any content) into nodes and edges. A
    batch reads the version before it and writes its own, so a repeated batch
    gives the same version. Begin with a graph saved at ``root/v-1``.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        before = PropertyGraph.load(spark, f"{root}/v{number - 1}")
        merge_files(before, batch, *extract(batch)).save(f"{root}/v{number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one).start()
