"""Refresh of a graph by a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators.graph import PropertyGraph
from graphloom.streaming.refresh import refresh


def test_changed_files_replace_their_nodes(spark, tmp_path):
    nodes = spark.createDataFrame([("a1", "Function", "one", "a"), ("a2", "Function", "two", "a"), ("b1", "Function", "b", "b")], "id string, label string, name string, filePath string")
    edges = spark.createDataFrame([("e1", "a1", "b1", "CALLS"), ("e2", "b1", "a1", "CALLS"), ("e3", "b1", "a2", "CALLS")], "edge_id string, src string, dst string, type string")
    PropertyGraph(nodes, edges).save(f"{tmp_path}/g/v-1")
    spark.createDataFrame([("a", "one new")], "filePath string, content string").write.parquet(f"{tmp_path}/in")

    def extract(batch):
        made = batch.select(F.concat("filePath", F.lit("1")).alias("id"), F.lit("Function").alias("label"), F.col("content").alias("name"), "filePath")
        return made, edges.filter("false")

    stream = spark.readStream.schema("filePath string, content string").parquet(f"{tmp_path}/in")
    q = refresh(stream, f"{tmp_path}/g", f"{tmp_path}/check", extract)
    q.processAllAvailable()
    q.stop()
    g = PropertyGraph.load(spark, f"{tmp_path}/g/v0", check=True)
    assert {(r["id"], r["name"]) for r in g.nodes.collect()} == {("a1", "one new"), ("b1", "b")}
    assert {r["edge_id"] for r in g.edges.collect()} == {"e2"}
