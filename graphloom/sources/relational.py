"""Relational tables as a property graph.

A pattern on some labels or types reads only their tables.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import PropertyGraph


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, *cols: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.concat_ws("-", *[F.col(c).cast("string") for c in cols]))


#: Properties of the nodes and edges beside the common ones.
NODE_PROPS = {"segment": "string", "acctbal": "double", "brand": "string", "kind": "string", "size": "int", "price": "double", "status": "string", "priority": "string", "total": "double", "date": "timestamp", "value": "double"}
EDGE_PROPS = {"step": "int", "quantity": "double", "amount": "double"}
NODES, EDGES = ["id", "label", "name", *NODE_PROPS], ["edge_id", "src", "dst", "type", *EDGE_PROPS]


class RelationalGraph(PropertyGraph):
    """The tables' graph; a table is read when a label or type asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        nodes, edges = _sources()
        for name, value in (("_table", lambda name: _table(spark, sf_dir, name)), ("_node_sources", nodes), ("_edge_sources", edges)):
            object.__setattr__(self, name, value)

    node_columns, edge_columns = NODES, EDGES

    @cached_property
    def nodes(self) -> DataFrame:
        return self.nodes_with([])

    @cached_property
    def edges(self) -> DataFrame:
        return self.edges_with([])

    def nodes_with(self, labels: list[str]) -> DataFrame:
        chosen = [x for x in labels or self._node_sources if x in self._node_sources]
        parts = [self._node(x) for x in chosen]
        return reduce(DataFrame.union, parts) if parts else self._node("Region").filter("false")

    def edges_with(self, types: list[str]) -> DataFrame:
        chosen = [x for x in types or self._edge_sources if x in self._edge_sources]
        parts = [self._edge(x) for x in chosen]
        return reduce(DataFrame.union, parts) if parts else self._edge("IN_REGION").filter("false")

    def _node(self, label: str) -> DataFrame:
        table, key, name, props = self._node_sources[label]
        own = [F.col(props[p]).cast(t).alias(p) if p in props else F.lit(None).cast(t).alias(p) for p, t in NODE_PROPS.items()]
        return self._table(table).select(key.alias("id"), F.lit(label).alias("label"), F.col(name).cast("string").alias("name"), *own)

    def _edge(self, kind: str) -> DataFrame:
        table, key, src, dst, props = self._edge_sources[kind]
        df = self._table(table)
        if kind == "SUPPLIES":
            df = df.select("l_suppkey", "l_partkey").distinct()
        elif kind == "REPLIES":
            df = df.filter("turn > 0")
        own = [F.col(props[p]).cast(t).alias(p) if p in props else F.lit(None).cast(t).alias(p) for p, t in EDGE_PROPS.items()]
        return df.select(_id(kind, *key).alias("edge_id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), *own)


def _sources() -> tuple[dict, dict]:
    """By label: table, id, name, properties. By type: table, key, ends, properties."""
    nodes = {
        "Region": ("region", _id("region", "r_regionkey"), "r_name", {}),
        "Nation": ("nation", _id("nation", "n_nationkey"), "n_name", {}),
        "Customer": ("customer", _id("customer", "c_custkey"), "c_name", {"segment": "c_mktsegment", "acctbal": "c_acctbal"}),
        "Supplier": ("supplier", _id("supplier", "s_suppkey"), "s_name", {"acctbal": "s_acctbal"}),
        "Part": ("part", _id("part", "p_partkey"), "p_name", {"brand": "p_brand", "kind": "p_type", "size": "p_size", "price": "p_retailprice"}),
        "Order": ("orders", _id("order", "o_orderkey"), "o_orderkey", {"status": "o_orderstatus", "priority": "o_orderpriority", "total": "o_totalprice", "date": "o_orderdate"}),
        "Event": ("events", _id("event", "event_id"), "event_type", {"value": "value", "date": "ts"}),
        "Turn": ("conversations", _id("turn", "conv_id", "turn"), "role", {}),
    }
    before = F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - 1).cast("string"))
    edges = {
        "IN_REGION": ("nation", ["n_nationkey"], _id("nation", "n_nationkey"), _id("region", "n_regionkey"), {}),
        "IN_NATION": ("customer", ["c_custkey"], _id("customer", "c_custkey"), _id("nation", "c_nationkey"), {}),
        "LOCATED_IN": ("supplier", ["s_suppkey"], _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), {}),
        "PLACED": ("orders", ["o_orderkey"], _id("customer", "o_custkey"), _id("order", "o_orderkey"), {}),
        "HAS_ITEM": ("lineitem", ["l_orderkey", "l_linenumber"], _id("order", "l_orderkey"), _id("part", "l_partkey"), {"step": "l_linenumber", "quantity": "l_quantity", "amount": "l_extendedprice"}),
        "SUPPLIED_BY": ("lineitem", ["l_orderkey", "l_linenumber"], _id("order", "l_orderkey"), _id("supplier", "l_suppkey"), {}),
        "SUPPLIES": ("lineitem", ["l_suppkey", "l_partkey"], _id("supplier", "l_suppkey"), _id("part", "l_partkey"), {}),
        "REPLIES": ("conversations", ["conv_id", "turn"], _id("turn", "conv_id", "turn"), before, {}),
    }
    return nodes, edges


def relational_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts, orders, events and turns with their edges."""
    return RelationalGraph(spark, sf_dir)


def call_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The trade as calls: customers and orders are functions, parts methods.

    A customer calls its orders, an order its parts, one edge a line; returned
    lines are unsure (confidence 0.4). A part's file is its brand's, a
    customer's its market segment's.
    """
    t = lambda name: _table(spark, sf_dir, name)
    node = lambda df, key, label, name, path: df.select(key.alias("id"), F.lit(label).alias("label"), name.alias("name"), path.alias("filePath"))
    nodes = node(t("customer"), _id("customer", "c_custkey"), "Function", F.col("c_name"), F.concat(F.lit("segments/"), F.lower("c_mktsegment"), F.lit("/customers.py")))
    nodes = nodes.union(node(t("orders"), _id("order", "o_orderkey"), "Function", F.col("o_orderkey").cast("string"), F.concat(F.lit("orders/"), F.substring("o_orderpriority", 1, 1), F.lit("/order.py"))))
    nodes = nodes.union(node(t("part"), _id("part", "p_partkey"), "Method", F.col("p_name"), F.concat(F.lit("parts/"), F.col("p_brand"), F.lit("/part.py"))))
    edge = lambda df, kind, key, src, dst, sure: df.select(_id(kind, *key).alias("edge_id"), src.alias("src"), dst.alias("dst"), F.lit("CALLS").alias("type"), sure.alias("confidence"))
    edges = edge(t("orders"), "PLACED", ["o_orderkey"], _id("customer", "o_custkey"), _id("order", "o_orderkey"), F.lit(None).cast("double"))
    edges = edges.union(edge(t("lineitem"), "HAS_ITEM", ["l_orderkey", "l_linenumber"], _id("order", "l_orderkey"), _id("part", "l_partkey"), F.when(F.col("l_returnflag") == "R", 0.4).otherwise(0.5 + F.col("l_linenumber") / 100)))
    return PropertyGraph.of(nodes, edges)


def class_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nations as classes that extend their suppliers, whose methods are the parts they supply.

    Suppliers with a balance above 5,000 are classes, the others interfaces.
    Nations' languages go round python, java and rust by key.
    """
    t = lambda name: _table(spark, sf_dir, name)
    name = lambda c: F.col(c).alias("name")
    lang = F.element_at(F.array(F.lit("python"), F.lit("java"), F.lit("rust")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    nodes = t("nation").select(_id("nation", "n_nationkey").alias("id"), F.lit("Class").alias("label"), name("n_name"), lang.alias("language"))
    kind = F.when(F.col("s_acctbal") > 5000, "Class").otherwise("Interface")
    nodes = nodes.union(t("supplier").select(_id("supplier", "s_suppkey"), kind, name("s_name"), F.lit(None)))
    nodes = nodes.union(t("part").select(_id("part", "p_partkey"), F.lit("Method"), name("p_name"), F.lit(None)))
    edges = t("supplier").select(_id("nation", "s_nationkey").alias("src"), _id("supplier", "s_suppkey").alias("dst"), F.lit("EXTENDS").alias("type"), F.col("s_suppkey").cast("int").alias("step"))
    own = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    edges = edges.union(own.select(_id("supplier", "l_suppkey"), _id("part", "l_partkey"), F.lit("HAS_METHOD"), F.lit(None)))
    return PropertyGraph.of(nodes, edges)
