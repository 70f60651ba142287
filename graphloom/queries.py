"""Named queries over the relational graph, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph_queries
from .functions import text
from .operators import postings, search, traverse
from .plans.cypher import cypher
from .session import ship
from .sources.relational import relational_graph

#: name: (Cypher, SQL)
CYPHER: dict[str, tuple[str, str]] = {
    "order_desc": ("MATCH (p:Part) WHERE p.size = 7 RETURN p.name AS name, p.price AS price ORDER BY p.price DESC", "SELECT p_name AS name, p_retailprice AS price FROM part WHERE p_size = 7"),
    "order_multi": ("MATCH (p:Part) RETURN p.brand AS brand, id(p) AS id ORDER BY p.brand DESC, p.price, id(p) LIMIT 25", "SELECT p_brand AS brand, 'part:' || p_partkey AS id FROM part ORDER BY p_brand DESC, p_retailprice, 'part:' || p_partkey LIMIT 25"),
    "skip_limit": ("MATCH (c:Customer) RETURN id(c) AS id ORDER BY id(c) SKIP 10 LIMIT 15", "SELECT 'customer:' || c_custkey AS id FROM customer ORDER BY id OFFSET 10 LIMIT 15"),
    "topk_ties": ("MATCH (p:Part) RETURN id(p) AS id, p.size AS size ORDER BY p.size DESC, id(p) LIMIT 12", "SELECT 'part:' || p_partkey AS id, p_size AS size FROM part ORDER BY p_size DESC, id LIMIT 12"),
    "name_contains": ("MATCH (s:Supplier) WHERE toLower(s.name) CONTAINS '5' RETURN s.name AS name", "SELECT s_name AS name FROM supplier WHERE lower(s_name) LIKE '%5%'"),
    "fk_rollup_distinct": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(DISTINCT c.segment) AS segments, count(c) AS n", "SELECT r_name AS region, count(DISTINCT c_mktsegment) AS segments, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
    "edge_rollup_count": ("MATCH (o:Order)-[:SUPPLIED_BY]->(s:Supplier) RETURN s.name AS name, count(o) AS n", "SELECT s_name AS name, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_name"),
    "fn_coalesce": ("MATCH (n:Order) WHERE n.total > 100000 RETURN id(n) AS id, coalesce(n.brand, n.priority, 'none') AS v", "SELECT 'order:' || o_orderkey AS id, o_orderpriority AS v FROM orders WHERE o_totalprice > 100000"),
    "segment_orders": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.segment AS seg, count(o) AS n ORDER BY n DESC", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "node_scan_label": ("MATCH (n:Nation) RETURN n.name AS name", "SELECT n_name AS name FROM nation"),
    "node_lookup_id": ("MATCH (c:Customer) WHERE id(c) = 'customer:7' RETURN c.name AS name, c.segment AS seg", "SELECT c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey = 7"),
    "name_ci": ("MATCH (r:Region) WHERE toLower(r.name) = toLower('Asia') RETURN r.name AS name", "SELECT r_name AS name FROM region WHERE lower(r_name) = 'asia'"),
    "prop_match": ("MATCH (p:Part {brand:'Brand#11'}) RETURN p.name AS name, p.size AS size", "SELECT p_name AS name, p_size AS size FROM part WHERE p_brand = 'Brand#11'"),
    "where_bool": ("MATCH (p:Part) WHERE p.size > 10 AND (p.size < 20 OR p.price > 1500) AND NOT p.brand = 'Brand#11' RETURN id(p) AS id", "SELECT 'part:' || p_partkey AS id FROM part WHERE p_size > 10 AND (p_size < 20 OR p_retailprice > 1500) AND NOT p_brand = 'Brand#11'"),
    "where_starts_contains": ("MATCH (c:Customer) WHERE c.name STARTS WITH 'Customer' AND c.name CONTAINS '9' AND c.name ENDS WITH '5' RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE c_name LIKE 'Customer%' AND c_name LIKE '%9%' AND c_name LIKE '%5'"),
    "is_not_null": ("MATCH (c:Customer) WHERE c.segment IS NOT NULL AND c.brand IS NULL RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL"),
    "hop1_typed": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.name AS nation, r.name AS region", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "hop1_untyped": ("MATCH (n:Nation)-[x]->(r) RETURN type(x) AS kind, count(*) AS n", "SELECT 'IN_REGION' AS kind, count(*) AS n FROM nation"),
    "hop2_chain": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(c) AS n", "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "cyclic_pattern": ("MATCH (o:Order)-[:SUPPLIED_BY]->(s:Supplier)-[:LOCATED_IN]->(n:Nation), (c:Customer)-[:PLACED]->(o), (c)-[:IN_NATION]->(n) RETURN n.name AS nation, count(DISTINCT o) AS orders", "SELECT n_name AS nation, count(DISTINCT o_orderkey) AS orders FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = s_nationkey WHERE c_nationkey = s_nationkey GROUP BY 1"),
    "comma_shared": ("MATCH (c:Customer)-[:PLACED]->(o:Order), (o)-[:HAS_ITEM]->(p:Part {brand:'Brand#11'}) RETURN c.segment AS seg, count(DISTINCT c) AS n", "SELECT c_mktsegment AS seg, count(DISTINCT c_custkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#11' GROUP BY 1"),
    "comma_cross": ("MATCH (a:Region), (b:Region) WHERE a.name < b.name RETURN a.name AS x, b.name AS y", "SELECT a.r_name AS x, b.r_name AS y FROM region a, region b WHERE a.r_name < b.r_name"),
    "optional_match": ("MATCH (o:Order) OPTIONAL MATCH (o)-[:HAS_ITEM]->(p:Part) RETURN id(o) AS id, count(p) AS items", "SELECT 'order:' || o_orderkey AS id, count(l_partkey) AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"),
    "neg_pattern_out": ("MATCH (o:Order) WHERE NOT (o)-[:HAS_ITEM]->() RETURN id(o) AS id", "SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "neg_pattern_in": ("MATCH (p:Part) WHERE NOT (:Order {priority:'1-URGENT', status:'F'})-[:HAS_ITEM]->(p) RETURN id(p) AS id", "SELECT 'part:' || p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"),
    "neg_pattern_urgent": ("MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order {priority:'1-URGENT'}) RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "varlen_1_3": ("MATCH (a:Turn)-[:REPLIES*1..3]->(b:Turn) RETURN a.name AS role, count(*) AS n", "SELECT a.role AS role, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 3 AND a.turn - 1 GROUP BY 1"),
    "path_length": ("MATCH p = (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE c.acctbal > 9900 RETURN c.name AS name, length(p) AS hops, [x IN nodes(p) | x.label][1] AS middle", "SELECT c_name AS name, 2 AS hops, 'Nation' AS middle FROM customer WHERE c_acctbal > 9900"),
    "count_star": ("MATCH (o:Order) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders"),
    "count_distinct": ("MATCH (o:Order)-[:HAS_ITEM]->(p:Part) RETURN o.status AS status, count(DISTINCT p) AS parts, count(p) AS items", "SELECT o_orderstatus AS status, count(DISTINCT l_partkey) AS parts, count(*) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"),
    "sum_avg": ("MATCH (o:Order) RETURN o.priority AS priority, round(sum(o.total)) AS total, round(avg(o.total)) AS mean", "SELECT o_orderpriority AS priority, round(sum(o_totalprice)) AS total, round(avg(o_totalprice)) AS mean FROM orders GROUP BY 1"),
    "min_max": ("MATCH (p:Part) RETURN p.brand AS brand, min(p.price) AS lo, max(p.name) AS last", "SELECT p_brand AS brand, min(p_retailprice) AS lo, max(p_name) AS last FROM part GROUP BY 1"),
    "collect_size": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, size(collect(DISTINCT c.segment)) AS segs, size(collect(c.name)) AS n ORDER BY size(collect(c.name)) DESC, nation LIMIT 7", "SELECT n_name AS nation, CAST(count(DISTINCT c_mktsegment) AS INT) AS segs, CAST(count(*) AS INT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, nation LIMIT 7"),
    "group_by_two": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.segment AS seg, o.status AS status, count(*) AS n", "SELECT c_mktsegment AS seg, o_orderstatus AS status, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"),
    "having_with": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 15 RETURN c.name AS name, n", "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 15"),
    "with_split": ("MATCH (p:Part) WITH split(p.name, ' ')[0] AS word, p WHERE p.size > 25 RETURN word, count(*) AS n ORDER BY n DESC, word LIMIT 5", "SELECT split_part(p_name, ' ', 1) AS word, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1 ORDER BY n DESC, word LIMIT 5"),
    "order_skip_limit": ("MATCH (o:Order) RETURN id(o) AS id, o.total AS total ORDER BY o.total DESC, id SKIP 5 LIMIT 10", "SELECT 'order:' || o_orderkey AS id, o_totalprice AS total FROM orders ORDER BY total DESC, id LIMIT 10 OFFSET 5"),
    "order_hidden": ("MATCH (p:Part) RETURN id(p) AS id ORDER BY p.price DESC, id(p) LIMIT 9", "SELECT 'part:' || p_partkey AS id FROM part ORDER BY p_retailprice DESC, id LIMIT 9"),
    "distinct": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN DISTINCT c.segment AS seg, o.priority AS priority", "SELECT DISTINCT c_mktsegment AS seg, o_orderpriority AS priority FROM customer JOIN orders ON o_custkey = c_custkey"),
    "multi_type_union": ("MATCH (o:Order)-[r:HAS_ITEM|SUPPLIED_BY]->(x) RETURN type(r) AS kind, count(*) AS n", "SELECT 'HAS_ITEM' AS kind, count(*) AS n FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM lineitem"),
    "edge_property": ("MATCH (o:Order)-[r:HAS_ITEM]->(p:Part) WHERE r.quantity > 49 RETURN id(o) AS o, id(p) AS p, r.step AS step", "SELECT 'order:' || l_orderkey AS o, 'part:' || l_partkey AS p, l_linenumber AS step FROM lineitem WHERE l_quantity > 49"),
    "node_inequality": ("MATCH (a:Supplier)-[:LOCATED_IN]->(n:Nation)<-[:LOCATED_IN]-(b:Supplier) WHERE a <> b RETURN n.name AS nation, count(*) AS pairs", "SELECT n_name AS nation, count(*) AS pairs FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey JOIN nation ON n_nationkey = a.s_nationkey GROUP BY 1"),
    "fn_string": ("MATCH (r:Region) RETURN toUpper(r.name) AS u, toLower(r.name) AS l, trim('  x ') AS t, length(r.name) AS n, toString(12) AS s", "SELECT upper(r_name) AS u, lower(r_name) AS l, 'x' AS t, CAST(strlen(r_name) AS INT) AS n, '12' AS s FROM region"),
    "fn_list": ("MATCH (r:Region) RETURN r.name AS name, head([1,2,3]) AS h, last([1,2,3]) AS l, size(tail([1,2,3])) AS t, [x IN [1,2,3] WHERE x > 1 | x * 2][0] AS c", "SELECT r_name AS name, 1 AS h, 3 AS l, 2 AS t, 4 AS c FROM region"),
    "fn_cast": ("MATCH (r:Region) RETURN r.name AS name, toInteger('12abc') AS a, toInteger('x') AS b, coalesce(r.brand, 'none') AS c", "SELECT r_name AS name, CAST(12 AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, 'none' AS c FROM region"),
    "flows_touching": ("MATCH (p:Part {brand:'Brand#11'})<-[:HAS_ITEM]-(o:Order) RETURN DISTINCT id(o) AS id, o.total AS total ORDER BY total DESC, id LIMIT 5", "SELECT DISTINCT 'order:' || o_orderkey AS id, o_totalprice AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#11' ORDER BY total DESC, id LIMIT 5"),
    "top_flows": ("MATCH (o:Order) RETURN id(o) AS id, o.total AS total ORDER BY o.total DESC, id(o) LIMIT 10", "SELECT 'order:' || o_orderkey AS id, o_totalprice AS total FROM orders ORDER BY total DESC, id LIMIT 10"),
    "chain_paths": ("MATCH p = (a:Turn)-[:REPLIES*1..5]->(b:Turn) WHERE a.name = 'user' RETURN id(a) AS id, length(p) AS hops, last([x IN nodes(p) | x.id]) AS target", "SELECT 'turn:' || a.conv_id || '-' || a.turn AS id, CAST(a.turn - b.turn AS INT) AS hops, 'turn:' || b.conv_id || '-' || b.turn AS target FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 5 AND a.turn - 1 WHERE a.role = 'user'"),
    "unused_large": ("MATCH (o:Order) WHERE NOT (o)-[:HAS_ITEM]->() AND o.total > 100000 RETURN id(o) AS id", "SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_totalprice > 100000 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "most_called": ("MATCH (o:Order)-[:HAS_ITEM]->(p:Part) RETURN id(p) AS id, count(o) AS calls ORDER BY calls DESC, id LIMIT 10", "SELECT 'part:' || l_partkey AS id, count(*) AS calls FROM lineitem GROUP BY 1 ORDER BY calls DESC, id LIMIT 10"),
    "dead_code": ("MATCH (p:Part) WHERE NOT (:Order {priority:'1-URGENT', status:'F'})-[:HAS_ITEM]->(p) AND p.brand STARTS WITH 'Brand#1' AND NOT p.size > 30 RETURN id(p) AS id", "SELECT 'part:' || p_partkey AS id FROM part WHERE p_brand LIKE 'Brand#1%' AND NOT p_size > 30 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"),
    "prefix_cross": ("MATCH (c:Customer)-[:PLACED]->(o:Order)-[:SUPPLIED_BY]->(s:Supplier) WHERE c.segment STARTS WITH 'B' AND NOT s.name ENDS WITH '1' RETURN c.segment AS seg, s.name AS supplier, count(*) AS n", "SELECT c_mktsegment AS seg, s_name AS supplier, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_mktsegment LIKE 'B%' AND NOT s_name LIKE '%1' GROUP BY 1, 2"),
    "chain_depth": ("MATCH p = (a:Turn)-[:REPLIES*1..3]->(b:Turn) RETURN id(a) AS a, id(b) AS b, length(p) AS depth ORDER BY depth DESC, a, b LIMIT 50", "SELECT 'turn:' || a.conv_id || '-' || a.turn AS a, 'turn:' || b.conv_id || '-' || b.turn AS b, CAST(a.turn - b.turn AS INT) AS depth FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 3 AND a.turn - 1 ORDER BY depth DESC, a, b LIMIT 50"),
    "two_expansions": ("MATCH (n:Nation)<-[:IN_NATION]-(c:Customer), (n)<-[:LOCATED_IN]-(s:Supplier) RETURN n.name AS nation, size(collect(DISTINCT c.name)) AS customers, size(collect(DISTINCT s.name)) AS suppliers", "SELECT n_name AS nation, CAST(count(DISTINCT c_name) AS INT) AS customers, CAST(count(DISTINCT s_name) AS INT) AS suppliers FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "order_by_collected": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.name AS name, size(collect(o.status)) AS n ORDER BY size(collect(o.status)) DESC, name LIMIT 10", "SELECT c_name AS name, CAST(count(*) AS INT) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name ORDER BY n DESC, name LIMIT 10"),
    "two_distinct_having": ("MATCH (o:Order)-[:HAS_ITEM]->(p:Part) WITH p.brand AS brand, count(DISTINCT o) AS orders, count(DISTINCT p) AS parts WHERE orders > 20 AND parts > 5 RETURN brand, orders, parts", "SELECT p_brand AS brand, count(DISTINCT l_orderkey) AS orders, count(DISTINCT p_partkey) AS parts FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 20 AND count(DISTINCT p_partkey) > 5"),
    "hop2_or_contains": ("MATCH (c:Customer)-[:PLACED]->(o:Order)-[:HAS_ITEM]->(p:Part) WHERE p.brand CONTAINS '3' OR c.segment CONTAINS 'BUILD' RETURN c.segment AS seg, count(*) AS n", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_brand LIKE '%3%' OR c_mktsegment LIKE '%BUILD%' GROUP BY 1"),
    "reachable_distinct": ("MATCH (a:Turn)-[:REPLIES*1..3]->(b:Turn) WHERE a.name = 'assistant' RETURN DISTINCT id(b) AS id", "SELECT DISTINCT 'turn:' || b.conv_id || '-' || b.turn AS id FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 3 AND a.turn - 1 WHERE a.role = 'assistant'"),
    "pattern_or": ("MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {status:'P'}) OR c.acctbal > 9000 RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR c_acctbal > 9000"),
    "pattern_unanchored": ("MATCH (r:Region) WHERE (:Order {status:'F'})-[:HAS_ITEM]->() AND NOT (:Order {status:'none'})-[:HAS_ITEM]->() RETURN r.name AS name", "SELECT r_name AS name FROM region WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'none')"),
    "varlen_unbounded": ("MATCH (a:Turn)-[:REPLIES*]->(b:Turn) RETURN a.name AS role, count(*) AS n", "SELECT a.role AS role, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY 1"),
}


def _cypher(query: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: cypher(relational_graph(spark, sf_dir), query)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational_graph(spark, sf_dir).label_counts()


def schema_rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational_graph(spark, sf_dir).type_counts()


def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational_graph(spark, sf_dir).degree("PLACED").filter(F.col("id").startswith("customer:"))


def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = relational_graph(spark, sf_dir)
    steps = g.edges_of("REPLIES").select(F.col("src").alias("from"), F.col("dst").alias("to"))
    return traverse.reach(steps, g.nodes.filter("id = 'turn:3-3'").select("id"), 5).select("id", "depth")


def set_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that bought every brand."""
    bought = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    left = bought.select(F.col("o_custkey").alias("owner"), F.col("p_brand").alias("item"))
    right = _table(spark, sf_dir, "part").select(F.lit("all").alias("whole"), F.col("p_brand").alias("item"))
    return traverse.set_containment(left, right).select("owner")


_indexes: dict[tuple[str, str], postings.Index] = {}


def _documents_index(spark: SparkSession, sf_dir: str) -> postings.Index:
    """Postings of all documents, built once for a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        folder = traverse.scratch(spark, "documents-index")
        _indexes[key] = postings.Index(spark, folder).build(_table(spark, sf_dir, "documents"), ["text"], "doc_id", plain=True)
    return _indexes[key]


def bm25_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _documents_index(spark, sf_dir).search("text", "the license", plain=True)
    return found.select(F.col("id").alias("doc_id"), F.round("score", 4).alias("score"))


def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_index(spark, sf_dir).phrase("text", "of the", plain=True).select(F.col("id").alias("doc_id"), "times")


def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    one = p.select(F.lit("price").alias("list_id"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"), F.lit(2.0).alias("weight"))
    two = p.select(F.lit("size").alias("list_id"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"), F.lit(0.0).alias("weight"))
    return search.reciprocal_rank_fusion(one.union(two)).select("id", F.round("score", 6).alias("score"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every vector whose id is divisible by 20, among all."""
    v = _table(spark, sf_dir, "embeddings")
    found = search.vector_top_all(v, v.filter("vec_id % 20 = 0"), 10, 0.0, "vec_id", "embedding")
    return found.select("query", F.col("id").alias("vec_id"), F.round("score", 5).alias("score"))


def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("score"))
    return search.min_max(s).select("s_suppkey", F.round("score", 6).alias("score"))


def cap_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    return search.cap_per(p, "p_name", 3, F.desc("p_retailprice"), "p_partkey").select("p_name", "p_partkey")


def centrality_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degree(spark, sf_dir).select("id", F.round(search.centrality_boost(F.col("degree")), 6).alias("boost"))


def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as communities of the customers' and suppliers' trade graph."""
    o, li = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    pair = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    both = pair.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(pair.select("b", "a", "w"))
    member = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").alias("community"))
    member = member.union(_table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), "s_nationkey"))
    return traverse.modularity(both, member).select(F.round("q", 6).alias("q"))


def clean_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.clean_words(F.col("text")), " ").alias("words"))


def heuristic_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_type").distinct()
    return e.select("event_type", text.flow_label(F.col("event_type")).alias("label"))


def slug_and_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    return p.select("p_partkey", text.slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"), text.token_estimate(F.col("p_name")).alias("tokens"), F.substring(F.sha2(F.concat_ws(":", "p_brand", "p_name"), 256), 1, 24).alias("sha_id"))


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{Nd}_]+'), lambda x: x <> '')"
_LABELS = " ".join(f"WHEN {' OR '.join(f'contains(lower(event_type), {chr(39)}{p}{chr(39)})' for p in ps.split())} THEN '{label}'" for label, ps in text.FLOW_LABELS)
_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)

#: name: (query, SQL)
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "schema_labels": (schema_labels, "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Turn', count(*) FROM conversations"),
    "schema_rels": (schema_rels, "SELECT 'IN_REGION' AS type, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', count(*) FROM customer UNION ALL SELECT 'LOCATED_IN', count(*) FROM supplier UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'HAS_ITEM', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'REPLIES', count(*) FROM conversations WHERE turn > 0"),
    "degree": (degree, "SELECT 'customer:' || o_custkey AS id, count(*) AS degree FROM orders GROUP BY 1"),
    "reachable": (reachable, "WITH RECURSIVE r(turn, depth) AS (SELECT turn, 0 FROM conversations WHERE conv_id = 3 AND turn = 3 UNION ALL SELECT r.turn - 1, depth + 1 FROM r WHERE r.turn > 0 AND depth < 5) SELECT 'turn:3-' || turn AS id, depth FROM r WHERE depth > 0"),
    "set_containment": (set_containment, "SELECT o_custkey AS owner FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING count(DISTINCT p_brand) = (SELECT count(DISTINCT p_brand) FROM part)"),
    "bm25_single": (bm25_single, f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), t AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'license')) AS b FROM w), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db FROM t) SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)), 4) AS score FROM t, s WHERE a > 0 OR b > 0"),
    "bm25_phrase": (bm25_phrase, f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), e AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w) SELECT doc_id, count(*) AS times FROM e WHERE w[i] = 'of' AND w[i + 1] = 'the' GROUP BY 1"),
    "rrf_weighted": (rrf_weighted, "WITH p AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS a, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS b FROM part) SELECT id, round(2.0 / (60 + a) + 1.0 / (60 + b), 6) AS score FROM p"),
    "vector_topk": (vector_topk, "WITH s AS (SELECT q.vec_id AS query, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) SELECT query, vec_id, round(score, 5) AS score FROM s WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY s.score DESC, vec_id) <= 10"),
    "minmax_norm": (minmax_norm, "SELECT s_suppkey, round((s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), 6) AS score FROM supplier"),
    "cap_per_name": (cap_per_name, "SELECT p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) <= 3"),
    "centrality_boost": (centrality_boost, "SELECT 'customer:' || o_custkey AS id, round(least(2.0, 1 + 0.15 * log2(count(*) + 1)), 6) AS boost FROM orders GROUP BY 1"),
    "modularity": (modularity, "WITH p AS (SELECT o_custkey AS a, l_suppkey AS b, count(*) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2), e AS (SELECT c_nationkey AS x, s_nationkey AS y, w FROM p JOIN customer ON c_custkey = a JOIN supplier ON s_suppkey = b), k AS (SELECT x AS c, w, x = y AS same FROM e UNION ALL SELECT y, w, x = y FROM e), g AS (SELECT c, sum(w)::DOUBLE AS k, sum(CASE WHEN same THEN w ELSE 0 END)::DOUBLE AS i FROM k GROUP BY 1) SELECT round((sum(i) - sum(k * k) / sum(k)) / sum(k), 6) AS q FROM g"),
    "clean_query": (clean_query, f"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(text, '([\\p{{Ll}}\\p{{Nd}}])(\\p{{Lu}})', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{Nd}}_]+'), lambda x: x <> '' AND x NOT IN ({_STOPS})), ' ') AS words FROM benchmark"),
    "heuristic_label": (heuristic_label, f"SELECT DISTINCT event_type, CASE WHEN lower(event_type) = 'main' OR lower(event_type) LIKE '%.main' THEN 'Application entry point' {_LABELS} ELSE 'Execution flow' END AS label FROM events"),
    "slug_and_tokens": (slug_and_tokens, "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CAST(floor((strlen(p_name) + 3) / 4) AS BIGINT) AS tokens, substr(sha256(p_brand || ':' || p_name), 1, 24) AS sha_id FROM part"),
}


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


_PLAIN = OTHERS | graph_queries.ALL
QUERIES = {n: _ready(_cypher(c)) for n, (c, _) in CYPHER.items()} | {n: _ready(q) for n, (q, _) in _PLAIN.items()}
ORACLE_SQL = {n: s for n, (_, s) in CYPHER.items()} | {n: s for n, (_, s) in _PLAIN.items() if s}
