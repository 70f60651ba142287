"""Named queries of the graph measures and of retrieval, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import distance, text
from .operators import classes, communities, embedding, flows, modules, ranking, resolve, search, traverse
from .operators.graph import PropertyGraph
from .sources import files
from .sources.relational import call_graph, class_graph, relational_graph

SIGN_IN = "login session of a request"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as components of the reply graph."""
    g = relational_graph(spark, sf_dir)
    return communities.components(g.by_label("Turn"), g.edges_of("REPLIES"))


def call_graph_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.projection(call_graph(spark, sf_dir)).select("src", "dst", F.round("w", 4).alias("w"))


def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.entry_points(call_graph(spark, sf_dir)).select("id")


def orchestrators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.orchestrators(call_graph(spark, sf_dir))


def flow_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.starts(call_graph(spark, sf_dir))


def _traced(spark: SparkSession, sf_dir: str):
    g, ids = flows.numbered(call_graph(spark, sf_dir))
    kinds = traverse.written(flows.starts(g))
    return g, ids, kinds, flows.traced(g, kinds)


def flow_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, ids, kinds, found = _traced(spark, sf_dir)
    return flows.named(flows.steps_of(flows.named(found, ids, "flow")), ids, "node")


def flow_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, ids, kinds, found = _traced(spark, sf_dir)
    out = flows.importance(g, flows.steps_of(found), kinds)
    return flows.named(out, ids, "flow").withColumn("importance", F.round("importance", 6))


def flow_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, ids, kinds, found = _traced(spark, sf_dir)
    steps = flows.steps_of(found)
    scores = traverse.written(flows.importance(g, steps, kinds))
    return flows.named(flows.page_rank(scores, steps), ids, "flow").withColumn("importance", F.round("importance", 6))


def leiden_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of suppliers and the parts they supply."""
    e = relational_graph(spark, sf_dir).edges_of("SUPPLIES").select("src", "dst", F.lit(1.0).alias("w"))
    both = e.union(e.select("dst", "src", "w"))
    return communities.leiden(both.select(F.col("src").alias("id")), both)


def mro_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes.ambiguities(class_graph(spark, sf_dir))


def scored_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines call a part's name from the file of the part that has their supplier's key."""
    p = _table(spark, sf_dir, "part")
    file = F.concat(F.lit("b/"), "p_brand", F.lit("/"), "p_type", F.lit(".py"))
    symbols = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, "Method").otherwise("Class").alias("label"), file.alias("file"), F.col("p_brand").alias("owner"))
    line = _table(spark, sf_dir, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("callee")), "l_partkey")
    line = line.join(p.select(F.col("p_partkey").alias("l_suppkey"), file.alias("file"), F.col("p_brand").alias("receiverType")), "l_suppkey")
    found = line.select(F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("call"), "callee", F.lit(None).cast("string").alias("original"), "file", F.lit("").alias("receiver"), "receiverType").distinct()
    one = p.select(F.col("p_partkey").alias("k"), file.alias("f"))
    imports = one.select("k", F.col("f").alias("file")).join(one.select((F.col("k") - 1).alias("k"), F.col("f").alias("target")), "k").select("file", "target")
    return resolve.calls(found, symbols, imports).select("call", "id", F.col("score").cast("long").alias("score"))


def range_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part the narrowest price span of its brand's sizes that holds its price."""
    p = _table(spark, sf_dir, "part")
    spans = p.groupBy(F.col("p_brand").alias("file"), "p_size").agg(F.min("p_retailprice").alias("first"), F.max("p_retailprice").alias("last")).withColumnRenamed("p_size", "span")
    points = p.select(F.col("p_partkey").alias("point"), F.col("p_brand").alias("file"), F.col("p_retailprice").alias("line"))
    return traverse.tightest_enclosing(points, spans).select("point", "span")


def suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("src/"), "p_brand", F.lit("/"), "p_size", F.lit(".py")).alias("path"))
    wanted = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("want"), F.concat(F.lit("Brand#1"), F.col("s_suppkey") % 5 + 1, F.lit("/"), F.col("s_suppkey") % 50 + 1, F.lit(".py")).alias("suffix"))
    return resolve.by_suffix(wanted, p.select("path").distinct())


def orphan_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id is no supplier's."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return embedding.orphans(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), s).select(F.col("id").alias("vec_id"))


def vector_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 20 neighbours of at least 0.2 of every vector whose id is divisible by 20."""
    v = _table(spark, sf_dir, "embeddings")
    found = search.vector_top_all(v, v.filter("vec_id % 20 = 0"), 20, 0.2, "vec_id", "embedding")
    return found.select("query", F.col("id").alias("vec_id"), F.round("score", 5).alias("score"))


def vector_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings").withColumnsRenamed({"vec_id": "id", "embedding": "vector"})
    found = ranking.supplement(v.filter("id % 2 = 0"), v, v.filter("id = 2").select("vector").first()[0], 5, 0.0)
    return found.select(F.col("id").alias("vec_id"), F.round("score", 5).alias("score"))


def overlap_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(ranking.overlap_boost("copper small brand", F.concat_ws(" ", "p_name", "p_type", "p_brand")), 4).alias("boost"))


def label_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.element_at(F.array(*map(F.lit, ("Class", "Method", "File", "Folder"))), F.col("p_size") % 4 + 1)
    return _table(spark, sf_dir, "part").select("p_partkey", ranking.label_boost(SIGN_IN, labels).alias("boost"))


def multifield_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _parts(spark, sf_dir)
    return ranking.multi_field(docs, "small copper part", 10).select("id", F.round("score", 6).alias("score"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda c: F.lit(None).cast("string").alias(c)
    return _table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("content"), none("signature"), F.concat(F.lit("parts/"), "p_brand").alias("filePath"), none("description"))


def camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("get"), "s_name", F.lit("ById"))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", text.camel_split(name).alias("words"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type", F.concat("p_name", F.lit(".py"))).alias("path"))
    return p.select("p_partkey", text.path_dir(F.col("path")).alias("dir"), text.path_base(F.col("path")).alias("base"))


def usage_file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.element_at(F.array(*map(F.lit, ("tests", "src", "examples", "docs", "pkg/attest", "__mocks__"))), F.col("p_size") % 6 + 1)
    p = _table(spark, sf_dir, "part").select("p_partkey", F.concat(top, F.lit("/"), F.when(F.col("p_size") % 7 == 0, "x_test.go").otherwise("x.go")).alias("path"))
    return p.filter(~text.is_usage_path(F.col("path"))).select("p_partkey", "path")


def impact(direction: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = call_graph(spark, sf_dir)
        start = g.nodes.filter(F.col("id") == ("customer:7" if direction == "upstream" else "part:7")).select("id")
        return traverse.impact(g, start, direction, 2).select("id", "depth")

    return run


def context_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = call_graph(spark, sf_dir)
    return traverse.context(g, g.nodes.filter("id = 'order:7'").select("id")).select("section", "id")


def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits between a nation's and its region's name."""
    n = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_name", distance.edit_distance(F.col("n_name"), F.col("r_name")).cast("long").alias("edits"))


def skipped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files in folders by size, with endings by brand."""
    name = F.concat(F.lower(F.regexp_replace("p_name", " ", "_")), F.element_at(F.array(*map(F.lit, [".min.js", ".go", "_gen.go", ".PNG", ".py"])), F.col("p_partkey").cast("int") % 5 + 1))
    path = F.concat(F.when(F.col("p_size") % 7 == 0, "vendor/").otherwise("src/"), name)
    p = _table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return p.select("p_partkey", files.is_skipped(F.col("path")).alias("skipped"), files.language(F.col("path")).alias("language"))


def git_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "git@code.example:").otherwise("https://code.example/"), F.lit("team/"), F.col("s_suppkey").cast("string"), F.lit(".git"))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", files.git_import_path(url).alias("path"))


def cat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 4 of every document."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("filePath"), F.col("text").alias("content"))
    return files.cat(d, "2-4").select("filePath", "content", "lineCount")


def embed_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the trade's calls, names of an even length being exported."""
    g = call_graph(spark, sf_dir)
    nodes = g.nodes.withColumn("isExported", F.length("name") % 2 == 0)
    return embedding.priorities(PropertyGraph(nodes, g.edges))


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.texts(call_graph(spark, sf_dir)).select("id", "hash")


def stale_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a stored vector, or whose text differs from the one stored."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    stored = d.filter("id % 3 > 0").select("id", F.sha2(F.when(F.col("id") % 3 == 1, F.col("text")).otherwise(""), 256).alias("hash"))
    return embedding.stale(d.select("id", F.sha2("text", 256).alias("hash")), stored).select("id", "why")


def _trade_modules(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Segments, priorities and brands as modules of the trade's calls."""
    t = lambda name: _table(spark, sf_dir, name)
    of = lambda df, kind, key, by: df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("src"), F.col(by).alias("module"))
    m = of(t("customer"), "customer", "c_custkey", "c_mktsegment").union(of(t("orders"), "order", "o_orderkey", "o_orderpriority")).union(of(t("part"), "part", "p_partkey", "p_brand"))
    m = m.withColumn("dst", F.concat(F.lit("module:"), "module"))
    edges = m.select(F.concat(F.lit("member:"), "src").alias("edge_id"), "src", "dst", F.lit("MEMBER_OF").alias("type"))
    return call_graph(spark, sf_dir).add(m.select(F.col("dst").alias("id"), F.lit("Community").alias("label"), F.col("module").alias("name")).distinct(), edges)


def module_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.between(_trade_modules(spark, sf_dir))


def module_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.pages(_trade_modules(spark, sf_dir))


_FILE = "'b/' || p_brand || '/' || p_type || '.py'"
_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {}))"

#: name: (query, SQL or None)
ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "edit_distance": (edit_distance, "SELECT n_name, damerau_levenshtein(n_name, r_name)::BIGINT AS edits FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "skipped_paths": (skipped_paths, "SELECT p_partkey, p_size % 7 = 0 OR p_partkey % 5 IN (0, 2, 3) AS skipped, CASE p_partkey % 5 WHEN 0 THEN 'javascript' WHEN 1 THEN 'go' WHEN 2 THEN 'go' WHEN 3 THEN '' ELSE 'python' END AS language FROM part"),
    "git_addresses": (git_addresses, "SELECT s_suppkey, 'code.example/team/' || s_suppkey AS path FROM supplier"),
    "cat_lines": (cat_lines, "WITH d AS (SELECT doc_id::VARCHAR AS filePath, text, str_split(text, chr(10)) AS l FROM documents) SELECT filePath, array_to_string(l[least(2, len(l)):least(4, len(l))], chr(10)) AS content, (len(l) - CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 0 END)::BIGINT AS lineCount FROM d"),
    "embed_priority": (embed_priority, "WITH e AS (SELECT 'customer:' || o_custkey AS a, 'order:' || o_orderkey AS b FROM orders UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem), g AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY 1), n AS (SELECT 'customer:' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'order:' || o_orderkey, o_orderkey::VARCHAR FROM orders UNION ALL SELECT 'part:' || p_partkey, p_name FROM part), x AS (SELECT n.id, length(name) % 2 = 0 AS p, coalesce(d, 0) AS d FROM n LEFT JOIN g ON g.id = n.id) SELECT id, CASE WHEN p AND d >= 5 THEN 1 WHEN p AND d >= 2 THEN 2 ELSE 3 END AS priority, p OR d >= 3 AS embed FROM x"),
    "embedding_texts": (embedding_texts, None),
    "stale_vectors": (stale_vectors, "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'changed' END AS why FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 3 = 2 AND coalesce(text, '') <> '')"),
    "module_links": (module_links, "SELECT c_mktsegment AS source, o_orderpriority AS target, count(DISTINCT (c_name, o_orderkey)) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2 UNION ALL SELECT o_orderpriority, p_brand, count(DISTINCT (o_orderkey, p_name)) FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"),
    "module_pages": (module_pages, None),
    "components": (components, "SELECT 'turn:' || conv_id || '-' || turn AS id, min('turn:' || conv_id || '-' || turn) OVER (PARTITION BY conv_id) AS component FROM conversations"),
    "call_graph_projection": (call_graph_projection, "WITH e AS (SELECT 'customer:' || o_custkey AS a, 'order:' || o_orderkey AS b, 1.0::DOUBLE AS w FROM orders UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, CASE WHEN l_returnflag = 'R' THEN 0.4 ELSE 0.5 + l_linenumber / 100 END FROM lineitem), b AS (SELECT * FROM e UNION ALL SELECT b, a, w FROM e) SELECT a AS src, b AS dst, round(sum(w), 4) AS w FROM b GROUP BY 1, 2"),
    "entry_points": (entry_points, "SELECT 'customer:' || c_custkey AS id FROM customer UNION ALL SELECT 'part:' || p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)"),
    "orchestrators": (orchestrators, "SELECT 'order:' || o_orderkey AS id, 1::BIGINT AS callers, count(*) AS callees FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(*) >= 4"),
    "flow_starts": (flow_starts, "SELECT 'customer:' || c_custkey AS id, 'entry' AS kind FROM customer UNION ALL SELECT 'part:' || p_partkey, 'entry' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT 'order:' || o_orderkey, 'orchestrator' FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(*) >= 4"),
    "flow_trace": (flow_trace, None),
    "flow_importance": (flow_importance, None),
    "flow_pagerank": (flow_pagerank, None),
    "leiden_members": (leiden_members, None),
    "mro_ambiguity": (mro_ambiguity, "WITH o AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), m AS (SELECT s_nationkey AS nk, p_name, p_partkey AS p, min(s_suppkey) AS s, max(CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END) AS solid FROM o JOIN supplier ON s_suppkey = s JOIN part ON p_partkey = p GROUP BY 1, 2, 3), g AS (SELECT nk, p_name, count(*) AS n, sum(solid) AS c, min(s) AS first, min(CASE WHEN solid = 1 THEN 'part:' || p END) AS one FROM m GROUP BY 1, 2 HAVING count(*) > 1) SELECT 'nation:' || nk AS child, p_name AS method_name, n, CASE WHEN nk % 3 = 2 THEN NULL WHEN nk % 3 = 1 THEN CASE WHEN c = 1 THEN one END ELSE (SELECT min('part:' || m.p) FROM m WHERE m.nk = g.nk AND m.p_name = g.p_name AND m.s = g.first) END AS resolved FROM g"),
    "scored_best_match": (scored_best_match, f"WITH p AS (SELECT *, {_FILE} AS f, 'b/' || p_brand AS d FROM part), i AS (SELECT DISTINCT a.f AS f, b.f AS t, b.d AS td FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1), k AS (SELECT DISTINCT x.p_name AS name, y.p_brand AS brand, y.f AS f, y.d AS d FROM lineitem JOIN p x ON x.p_partkey = l_partkey JOIN p y ON y.p_partkey = l_suppkey), s AS (SELECT k.name, k.f, p_partkey AS id, 10 * (p_size > 25)::INT + 100 * (p.f = k.f)::INT + CASE WHEN (k.f, p.f) IN (SELECT (f, t) FROM i) THEN 50 WHEN (k.f, p.d) IN (SELECT (f, td) FROM i) THEN 45 ELSE 0 END + 40 * (p.d = k.d AND p.f <> k.f)::INT + 200 * (p.p_brand = k.brand)::INT AS score FROM k JOIN p ON p.p_name = k.name), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name, f ORDER BY score DESC, id) = 1) SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS call, id, score::BIGINT AS score FROM lineitem JOIN p x ON x.p_partkey = l_partkey JOIN p y ON y.p_partkey = l_suppkey JOIN b ON b.name = x.p_name AND b.f = y.f"),
    "range_enclosing": (range_enclosing, "WITH s AS (SELECT p_brand, p_size AS span, min(p_retailprice) AS a, max(p_retailprice) AS b FROM part GROUP BY 1, 2) SELECT p_partkey AS point, span FROM part JOIN s USING (p_brand) WHERE p_retailprice BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY b - a, span) = 1"),
    "suffix_join": (suffix_join, "WITH f AS (SELECT DISTINCT 'src/' || p_brand || '/' || p_size || '.py' AS path FROM part) SELECT s_suppkey AS want, path FROM supplier JOIN f ON path = 'src/Brand#1' || (s_suppkey % 5 + 1) || '/' || (s_suppkey % 50 + 1) || '.py'"),
    "orphan_anti": (orphan_anti, "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT s_suppkey FROM supplier)"),
    "vector_min_score": (vector_min_score, "WITH s AS (SELECT q.vec_id AS query, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) SELECT query, vec_id, round(score, 5) AS score FROM s WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY s.score DESC, vec_id) <= 20"),
    "vector_supplement": (vector_supplement, f"SELECT vec_id, round(c, 5) AS score FROM (SELECT vec_id, c FROM (SELECT vec_id, {_COS.format(2)} AS c FROM embeddings) WHERE c >= 0 ORDER BY c DESC, vec_id LIMIT 25) WHERE vec_id % 2 <> 0 ORDER BY c DESC, vec_id LIMIT 5"),
    "overlap_boost": (overlap_boost, "SELECT p_partkey, round(1 + 0.15 * len(list_intersect(regexp_split_to_array(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^a-z0-9_]+'), ['copper', 'small', 'brand'])), 4)::DOUBLE AS boost FROM part"),
    "label_boost": (label_boost, "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 1.25 WHEN 1 THEN 0.95 WHEN 2 THEN 0.85 ELSE 1.0 END::DOUBLE AS boost FROM part"),
    "multifield_rrf": (multifield_rrf, None),
    "camel_split": (camel_split, "SELECT s_suppkey, regexp_replace('get' || s_name || 'ById', '([a-z0-9])([A-Z])', '\\1 \\2', 'g') AS words FROM supplier"),
    "path_parts": (path_parts, "SELECT p_partkey, p_brand || '/' || p_type AS dir, p_name || '.py' AS base FROM part"),
    "usage_file_filter": (usage_file_filter, "SELECT p_partkey, CASE p_size % 6 WHEN 1 THEN 'src' ELSE 'pkg/attest' END || '/x.go' AS path FROM part WHERE p_size % 6 IN (1, 4) AND p_size % 7 <> 0"),
    "impact_up": (impact("upstream"), "SELECT 'order:' || o_orderkey AS id, 1 AS depth FROM orders WHERE o_custkey = 7 UNION SELECT 'part:' || l_partkey, 2 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 7"),
    "impact_down": (impact("downstream"), "SELECT 'order:' || l_orderkey AS id, 1 AS depth FROM lineitem WHERE l_partkey = 7 UNION SELECT 'customer:' || o_custkey, 2 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey = 7"),
    "context_sections": (context_sections, "SELECT 'callers' AS section, 'customer:' || o_custkey AS id FROM orders WHERE o_orderkey = 7 UNION SELECT 'callees', 'part:' || l_partkey FROM lineitem WHERE l_orderkey = 7"),
}
