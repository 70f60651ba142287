"""Ranked retrieval over a graph: boosts, multi-field search and the query tool."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import search
from .graph import PropertyGraph
from .traverse import written

# What is searched and how fields weigh for identifiers and for prose.
SEARCHED = "File Function Class Method Interface Struct Enum Const Variable Module Namespace Trait TypeAlias Property Constructor Delegate Record Macro Typedef Union Dependency".split()
FIELD_WEIGHTS = {"name": (3.0, 1.5), "content": (1.0, 2.0), "name cleaned": (1.5, 1.5), "signature": (1.0, 1.5), "filePath": (0.5, 1.0), "description": (1.5, 2.0)}

# Domains by the query's words; path parts (signature parts too), name prefixes, name suffixes.
DOMAINS = {
    "http": (
        "handler http route endpoint api controller servlet middleware",
        "handler server route controller view middleware endpoint api servlet resource url router startup httpd",
        "handle serve register route dispatch respond controller endpoint configure map action do_ doget dopost",
        "controller servlet resource handler view viewset middleware mapping endpoint router",
    ),
    "db": (
        "database model schema migration repository store dao orm query",
        "model schema migration repositor store dao entit database db persist",
        "model schema migrat repositor store dao entity record table",
        "model schema repository store dao entity record migration",
    ),
    "config": (
        "config configuration setting environment env builder build configurer customizer bean parser wire httpsecurity websecurity",
        "config configuration setting env builder configurer customizer bean parser",
        "config configure setting option env apply httpsecurity websecurity springsecurityfilterchain",
        "config settings options opts configuration builder builders configurer configurers customizer customizers parser filterchain",
    ),
    "security": (
        "auth authentication authorization security login logout token credential permission access advisor interceptor",
        "auth authentication authorization security context credential token access intercept filter provider repository firewall",
        "auth authenticate authorization authorize login logout securitycontext access token credential",
        "filter manager provider repository handler interceptor evaluator context firewall",
    ),
}
PATH_FACTOR, SIGNATURE_FACTOR, AFFIX_FACTOR = 1.5, 1.3, 1.5
SIGN_IN = ("authentication context session provider filter", "usernamepassword securitycontext savedrequest", "filter manager provider repository handler", "filter manager provider repository handler session")

# Intents; a query has one if a word of each group is in it.
INTENTS = {
    "sign-in": [["authenticate", "authenticated", "authentication", "login"], ["security context", "context", "session", "persist", "request"]],
    "dispatch": [["dispatcherservlet", "controller method", "http request", "response body", "write the response"]],
    "lifecycle": [["application context", "container"], ["refresh", "lifecycle", "event", "publish"]],
}
INTENT_WORDS = {
    "sign-in": "authentication filter authentication processing filter provider manager security context holder filter repository session success handler failure handler event publisher username password",
    "dispatch": "dispatcher servlet DispatcherServlet HandlerExecutionChain handler execution chain HandlerMapping handler mapping HandlerAdapter handler adapter RequestMappingHandlerMapping RequestMappingHandlerAdapter InvocableHandlerMethod RequestResponseBodyMethodProcessor request mapping invocable handler method request response body request response body method processor",
    "lifecycle": "AbstractApplicationContext ApplicationEventPublisher SimpleApplicationEventMulticaster ContextRefreshedEvent DefaultLifecycleProcessor AnnotationConfigApplicationContext application event publisher context refreshed event application context simple application event multicaster default lifecycle processor annotation config application context",
}
_LABELS = ("Class", "Interface", "Constructor", "Method", "Function", "File", "Property")
INTENT_LABELS = {
    "sign-in": dict(zip(_LABELS, (1.25, 1.25, 1.10, 0.95, 0.95, 0.85, 0.85))),
    "dispatch": dict(zip(_LABELS, (1.20, 1.20, 1.10, 0.93, 0.93, 0.85, 0.85))),
    "lifecycle": dict(zip(_LABELS, (1.20, 1.20, 1.10, 0.93, 0.93, 0.85, 0.85))),
}


def intent(query: str) -> str | None:
    low = query.lower()
    return next((k for k, groups in INTENTS.items() if all(any(w in low for w in g) for g in groups)), None)


def expand(query: str) -> str:
    found = intent(query)
    return f"{query} {INTENT_WORDS[found]}" if found else query


def query_words(query: str) -> list[str]:
    """The cleaned words of a query, as :func:`text.clean_words` gives them for a column."""
    split = re.sub(r"(?<=[^\W\d_A-Z]|[0-9])(?=[A-Z])", " ", query)
    return [w for w in re.split(r"[^\w]+", split.lower()) if w and w not in text.STOP_WORDS]


def _any(c: Column, words: str, how: str) -> Column:
    return F.coalesce(reduce(Column.__or__, [getattr(c, how)(w) for w in words.split()]), F.lit(False))


def overlap(query: str, candidate: Column) -> Column:
    """Number of distinct query words among a text's cleaned words."""
    asked = sorted(set(query_words(query)))
    return F.size(F.array_intersect(text.clean_words(F.coalesce(candidate, F.lit(""))), F.array(*map(F.lit, asked)).cast("array<string>")))


def overlap_boost(query: str, candidate: Column) -> Column:
    return 1 + 0.15 * F.least(overlap(query, candidate), F.lit(4))


def process_boost(query: str, name: Column, label: Column, entry: Column) -> Column:
    both = F.least(overlap(query, F.concat_ws(" ", name, label, entry)), F.lit(5))
    out = F.when(both > 0, 1 + 0.25 * both * both).otherwise(1.0)
    if intent(query) == "sign-in":
        out = out * F.when((both > 0) & _any(F.lower(F.concat_ws(" ", name, entry)), SIGN_IN[3], "contains"), 1.3).otherwise(1.0)
    return out


def context_boost(query: str, name: str = "name", path: str = "filePath", signature: str = "signature") -> Column:
    """Product of the word overlap and of the domains that the query names."""
    n, p, s = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in (name, path, signature))
    out = overlap_boost(query, F.concat_ws(" ", name, path, signature))
    times = lambda when, by: F.when(when, by).otherwise(1.0)
    for asks, parts, begins, ends in DOMAINS.values():
        if any(w in query.lower() for w in asks.split()):
            out = out * times(_any(p, parts, "contains"), PATH_FACTOR) * times(_any(s, parts, "contains"), SIGNATURE_FACTOR)
            out = out * times(_any(n, begins, "startswith") | _any(n, ends, "endswith"), AFFIX_FACTOR)
    if intent(query) == "sign-in":
        signs, begins, ends, _ = SIGN_IN
        out = out * times(_any(p, signs, "contains"), 1.3) * times(_any(s, signs, "contains"), 1.3)
        out = out * times(_any(n, begins, "startswith") | _any(n, ends, "endswith"), 1.6)
    return out


def label_boost(query: str, label: Column) -> Column:
    out = F.lit(1.0)
    for name, w in INTENT_LABELS.get(intent(query) or "", {}).items():
        out = F.when(label == name, w).otherwise(out)
    return out


def is_identifier(query: str) -> bool:
    """A single word, or one with camel case, underscores or dots."""
    return len(query.split()) == 1


def field_search(docs: DataFrame, field: str, words: list[str]) -> DataFrame:
    """BM25 of the words plus twice that of the phrase: id, score. One pass over the field."""
    found = search.bm25(docs, words, "id", field)
    if len(words) < 2:
        return found
    times = search.phrase(docs, words, "id", field)
    n = docs.agg(F.count(F.lit(1)).alias("n")).crossJoin(times.agg(F.count(F.lit(1)).alias("df")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    whole = times.crossJoin(F.broadcast(n)).select("id", (idf * F.col("times") * (search.K1 + 1) / (F.col("times") + search.K1)).alias("extra"))
    return found.join(whole, "id", "left").select("id", (F.col("score") + 2 * F.coalesce("extra", F.lit(0.0))).alias("score"))


def multi_field(docs: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Fused ranks of the fields' own best: id, score.

    Each field brings at most ``max(3 * limit, 30)`` rows, by a partial top-k,
    so the fusion ranks a bounded number of rows. Paths are split to words.
    """
    fetch = max(3 * limit, 30)
    raw = [w for w in re.split(r"[^\w]+", query.lower()) if w]
    clean = list(dict.fromkeys(query_words(query)))
    at = 0 if is_identifier(query) else 1
    lists = []
    for field, weights in FIELD_WEIGHTS.items():
        words = clean if at or field != "name" else raw
        if not words or field == "name cleaned" and clean == raw and not at:
            continue
        col = field.split()[0]
        names = docs.select("id", text.camel_split(F.col(col)).alias(col)) if field == "name cleaned" else docs.select("id", col)
        top = field_search(names, col, words).orderBy(F.desc("score"), "id").limit(fetch)
        lists.append(top.select(F.lit(field).alias("list_id"), "id", "score", F.lit(weights[at]).alias("weight")))
    if not lists:
        return docs.select("id", F.lit(0.0).alias("score")).filter("false")
    return search.reciprocal_rank_fusion(reduce(DataFrame.union, lists)).orderBy(F.desc("score"), "id").limit(fetch)


def definitions(graph: PropertyGraph, query: str, limit: int = 10, tests: bool = False) -> DataFrame:
    """Best symbols for a query: id, name, label, filePath, score."""
    asked = expand(query)
    docs = graph.by_label(*SEARCHED).filter("id <> ''").select("id", "label", "name", "filePath", "content", "signature", "description")
    hits = multi_field(docs, asked, max(2 * limit, 20))
    degree = graph.degree().join(hits.select("id"), "id", "left_semi")
    full = hits.join(docs, "id").join(degree, "id", "left")
    score = F.col("score") * context_boost(query) * search.centrality_boost(F.coalesce("degree", F.lit(0))) * label_boost(query, F.col("label"))
    best = full.withColumn("score", score)
    same = Window.partitionBy("name", "filePath").orderBy(F.desc("score"), "id")
    best = best.withColumn("_k", F.row_number().over(same)).filter("_k = 1").drop("_k")
    best = search.cap_per(best, "name", 3, F.desc("score"), "id")
    if not tests:
        best = best.filter(~text.is_usage_path(F.col("filePath")))
    return best.select("id", "name", "label", "filePath", "score").orderBy(F.desc("score"), "id").limit(limit)


def supplement(found: DataFrame, vectors: DataFrame, query: list[float], limit: int = 10, least: float = 0.2) -> DataFrame:
    """Up to ``limit`` ids near the query vector that aren't found yet: id, score."""
    near = search.vector_top(vectors, query, 5 * limit, least)
    return near.join(found.select("id"), "id", "left_anti").orderBy(F.desc("score"), "id").limit(limit)


def processes(graph: PropertyGraph, query: str, found: DataFrame, limit: int = 10) -> DataFrame:
    """Flows of the found symbols and flows that the query names: id, name, matched, relevance.

    Relevance is between 0 and 1; ten at most, none under 0.05.
    """
    p = graph.by_label("Process").select("id", "name", "heuristicLabel", "entryPoint", "stepCount", "crossCommunity")
    steps = graph.edges_of("STEP_IN_PROCESS").select("src", F.col("dst").alias("pid"), F.coalesce("step", F.lit(0)).alias("step"))
    w = F.when(F.col("score") > 0, F.col("score")).otherwise(1.0)
    by_step = found.select(F.col("id").alias("src"), "score").join(steps, "src").groupBy("pid").agg(F.count(F.lit(1)).alias("matched"), F.sum(w * (1 + 0.5 / (F.col("step") + 1))).alias("part"))
    boost = process_boost(query, F.col("name"), F.col("heuristicLabel"), F.col("entryPoint"))
    usage = graph.nodes.filter(text.is_usage_path(F.col("filePath"))).select(F.col("id").alias("entryPoint"))
    direct = p.withColumn("direct", boost - 1).filter("direct > 0").join(usage, "entryPoint", "left_anti").orderBy(F.desc("direct"), "id").limit(max(3 * limit, 20)).select(F.col("id").alias("pid"), "direct")
    every = by_step.join(direct, "pid", "full").na.fill(0, ["matched", "part", "direct"]).join(p, F.col("id") == F.col("pid"))
    rel = (F.col("part") + F.col("direct")) * (1 + F.when(F.col("stepCount") > 0, F.col("matched") / F.col("stepCount")).otherwise(0.0)) * F.when(F.col("crossCommunity"), 1.2).otherwise(1.0)
    scored = search.min_max(every.select("id", "name", "heuristicLabel", "matched", F.log1p(rel).alias("relevance")), "relevance")
    return scored.filter("relevance >= 0.05").orderBy(F.desc("relevance"), "id").limit(10)


def query(graph: PropertyGraph, asked: str, limit: int = 10, vectors: DataFrame | None = None, vector: list[float] | None = None, tests: bool = False) -> dict[str, DataFrame]:
    """The query tool: definitions, processes, test flows, and the processes' other symbols."""
    found = definitions(graph, asked, limit, tests)
    if vectors is not None and vector is not None:
        extra = supplement(found, vectors, vector, limit).join(graph.nodes.select("id", "name", "label", "filePath"), "id")
        extra = extra if tests else extra.filter(~text.is_usage_path(F.col("filePath")))
        found = found.unionByName(extra.select("id", "name", "label", "filePath", "score"))
    found = written(found)
    flows = written(processes(graph, asked, found, limit))
    budget = min(max(limit // 2, 3), 10)
    steps = graph.edges_of("STEP_IN_PROCESS").join(flows.select(F.col("id").alias("dst"), "relevance"), "dst").groupBy(F.col("src").alias("id")).agg(F.max("relevance").alias("relevance"))
    near = steps.join(found.select("id"), "id", "left_anti").join(graph.nodes.select("id", "name", "label", "filePath", "signature"), "id").join(graph.degree(), "id", "left")
    bonus = F.when(F.col("label").isin("Class", "Method", "Function", "Constructor", "Interface"), 0.2).when(F.col("label") == "File", -0.2).when(F.col("label") == "Property", -0.1).otherwise(0.0)
    near = near.withColumn("score", context_boost(asked) * search.centrality_boost(F.coalesce("degree", F.lit(0))) + bonus)
    near = search.cap_per(near, "name", 3, F.desc("score"), "id").orderBy(F.desc("score"), "id").limit(budget).select("id", "name", "label", "filePath", "score")
    test = F.coalesce(F.col("heuristicLabel") == "Test flow", F.lit(False))
    return {"definitions": found, "processes": flows.filter(~test), "test_flows": flows.filter(test), "symbols": near}
