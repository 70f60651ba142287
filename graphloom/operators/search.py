"""Retrieval: postings, BM25, rank fusion and vector search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, RRF_K = 1.2, 0.75, 60
#: Vectors that are compared with a block of queries at once.
SLICE = 512


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}_]+"), lambda w: w != "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row.

    The optimizer copies a projected column into each lambda that names it,
    where it would be worked out for every element; a lambda's own variable
    isn't copied.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bm25(docs: DataFrame, query: list[str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Score of each document that holds a query word: id, score.

    Only the query's words leave the scan, as counts in one row a document;
    lengths and document frequencies come from the same pass.
    """
    terms = list(dict.fromkeys(w.lower() for w in query))
    ws = words(F.coalesce(F.col(text_col), F.lit("")))
    times = lambda w, t: F.size(F.filter(w, lambda x: x == F.lit(t)))
    counts = once(ws, lambda w: F.struct(F.size(w).alias("dl"), *[times(w, t).alias(f"tf{i}") for i, t in enumerate(terms)]))
    rows = docs.select(F.col(id_col).alias("id"), counts.alias("c")).select("id", "c.*")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hit = rows.filter(" or ".join(f"tf{i} > 0" for i in range(len(terms))) or "false")
    # One row of statistics.
    return hit.crossJoin(F.broadcast(stats)).select("id", score.alias("score"))


def phrase(docs: DataFrame, query: list[str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Documents with the words one after another: id and number of times.

    A query of no words finds none.
    """
    if not query:
        return docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("times")).filter("false")
    ws = words(F.coalesce(F.col(text_col), F.lit("")))

    def starts(w: Column) -> Column:
        at = lambda x, i: reduce(and_, [F.coalesce(F.get(w, i + k), F.lit("")) == t for k, t in enumerate(query)])
        return F.size(F.filter(w, at))

    return docs.select(F.col(id_col).alias("id"), once(ws, starts).cast("long").alias("times")).filter("times > 0")


def reciprocal_rank_fusion(lists: DataFrame) -> DataFrame:
    """Fuse ranked lists (list_id, id, score, weight): id, score; ties rank by id.

    A weight of zero or less counts as one.
    """
    rank = F.row_number().over(Window.partitionBy("list_id").orderBy(F.desc("score"), "id"))
    w = F.when(F.col("weight") <= 0, 1.0).otherwise(F.coalesce("weight", F.lit(1.0)))
    return lists.withColumn("rank", rank).groupBy("id").agg(F.sum(w / (RRF_K + F.col("rank"))).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 for unlike lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def vector_top(vectors: DataFrame, query: list[float], k: int = 10, least: float = 0.0, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Nearest vectors by cosine: id, score; partial top-k on each partition."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = vectors.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q).alias("score"))
    return s.filter(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(k)


def vector_top_all(vectors: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.0, id_col: str = "id", vector_col: str = "vector", block: int = 1024) -> DataFrame:
    """Nearest vectors of every query: query, id, score.

    Queries go out in blocks of at most ``block`` vectors; a task keeps its
    best ``k`` of each query, and these meet in a last ranking. Scores are
    cosines in doubles, 0 for unlike lengths or a zero vector; ties to nine
    places rank by id.
    """
    spark = vectors.sparkSession
    ids = queries.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id")).orderBy("id")
    kind = vectors.schema[id_col].dataType.simpleString()
    edges = [r["id"] for r in ids.withColumn("n", F.row_number().over(Window.orderBy("id"))).filter((F.col("n") - 1) % block == 0).select("id").collect()]
    parts = []
    for low, high in zip(edges, [*edges[1:], None]):
        own = queries.filter(F.col(id_col) >= low) if high is None else queries.filter((F.col(id_col) >= low) & (F.col(id_col) < high))
        rows = own.filter(F.col(vector_col).isNotNull()).select(id_col, vector_col).orderBy(id_col).collect()
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], [np.asarray(r[1], float) for r in rows]))
        near = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).mapInPandas(_nearest(sent, k, least), f"query {kind}, id {kind}, score double")
        parts.append(near)
    if not parts:
        return spark.createDataFrame([], f"query {kind}, id {kind}, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return reduce(DataFrame.union, parts).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")


def _nearest(sent, k: int, least: float):
    """Each task's best ``k`` vectors of every query of a block."""

    def unit(rows: list[np.ndarray]) -> np.ndarray:
        m = np.stack(rows)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, wanted = sent.value
        sizes = sorted({len(q) for q in wanted})
        of_size = {n: [i for i, q in enumerate(wanted) if len(q) == n] for n in sizes}
        units = {n: unit([wanted[i] for i in own]) for n, own in of_size.items()}
        held: list[pd.DataFrame] = []

        def best(parts: list[pd.DataFrame]) -> pd.DataFrame:
            rows = pd.concat(parts).sort_values(["query", "score", "id"], ascending=[True, False, True], kind="stable")
            return rows.groupby("query", sort=False).head(k)

        for batch in (b[i : i + SLICE] for b in batches for i in range(0, len(b), SLICE)):
            batch = batch[batch["vector"].notna()]
            if not len(batch):
                continue
            lengths = batch["vector"].map(len).to_numpy()
            keys = batch["id"].to_numpy()
            for n in sizes:
                scores = np.zeros((len(of_size[n]), len(batch)))
                like = np.flatnonzero(lengths == n)
                if len(like):
                    scores[:, like] = np.round(units[n] @ unit([np.asarray(v, float) for v in batch["vector"].to_numpy()[like]]).T, 9)
                some = min(k, len(batch))
                # The k-th best score of each query; ties beyond it are settled by id.
                cut = np.partition(scores, len(batch) - some, axis=1)[:, len(batch) - some]
                q, v = np.nonzero((scores >= cut[:, None]) & (scores >= least))
                held.append(pd.DataFrame({"query": np.array(names, dtype=keys.dtype)[np.array(of_size[n])[q]], "id": keys[v], "score": scores[q, v]}))
            if sum(map(len, held)) > 4 * k * len(names):
                held = [best(held)]
        if held:
            yield best(held)

    return run


def min_max(df: DataFrame, col: str = "score") -> DataFrame:
    """Scores between 0 and 1; all equal gives 1."""
    s = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    out = F.when(F.col("_hi") - F.col("_lo") < 1e-6, 1.0).otherwise((F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.crossJoin(F.broadcast(s)).withColumn(col, out).drop("_lo", "_hi")


def centrality_boost(degree: Column) -> Column:
    return F.least(F.lit(2.0), 1 + 0.15 * F.log2(degree + 1))


def cap_per(df: DataFrame, by: str, n: int, *order) -> DataFrame:
    """At most ``n`` rows for each value of ``by``, the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
