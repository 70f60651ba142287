"""The queries opN_<name> over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import decontaminate, langid, mainhtml, maxent, media, packing, pseudonyms, simhash, suffixes, toxicity
from .common import read, remainder


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mainhtml.extract_pages(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "path")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.filter(remainder("doc_id", 4) != 2))
    found = langid.predict(docs, model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").filter(remainder("doc_id", 3) != 1)
    found = toxicity.score(docs, toxicity.train(docs, labels))
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymize(docs, pseudonyms.session_key(spark), count_col="n_replaced").select("doc_id", "text", "n_replaced")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "overlap", "question_overlap", "answer_overlap")])


def op7_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maxent.score_texts(read(spark, sf_dir, "documents"))
    return found.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(read(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(read(spark, sf_dir, "documents"))
    first = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return found.select(*first, "width", "height", "bit_depth")


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity": op4_toxicity,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_decontamination": op6_decontamination,
    "op7_maxent_scores": op7_maxent_scores,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_media_columns": op10_media_columns,
}

QUERIES = {name: _shipped(query) for name, query in _ALL.items()}

#: DuckDB statements for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    # Bytes as pairs of hex digits; windows of 50 bytes are 100 digits.
    "op8_suffix_dedup": """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM d, unnest(range(0, n - 49)) AS t(p) WHERE n >= 50),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
g AS (SELECT w.doc_id, w.p FROM w JOIN m USING (s) WHERE w.doc_id > m.first),
e AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 WHEN lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS fresh FROM g),
r AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM e),
s AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY doc_id, span),
k AS (SELECT doc_id, b AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), NULL) AS b FROM s UNION ALL SELECT doc_id, 0, min(a) FROM s GROUP BY doc_id),
t AS (SELECT d.doc_id, string_agg(substr(d.h, 2 * k.a + 1, 2 * (coalesce(k.b, d.n) - k.a)), '' ORDER BY k.a) AS kept FROM d JOIN k USING (doc_id) GROUP BY d.doc_id),
c AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(c.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(t.kept, d.h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)""",
}
