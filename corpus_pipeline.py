"""Corpus pipeline: toxicity, near duplicates, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; the result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, packing, pseudonyms, simhash, toxicity
from graphloom.llm.common import materialize, read, remainder
from graphloom.llm.queries import tokenizer_path
from graphloom.session import ship


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7.

    Null and empty texts have the score of no terms. Without labels of both
    kinds the share of toxic ones is every text's score. Null ids, repeated rows
    and other columns stay; an empty table stays empty; texts have no limit.
    """
    labels = read(spark, sf_dir, "labels").filter(remainder("doc_id", 3) != 1)
    return toxicity.reject(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, the smallest id.

    Null and empty texts are copies of each other; rows without id stay; rows
    that repeat an id stay or go together; other columns stay.
    """
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts hold none; every row is judged by its own text, so
    null and repeated ids don't matter; an empty benchmark keeps all.
    """
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pseudonymized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data.

    Null text stays null with a null n_chars; rows and other columns stay.
    """
    out = pseudonyms.pseudonymize(docs, pseudonyms.session_key(spark))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences.

    Null and empty texts are the end id alone; null ids and repeated rows keep
    their pieces; an empty table gives none.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", reject_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminated), ("pii", pseudonymized), ("packing", packed)]

#: The stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
