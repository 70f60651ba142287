"""Stored vectors by node, and providers that make them."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, vector array<float>, hash string"


class VectorStore:
    """Vectors (id, vector, hash) under ``folder``; each change writes a new version.

    A version counts once its write is complete, so a job that dies leaves the
    former one. Versions before the last are removed after the next change.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS")))

    def scan(self) -> DataFrame:
        found = self._versions()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/v{found[-1]}") if found else self.spark.createDataFrame([], SCHEMA)

    def _replace(self, rows: DataFrame) -> None:
        found = self._versions()
        rows.select("id", "vector", "hash").write.parquet(f"{self.folder}/v{(found or [0])[-1] + 1}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for old in found[:-1]:
            path = hadoop.Path(f"{self.folder}/v{old}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def put(self, rows: DataFrame) -> None:
        """Add or replace vectors (id, vector and, if known, hash); an empty hash keeps the old one."""
        new = rows.filter("id is not null").withColumn("hash", F.col("hash") if "hash" in rows.columns else F.lit(None).cast("string"))
        new = new.groupBy("id").agg(F.max(F.struct("hash", "vector")).alias("x")).select("id", F.col("x.vector").cast("array<float>").alias("vector"), F.nullif(F.col("x.hash"), F.lit("")).alias("hash"))
        old = self.scan()
        kept = new.join(old.select("id", F.col("hash").alias("old")), "id", "left").select("id", "vector", F.coalesce("hash", "old").alias("hash"))
        self._replace(old.join(new.select("id"), "id", "left_anti").unionByName(kept))

    def upsert(self, rows: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> int:
        """Embed and put only what is new or has another hash: (id, text, hash); how many."""
        stale = rows.join(self.hashes(rows.select("id")).withColumnRenamed("hash", "old"), "id", "left").filter(~F.col("hash").eqNullSafe(F.col("old"))).select("id", "text", "hash")
        n = stale.count()
        if n:
            self.put(embed(stale))
        return n

    def get(self, key: str) -> list[float] | None:
        row = self.scan().filter(F.col("id") == key).first()
        return list(row["vector"]) if row else None

    def has(self, keys: DataFrame) -> DataFrame:
        """Keys (id) that have a vector."""
        return keys.select("id").distinct().join(self.scan().select("id"), "id", "left_semi")

    def hashes(self, keys: DataFrame) -> DataFrame:
        """Hashes of the keys (id) that have one: id, hash."""
        return self.scan().filter("hash is not null").select("id", "hash").join(keys.select("id").distinct(), "id", "left_semi")

    def ids(self) -> DataFrame:
        return self.scan().select("id")

    def count(self) -> int:
        return self.scan().count()

    def delete(self, keys: DataFrame) -> None:
        self._replace(self.scan().join(keys.select("id").distinct(), "id", "left_anti"))

    def delete_prefix(self, prefix: str) -> None:
        self._replace(self.scan().filter(~F.col("id").startswith(prefix)))

    def clear(self) -> None:
        self._replace(self.spark.createDataFrame([], SCHEMA))


class HashingProvider:
    """Vectors of hashed words and letter triples, made without a model; of unit length.

    Texts without a word have a zero vector. Any object with ``dimensions``,
    ``name`` and ``embed(texts)`` takes its place.
    """

    def __init__(self, dimensions: int = 384) -> None:
        self.dimensions, self.name = dimensions, f"hashing-{dimensions}"

    def embed(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                for g in (w, *(f"\x02{w}\x03"[k : k + 3] for k in range(len(w)))):
                    h = zlib.crc32(g.encode("utf-8", "surrogatepass"))
                    out[i, h % self.dimensions] += 1 if h >> 31 else -1
            norm = np.sqrt((out[i] ** 2).sum())
            out[i] /= norm if norm else 1
        return out


def embed(rows: DataFrame, provider=None) -> DataFrame:
    """``rows`` (id, text, hash) with a vector: id, vector, hash; a batch of texts at a time."""
    provider = provider or HashingProvider()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "vector": list(provider.embed(list(batch["text"]))), "hash": batch["hash"]})

    return rows.select("id", "text", "hash").mapInPandas(run, SCHEMA)
