"""A persisted full-text index: postings with positions, and searches that read them.

The analyzer lower-cases, splits at what isn't a letter, digit or underscore,
drops the possessive, stop words and English endings (Porter's algorithm). A
row of postings is a term of a field of a document with its places; rows are
laid out by a hash of field and term, so that a search reads the buckets of its
own terms, by partition pruning, and no document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .graph import PropertyGraph
from .ranking import SEARCHED
from .search import B, K1

# Words that the English analyzer drops.
STOPS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
TEXT_FIELDS = ("name", "content", "signature", "description")
BUCKETS = 64
#: Places of terms that go out together.
BATCH_PLACES = 200_000


# Endings of Porter's algorithm and what takes their place.
STEP_TWO = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
STEP_THREE = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP_FOUR = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(w: str) -> str:
    """Letters as c or v; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _short_end(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """Porter's stem of a lower-case word (M. F. Porter, "An algorithm for suffix stripping")."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        end = next((e for e in ("ed", "ing") if w.endswith(e) and "v" in _shape(w[: -len(e)])), None)
        if end:
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_TWO, STEP_THREE):
        end = next((e for e in sorted(table, key=len, reverse=True) if w.endswith(e)), None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = next((e for e in sorted(STEP_FOUR, key=len, reverse=True) if w.endswith(e)), None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _split(value: str | None, plain: bool) -> tuple[list[str], np.ndarray]:
    """Terms of a text and their places."""
    value = (value or "").lower()
    if plain:
        # The same words, faster where there is nothing but ASCII.
        found = re.findall(r"[A-Za-z0-9_]+", value) if value.isascii() else regex.findall(r"[\p{L}\p{Nd}_]+", value)
        return found, np.arange(len(found), dtype=np.int32)
    out, at = [], []
    for i, m in enumerate(re.finditer(r"[^\W_][\w]*(?:['’][^\W_]+)?|_\w*", value)):
        w = re.sub(r"['’]s$", "", m[0])
        if w not in STOPS:
            out.append(stem(w))
            at.append(i)
    return out, np.array(at, np.int32)


def analyze(value: str | None, plain: bool = False) -> list[tuple[str, int]]:
    """(term, place) of a text; dropped words keep their place. ``plain`` only splits."""
    terms, places = _split(value, plain)
    return list(zip(terms, places.tolist()))


def bucket_of(field: str, term: str) -> int:
    return zlib.crc32(f"{field}\x00{term}".encode()) % BUCKETS


def _indexed(fields: list[str], plain: bool):
    """Rows of postings of batches whose first column is the id.

    Texts gather until they have ``BATCH_PLACES`` places, so that a task holds
    that many and one text more.
    """
    def rows(bucket: Callable[[str, str], int], ids: pa.Array, docs: list[int], kinds: list[int], parts: list[tuple[list[str], np.ndarray]]) -> pa.RecordBatch:
        lengths = np.array([len(t) for t, _ in parts], np.int64)
        coded = pa.array([x for t, _ in parts for x in t], pa.string()).dictionary_encode()
        size = max(len(coded.dictionary), 1)
        key = np.repeat(np.arange(len(parts)), lengths) * size + coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        part, code = key[first] // size, key[first] % size
        kind = np.array(kinds, np.int64)
        named, back = np.unique(kind[part] * size + code, return_inverse=True)
        known = coded.dictionary.to_pylist()
        own = np.array([bucket(fields[n // size], known[n % size]) for n in named.tolist()], np.int64)[back]
        # A row for each text comes before those of its terms.
        whole = lambda a, b: pa.array(np.concatenate([a, b]).astype(np.int32))
        every = np.concatenate([np.arange(len(parts)), part])
        places = np.concatenate([at for _, at in parts])[order]
        starts = whole(np.zeros(len(parts)), np.append(first, len(key)))
        return pa.RecordBatch.from_arrays(
            [
                whole([bucket(fields[k], "") for k in kinds], own), pa.array(fields, pa.string()).take(pa.array(kind[every])),
                pa.concat_arrays([pa.array([""] * len(parts), pa.string()), coded.dictionary.take(pa.array(code))]), ids.take(pa.array(np.array(docs, np.int64)[every])),
                pa.array(lengths[every].astype(np.int32)), pa.ListArray.from_arrays(starts, pa.array(places)),
            ],
            ["bucket", "field", "term", "id", "length", "places"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = lru_cache(1 << 16)(bucket_of)
        for batch in batches:
            docs, kinds, parts, held = [], [], [], 0
            for k in range(batch.num_rows):
                for f in range(len(fields)):
                    docs.append(k)
                    kinds.append(f)
                    parts.append(_split(batch.column(1 + f)[k].as_py(), plain))
                    held += len(parts[-1][0])
                if held >= BATCH_PLACES:
                    yield rows(bucket, batch.column(0), docs, kinds, parts)
                    docs, kinds, parts, held = [], [], [], 0
            if parts:
                yield rows(bucket, batch.column(0), docs, kinds, parts)

    return run


class Index:
    """Postings under ``folder``: build, search, phrases, count, delete."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, docs: DataFrame, fields: list[str], id_col: str = "id", plain: bool = False) -> Index:
        """Index the fields of ``docs``; an index that was there is replaced.

        Nulls and empty texts have no terms but count as documents. Rows
        without id are left out; rows that repeat an id are one document each.
        A task holds one document's postings and a bounded number of others.
        """
        kind = docs.schema[id_col].dataType.simpleString()
        picked = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *[F.col(f).cast("string").alias(f) for f in fields])
        rows = picked.mapInArrow(_indexed(fields, plain), f"bucket int, field string, term string, id {kind}, length int, places array<int>")
        # A row a field and document, with no term, is dealt by its document.
        salt = F.when(F.col("term") == "", F.pmod(F.xxhash64("id"), F.lit(BUCKETS))).otherwise(F.pmod(F.xxhash64("id"), F.lit(4)))
        rows.repartition("bucket", salt).sortWithinPartitions("bucket", "field", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings")
        lengths = self._rows().filter("term = ''").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
        lengths.write.mode("overwrite").parquet(f"{self.folder}/fields")
        return self

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/postings")

    def _of(self, field: str, terms: list[str]) -> DataFrame:
        buckets = sorted({bucket_of(field, t) for t in terms})
        return self._rows().filter(F.col("bucket").isin(*buckets) & (F.col("field") == field) & F.col("term").isin(*terms))

    def count(self) -> int:
        """Number of documents."""
        row = self.spark.read.parquet(f"{self.folder}/fields").agg(F.max("n")).first()
        return row[0] or 0

    def search(self, field: str, asked: str, plain: bool = False) -> DataFrame:
        """BM25 of a query's terms in a field: id, score."""
        terms = list(dict.fromkeys(t for t, _ in analyze(asked, plain)))
        rows = self._of(field, terms) if terms else self._rows().filter("false")
        one = self.spark.read.parquet(f"{self.folder}/fields").filter(F.col("field") == field)
        df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        # A row a term, and one row of the field.
        s = rows.join(F.broadcast(df), "term").crossJoin(F.broadcast(one.select("n", "mean")))
        tf = F.size("places")
        part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        return s.groupBy("id").agg(F.sum(part).alias("score"))

    def phrase(self, field: str, asked: str, plain: bool = False) -> DataFrame:
        """Documents that hold the query's terms at their distances: id, times."""
        terms = analyze(asked, plain)
        if not terms:
            return self._rows().select("id", F.lit(0).alias("times")).filter("false")
        rows = self._of(field, sorted({t for t, _ in terms}))
        out = None
        for t, i in terms:
            own = rows.filter(F.col("term") == t).select("id", F.transform("places", lambda p: p - i).alias("p"))
            out = own if out is None else out.join(own.withColumnRenamed("p", "q"), "id").select("id", F.array_intersect("p", "q").alias("p")).filter(F.size("p") > 0)
        return out.select("id", F.size("p").cast("long").alias("times"))

    def delete(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def expanded_name(name, path):
    """A name, its camel-case parts, and those of its path's segments without endings, each once."""
    segments = F.transform(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: F.regexp_replace(s, r"(?<=.)\.[^.]*$", ""))
    both = F.flatten(F.transform(F.concat(F.array(name), segments), lambda s: F.array(s, text.camel_split(s))))
    return F.array_join(F.array_distinct(F.filter(both, lambda s: s != "")), " ")


def expanded_signature(signature):
    """A signature, and after it its words if they differ."""
    split = text.camel_split(F.regexp_replace(signature, r"[.\-_/(),]", " "))
    return F.when(signature == "", "").when(split == signature, signature).otherwise(F.concat_ws(" ", signature, split))


def documents(graph: PropertyGraph) -> DataFrame:
    """What is indexed of a graph: searchable nodes with their words enriched.

    A file's content is what it contains and imports; of other nodes it is
    their own.
    """
    n = graph.by_label(*SEARCHED).filter("id <> ''")
    of_file = graph.by_label("File").filter("filePath <> ''").select(F.col("id").alias("src"))
    kin = graph.edges_of("CONTAINS", "IMPORTS").join(of_file, "src", "left_semi").join(graph.nodes.select(F.col("id").alias("dst"), F.col("name").alias("child"), F.col("filePath").alias("at")), "dst")
    target = F.coalesce(F.nullif("child", F.lit("")), "at")
    parts = F.filter(F.split(target, r"[/.\-_]"), lambda s: F.length(s) > 2)
    imported = F.concat(F.array(target), F.flatten(F.transform(parts, lambda s: F.array(s, text.camel_split(s)))))
    named = F.when(F.col("type") == "IMPORTS", imported).otherwise(F.array(F.col("child"), text.camel_split(F.col("child"))))
    lists = kin.groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_distinct(F.array_compact(F.flatten(F.array_sort(F.collect_list(named))))), " ").alias("kin"))
    cols = n.join(lists, "id", "left").select(
        "id", "label", expanded_name(F.col("name"), F.col("filePath")).alias("name"), F.when(F.col("label") == "File", F.concat_ws(" ", "kin", "content")).otherwise(F.col("content")).alias("content"),
        expanded_signature(F.col("signature")).alias("signature"), "description", "filePath",
    )
    return cols
