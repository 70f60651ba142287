"""Benchmark decontamination by BM25 with block-max WAND.

The test items form an inverted index whose BM25 impacts are divided by the
item's score against itself, so that an item is retrieved at ``threshold`` of
its own best score. Every training text is cut into overlapping passages, each
long enough that any item lies whole in one, and every passage is a query.

Query evaluation keeps the order of block-max WAND, for many passages at once:
terms of low impact are set aside, with what they could add at most to any item
of a block; the other terms' lists are merged by (passage, block of items) with
the block's largest impact of each term; only where the bound reaches the
threshold are the block's items scored in full. Retrieval therefore is exact.

A retrieved item is confirmed on five-word shingles: it counts where the
passage holds at least ``overlap`` of the item's shingles, or of both its
question's and its answer's. The answer is an item's last line or, on one line,
its last sentence; an item of one sentence is all question.

The index is built for at most ``shard_items`` items or ``shard_bytes`` of text
at a time (a hash of id and text deals larger benchmarks into shards), so what
is broadcast has a bound; each shard is one pass over the texts. Numbers of
items, their mean length and document frequencies are those of all items, so
shards don't change a score.

Null or wordless texts and items match nothing. Repeated rows give a row for a
pair of ids only once; a null id is an id here. ``clean`` decides by the text
alone, so rows with null or repeated ids are judged one by one. Other columns
are ignored or stay. An empty table on either side gives an empty result, or
``docs`` as it is.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

EDGE = re.compile(r"^\W+|\W+$")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
CACHE = 200_000
SHINGLE = 5


def word_of(token: str) -> str:
    """A token in lower case without punctuation at its ends; may be empty."""
    return EDGE.sub("", token.lower())


def words(text: str | None) -> list[str]:
    return [w for t in (text or "").split() if (w := word_of(t))]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    lines = [x for x in text.splitlines() if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    parts = SENTENCE.split(text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def shingles(ids: list[int]) -> set[tuple[int, ...]]:
    """Five-word runs; a shorter text is one run."""
    if not ids:
        return set()
    return {tuple(ids[i : i + SHINGLE]) for i in range(max(1, len(ids) - SHINGLE + 1))}


@dataclass
class Index:
    """Postings by block of items, and each item's terms and shingles."""

    vocabulary: dict[str, int]
    item_ids: list
    #: For each item its terms and their share of the item's own score.
    terms: list[np.ndarray]
    shares: list[np.ndarray]
    question: list[set]
    answer: list[set]
    whole: list[set]
    #: Leading terms' lists: term t owns blocks[at[t]:at[t + 1]], with maxima.
    at: np.ndarray
    blocks: np.ndarray
    maxima: np.ndarray
    #: The most that set-aside terms can add to an item of each block.
    rest: np.ndarray
    block_items: int
    longest: int


@dataclass
class Statistics:
    """Number of items with words, their mean length, document frequencies."""

    items: int
    mean: float
    frequencies: dict[str, int]


def build_index(items: list[tuple], threshold: float, k1: float = 1.2, b: float = 0.75, block_items: int = 4, statistics: Statistics | None = None) -> Index | None:
    """Index (id, text) pairs; None if no item has a word.

    ``statistics`` of all items, where these are a part.
    """
    parsed = [(key, words(text), *(words(x) for x in split_item(text or ""))) for key, text in items]
    parsed = sorted((x for x in parsed if x[1]), key=lambda x: (len(x[1]), str(x[0])))
    if not parsed:
        return None
    n, mean = len(parsed), sum(len(x[1]) for x in parsed) / len(parsed)
    df: dict[str, int] = Counter(w for x in parsed for w in set(x[1]))
    every = n
    if statistics is not None:
        every, mean, df = statistics.items, statistics.mean, {w: statistics.frequencies[w] for w in df}
    vocabulary = {w: i for i, w in enumerate(sorted(df))}
    terms, shares = [], []
    for _, ws, _, _ in parsed:
        tf = Counter(ws)
        own = sorted(tf, key=vocabulary.__getitem__)
        impact = np.array([np.log(1 + (every - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ws) / mean)) for w in own])
        terms.append(np.array([vocabulary[w] for w in own]))
        shares.append(impact / impact.sum())
    # Set aside the commonest terms as long as each item keeps terms that it
    # needs for the threshold.
    aside = np.zeros(n)
    set_aside = np.zeros(len(vocabulary), bool)
    lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for i, (t, s) in enumerate(zip(terms, shares)):
        for x, y in zip(t.tolist(), s.tolist()):
            lists[x].append((i, y))
    for x in sorted(lists, key=lambda x: (-len(lists[x]), x)):
        if len(lists[x]) < 3:
            break
        if all(aside[i] + y < 0.8 * threshold for i, y in lists[x]):
            set_aside[x] = True
            for i, y in lists[x]:
                aside[i] += y
    n_blocks = -(-n // block_items)
    rest = np.array([aside[i : i + block_items].max() for i in range(0, n, block_items)])
    at, blocks, maxima = [0], [], []
    for x in range(len(vocabulary)):
        if not set_aside[x]:
            best: dict[int, float] = defaultdict(float)
            for i, y in lists[x]:
                best[i // block_items] = max(best[i // block_items], y)
            blocks += best.keys()
            maxima += best.values()
        at.append(len(blocks))
    assert len(rest) == n_blocks
    ids = lambda ws: [vocabulary[w] for w in ws]
    return Index(vocabulary, [x[0] for x in parsed], terms, shares, [shingles(ids(x[2])) for x in parsed], [shingles(ids(x[3])) for x in parsed], [shingles(ids(x[1])) for x in parsed], np.array(at), np.array(blocks, np.int64), np.array(maxima), rest, block_items, max(len(x[1]) for x in parsed))


class _Words(dict):
    """Raw token to term number; -1: not in the index, -2: no word."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        w = word_of(token)
        if len(self) > CACHE:
            self.clear()
        self[token] = self.vocabulary.get(w, -1) if w else -2
        return self[token]


def _overlap(item: set, passage: set) -> float:
    return len(item & passage) / len(item) if item else 1.0


def search(index: Index, texts: list[np.ndarray], threshold: float, overlap: float) -> list[tuple[int, int, float, float, float, float]]:
    """Confirmed (text number, item number, score, overlap, question's, answer's).

    Passages start every ``longest`` words and are twice as long.
    """
    step = index.longest
    counts = np.array([max(1, -(-len(x) // step)) for x in texts])
    base = np.concatenate([[0], np.cumsum(counts)])
    flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    if not len(flat):
        return []
    lengths = np.array([len(x) for x in texts])
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    lead = np.append(index.at[1:] > index.at[:-1], False)  # the last place answers -1
    hit = np.flatnonzero(lead[flat])
    if not len(hit):
        return []
    text_no = np.searchsorted(start, hit, side="right") - 1
    # Texts without words share a start with the next; the last one owns it.
    window = (hit - start[text_no]) // step
    passage = base[text_no] + window
    term = flat[hit]
    again = window > 0
    size = len(index.at)
    pairs = np.unique(np.concatenate([passage * size + term, (passage[again] - 1) * size + term[again]]))
    passage, term = pairs // size, pairs % size
    n = index.at[term + 1] - index.at[term]
    place = np.repeat(index.at[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    key = np.repeat(passage, n) * len(index.rest) + index.blocks[place]
    order = np.argsort(key, kind="stable")
    key, most = key[order], index.maxima[place][order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    bound = np.add.reduceat(most, first)
    key = key[first]
    found = []
    for k in key[bound + index.rest[key % len(index.rest)] >= threshold - 1e-9].tolist():
        p, block = divmod(k, len(index.rest))
        d = int(np.searchsorted(base, p, side="right")) - 1
        at = (p - int(base[d])) * step
        own = texts[d][at : at + 2 * step]
        have = None
        mask = np.isin
        for i in range(block * index.block_items, min(len(index.terms), (block + 1) * index.block_items)):
            score = float(index.shares[i][mask(index.terms[i], own)].sum())
            if score >= threshold - 1e-9:
                have = have if have is not None else shingles(own.tolist())
                all_, q, a = (_overlap(x[i], have) for x in (index.whole, index.question, index.answer))
                if all_ >= overlap or (q >= overlap and a >= overlap):
                    found.append((d, i, score, all_, q, a))
    return found


def _runs(texts: Iterator[tuple], number: _Words, limit: int = 2_000_000) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Keys and term numbers of texts with words, in runs of a bounded length."""
    keys, found, size = [], [], 0
    for key, text in texts:
        tokens = (text or "").split()
        ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        ids = ids[ids != -2]
        if len(ids):
            keys.append(key)
            found.append(ids)
            size += len(ids)
        if size > limit:
            yield keys, found
            keys, found, size = [], [], 0
    if found:
        yield keys, found


def _pairs(docs: DataFrame, index: Index, threshold: float, overlap: float, item_type: str, id_col: str, text_col: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = sent.value
        number = _Words(index.vocabulary)

        def answer(keys: list, texts: list[np.ndarray]) -> pd.DataFrame:
            best: dict[tuple, tuple] = {}
            for d, i, *values in search(index, texts, threshold, overlap):
                pair = (keys[d], index.item_ids[i])
                best[pair] = max(best.get(pair, ()), tuple(values))
            rows = [(*pair, *values) for pair, values in best.items()]
            return pd.DataFrame(rows, columns=["id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"]).astype({"id": object, "item_id": object})

        for batch in batches:
            for keys, texts in _runs(zip(batch["id"], batch["text"]), number):
                yield answer(keys, texts)

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, item_id {item_type}, score double, overlap double, question_overlap double, answer_overlap double"
    return picked.mapInPandas(run, schema)


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, threshold: float, shard_items: int, shard_bytes: int) -> Iterator[Index]:
    """Indexes over all items, each of a bounded part."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    rows, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-rows // shard_items), -(-size // shard_bytes))
    if shards == 1:
        index = build_index([tuple(r) for r in items.collect()], threshold)
        if index is not None:
            yield index
        return

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [words(t) for t in batch["text"]]
            seen = Counter(w for ws in own for w in set(ws))
            # No word is empty: the empty one counts items and their words.
            yield pd.DataFrame({"term": ["", *seen], "df": [sum(1 for ws in own if ws), *seen.values()], "n": [sum(map(len, own)), *[0] * len(seen)]})

    table = materialize(items.mapInPandas(terms, "term string, df long, n long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")), "benchmark-terms")
    _, n, total = table.filter("term = ''").first()
    for k in range(shards):
        own = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k).collect()]
        have = sorted({w for _, t in own for w in words(t)})
        if have:
            wanted = benchmark.sparkSession.createDataFrame([(w,) for w in have], "term string")
            frequencies = {r["term"]: r["df"] for r in table.join(F.broadcast(wanted), "term", "left_semi").collect()}
            yield build_index(own, threshold, statistics=Statistics(n, total / n, frequencies))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.75, overlap: float = 0.8, shard_items: int = 20_000, shard_bytes: int = 32 << 20) -> DataFrame:
    """One row for each pair of a text and a test item that it holds."""
    item_type = benchmark.schema[item_col].dataType.simpleString()
    parts = [_pairs(docs, index, threshold, overlap, item_type, id_col, text_col) for index in _indexes(benchmark, item_col, item_text_col, threshold, shard_items, shard_bytes)]
    if not parts:
        kind = docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"`{id_col}` {kind}, item_id {item_type}, score double, overlap double, question_overlap double, answer_overlap double")
    found = reduce(DataFrame.unionByName, parts)
    best = found.groupBy("id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "overlap", "question_overlap", "answer_overlap")])
    return best.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.75, overlap: float = 0.8, shard_items: int = 20_000, shard_bytes: int = 32 << 20) -> DataFrame:
    """Rows of ``docs`` that hold no test item; columns stay."""
    for index in _indexes(benchmark, item_col, item_text_col, threshold, shard_items, shard_bytes):
        docs = docs.filter(_without(docs, index, threshold, overlap)(F.col(text_col)))
    return docs


def _without(docs: DataFrame, index: Index, threshold: float, overlap: float):
    """A function of a text: true if it holds none of the index's items."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("boolean")
    def without(texts: pd.Series) -> pd.Series:
        index = sent.value
        number = _Words(index.vocabulary)
        keep = np.ones(len(texts), bool)
        for at, ids in _runs(enumerate(texts), number):
            for d, *_ in search(index, ids, threshold, overlap):
                keep[at[d]] = False
        return pd.Series(keep)

    return without
