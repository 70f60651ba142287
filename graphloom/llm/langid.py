"""Language identification by words first, backing off to character n-grams.

A word known to the model votes with its log frequency in each language. An
unseen word falls back to its character n-grams (word ends marked), longest
first: the first length of which any n-gram is known gives the vote, the mean
of its n-grams' log frequencies.

Learning takes a bounded sample of the labelled rows: at most ``train_docs``
for each language, chosen by a hash of the id. Every word and n-gram of the
sample is an entry, so the sample bounds the model, which is broadcast with the
task. Prediction covers every whole text.

Null text and text without a letter give ``und`` with score 0. A text none of
whose letters the model knows gets the commonest language. Ties go to the
language first in order. Without any labelled row every text is ``und``. Null
ids and repeated rows keep their rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_fraction, by_hash

WORD = re.compile(r"[^\W\d_]+")
CACHE = 200_000


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word; from two on its ends are marked."""
    w = word if n == 1 else f"\x02{word}\x03"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


@dataclass
class Model:
    langs: list[str]
    #: Row of each entry in ``votes`` by length (0: whole words).
    tables: dict[int, dict[str, int]]
    #: Log frequencies, a column for each language.
    votes: np.ndarray
    prior: np.ndarray
    longest: int = 5

    def entries(self, word: str) -> list[int]:
        """Rows whose mean is the word's vote; none if nothing is known."""
        known = self.tables[0].get(word)
        if known is not None:
            return [known]
        for n in range(self.longest, 0, -1):
            get = self.tables[n].get
            found = [r for g in grams(word, n) if (r := get(g)) is not None]
            if found:
                return found
        return []


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_docs: int = 2000, longest: int = 5) -> Model:
    """Fit on at most about ``train_docs`` rows of each language."""
    sizes = {r[0]: r[1] for r in labelled.filter(F.col(lang_col).isNotNull()).groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {n: {} for n in range(longest + 1)}, np.zeros((0, 0)), np.zeros(0), longest)
    keep: Column = F.lit(False)
    for lang in langs:
        keep = keep | ((F.col(lang_col) == lang) & by_hash(id_col, bounded_fraction(sizes[lang], train_docs), 11))
    sample = labelled.filter(keep).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch["lang"], batch["text"]):
                words[lang].update(WORD.findall((text or "").lower()))
            rows = []
            for lang, seen in words.items():
                own: dict[int, Counter] = defaultdict(Counter)
                own[0] = seen
                for w, c in seen.items():
                    for n in range(1, longest + 1):
                        for g in grams(w, n):
                            own[n][g] += c
                rows += [(lang, n, g, c) for n, table in own.items() for g, c in table.items()]
            yield pd.DataFrame(rows, columns=["lang", "n", "gram", "count"])

    each = [F.sum(F.when(F.col("lang") == lang, F.col("count")).otherwise(0)).alias(f"c{i}") for i, lang in enumerate(langs)]
    counts = sample.mapInPandas(count, "lang string, n int, gram string, count long").groupBy("n", "gram").agg(*each).toArrow()
    lengths = counts["n"].to_numpy()
    grams_ = counts["gram"].to_pylist()
    of = np.stack([counts[f"c{i}"].to_numpy() for i in range(len(langs))], axis=1)
    tables: dict[int, dict[str, int]] = {n: {} for n in range(longest + 1)}
    votes = np.zeros((len(grams_), len(langs)), np.float32)
    used = 0
    for n in range(longest + 1):
        at = sorted(np.flatnonzero(lengths == n).tolist(), key=grams_.__getitem__)
        tables[n] = {grams_[i]: used + k for k, i in enumerate(at)}
        votes[used : used + len(at)] = np.log((of[at] + 0.5) / (of[at].sum(axis=0) + 0.5 * max(1, len(at))))
        used += len(at)
    prior = np.log(np.array([sizes[x] for x in langs], float) / sum(sizes.values()))
    return Model(langs, tables, votes, prior, longest)


class _Scorer:
    """Rows of votes by raw token; a text's new tokens are worked out together."""

    def __init__(self, model: Model) -> None:
        self.model, self.width = model, len(model.langs)
        self._reset()

    def _reset(self) -> None:
        outer, model = self, self.model

        class Rows(dict):
            def __missing__(self, token: str) -> int:
                found = [model.entries(w) for w in WORD.findall(token.lower())]
                known = [x for x in found if x]
                if known:
                    row = outer.used
                    outer.used += 1
                    outer.new.append((row, known, len(found)))
                else:
                    row = 1 if found else 0
                self[token] = row
                return row

        self.rows, self.new = Rows(), []
        # Votes, number of voting words, number of words with a letter.
        self.table = np.zeros((4096, self.width + 2))
        self.table[1, self.width + 1] = 1
        self.used = 2

    def _settle(self) -> None:
        """Fill the rows of new tokens: the sum over words of their entries' means."""
        while self.used > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        words = [(row, w) for row, known, _ in self.new for w in known]
        n = np.array([len(w) for _, w in words])
        flat = np.fromiter((x for _, w in words for x in w), np.int64, int(n.sum()))
        means = np.add.reduceat(self.model.votes[flat], np.cumsum(n) - n, axis=0) / n[:, None]
        where = np.array([row for row, _ in words])
        first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        self.table[where[first], : self.width] = np.add.reduceat(means, first, axis=0)
        self.table[where[first], self.width] = [len(known) for _, known, _ in self.new]
        self.table[where[first], self.width + 1] = [n for _, _, n in self.new]
        self.new = []

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not self.width or not text:
            return "und", 0.0
        if len(self.rows) > CACHE:
            self._reset()
        tokens = text.split()
        ids = np.fromiter(map(self.rows.__getitem__, tokens), np.int64, len(tokens))
        if self.new:
            self._settle()
        total = self.table[ids].sum(axis=0) if len(ids) < 50_000 else sum(self.table[ids[i : i + 50_000]].sum(axis=0) for i in range(0, len(ids), 50_000))
        if not total[-1]:
            return "und", 0.0
        # Words of a text aren't independent; the root keeps scores off 1.
        logits = total[: self.width] / math.sqrt(max(total[-2], 1.0)) + self.model.prior * (total[-2] == 0)
        best = int(logits.argmax())
        return self.model.langs[best], float(1 / np.exp(logits - logits[best]).sum())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _Scorer(sent.value)
        for batch in batches:
            found = [score(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
