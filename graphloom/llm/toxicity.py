"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-case words and the starts and ends of its longer
words, hashed to ``buckets``. The machine scores
``b + sum(w_i) + sum_{i<j} <v_i, v_j>`` over the terms present, so that pairs
of terms weigh beyond the sum of their own weights.

Learning takes a bounded sample of labelled rows: at most ``train_docs`` of
each label, chosen by a hash of the id. All buckets whose presence tells about
the label beyond chance enter the machine. So do the two of every pair whose
joint presence tells beyond chance what a machine of the former leaves open:
all pairs are tested of buckets in at least ``pair_share`` of the sample, in
blocks of columns dealt over tasks. What is collected and broadcast is bounded
by the sample and the number of buckets. Every whole text is scored.

Null and empty texts have no terms and get the score of the bias alone. Null
labels are not learned from; without both labels in the sample every score is
the share of label 1 (0 if there is none). Repeated labels count as often as
they occur, but an id's text is joined once. Null ids keep their rows. Other
columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_fraction, by_hash, materialize

WORD = re.compile(r"\w+")
CACHE = 200_000


def terms(token: str, buckets: int) -> list[int]:
    """Buckets of the words in a raw token, and of their starts and ends."""
    out = []
    for w in WORD.findall(token.lower()):
        out.append(zlib.crc32(w.encode()) % buckets)
        if len(w) > 5:
            out.append(zlib.crc32(b"\x02" + w[:5].encode()) % buckets)
            out.append(zlib.crc32(b"\x03" + w[-5:].encode()) % buckets)
    return out


class _Terms(dict):
    """Raw token to tuple of (kept) buckets, worked out once."""

    def __init__(self, buckets: int, kept: dict[int, int] | None) -> None:
        super().__init__()
        self.buckets, self.kept = buckets, kept

    def __missing__(self, token: str) -> tuple[int, ...]:
        own = terms(token, self.buckets)
        if self.kept is not None:
            own = [self.kept[x] for x in own if x in self.kept]
        if len(self) > CACHE:
            self.clear()
        self[token] = tuple(own)
        return self[token]

    def of(self, text: str | None) -> list[int]:
        found: set[int] = set()
        for t in set((text or "").split()):
            found.update(self[t])
        return sorted(found)


@dataclass
class Machine:
    buckets: int
    kept: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, ids: list[int]) -> float:
        if not ids:
            return self.bias
        v = self.factors[ids]
        s = v.sum(axis=0)
        return float(self.bias + self.weights[ids].sum() + 0.5 * (s @ s - (v * v).sum()))


def fit(rows: list[np.ndarray], labels: np.ndarray, size: int, rank: int = 4, epochs: int = 400, rate: float = 0.3, l2: float = 1e-4, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Full-batch AdaGrad on the log loss; rows are arrays of term numbers."""
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(size), rng.normal(0, 0.01, (size, rank)), float(np.log((labels.mean() + 1e-9) / (1 - labels.mean() + 1e-9)))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
    which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64) if len(which) else np.zeros(0, np.int64)
    n = len(rows)
    tell = lambda x: np.bincount(which, x, n)
    sums = lambda x: np.bincount(flat, x, size)
    for _ in range(epochs):
        # One factor at a time: all at once would hold several numbers a term and factor.
        s, squares = np.zeros((n, rank)), np.zeros(len(flat))
        for k in range(rank):
            vf = v[flat, k]
            s[:, k] = tell(vf)
            squares += vf * vf
        z = b + tell(w[flat]) + 0.5 * ((s * s).sum(axis=1) - tell(squares))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        ef = e[which]
        dw = sums(ef) + l2 * w / max(size, 1)
        dv = np.stack([sums(ef * (s[which, k] - v[flat, k])) for k in range(rank)], axis=1) + l2 * v / max(size, 1)
        db = e.sum()
        gw, gv, gb = gw + dw * dw, gv + dv * dv, gb + db * db
        w, v, b = w - rate * dw / np.sqrt(gw), v - rate * 0.3 * dv / np.sqrt(gv), b - rate * db / np.sqrt(gb)
    return float(b), w, v


def chance(tests: int) -> float:
    """About the largest of so many standard normal values."""
    return max(3.0, math.sqrt(2 * math.log(max(1, tests))))


def telling_pairs(rows: DataFrame, size: int, block: int = 512) -> set[int]:
    """Columns below ``size`` in pairs whose joint presence goes with the residuals.

    ``rows`` is (no, residual, variance, columns), a row a document. Documents'
    columns are dealt by block to the tasks of their pairs of blocks; nothing
    but the columns found comes to the driver.
    """
    blocks = -(-size // block)
    least = chance(size * (size - 1) // 2) + 0.5
    tasks = [(i, j) for i in range(blocks) for j in range(i + 1)]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for no, r, v, columns in zip(batch["no"], batch["residual"], batch["variance"], batch["columns"]):
                own = np.asarray(columns, np.int64)
                out += [(k, no, r, v, (own[own // block == k] % block).astype(np.int16).tobytes()) for k in np.unique(own // block).tolist()]
            yield pd.DataFrame(out, columns=["block", "no", "r", "v", "cells"])

    def test(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = tasks[int(rows["task"].iat[0])]
        # Documents in order of their number, so that sums don't depend on how rows came.
        numbers, at = np.unique(rows["no"].to_numpy(), return_index=True)
        place = {no: n for n, no in enumerate(numbers.tolist())}
        r, v = rows["r"].to_numpy(np.float32)[at], rows["v"].to_numpy(np.float32)[at]

        def part(k: int) -> np.ndarray:
            x = np.zeros((len(numbers), block), np.float32)
            for no, cells in rows.loc[rows["block"] == k, ["no", "cells"]].itertuples(index=False):
                x[place[no], np.frombuffer(cells, np.int16)] = 1
            return x

        x, y = part(i), part(j) if i != j else None
        y = x if y is None else y
        z = np.abs((x * r[:, None]).T @ y)
        z /= np.sqrt((x * v[:, None]).T @ y + 1e-3)
        a, b = np.nonzero(z >= least)
        a, b = a + i * block, b + j * block
        return pd.DataFrame({"column": np.unique(np.concatenate([a[a != b], b[a != b]]))})

    of_block = F.array(*[F.array(*[F.lit(t) for t, pair in enumerate(tasks) if k in pair]) for k in range(blocks)])
    dealt = rows.mapInPandas(deal, "block int, no long, r double, v double, cells binary").withColumn("task", F.explode(F.element_at(of_block, F.col("block") + 1)))
    return {r[0] for r in dealt.groupBy("task").applyInPandas(test, "column long").distinct().collect()}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = 4000, buckets: int = 1 << 18, pair_share: float = 0.02, rank: int = 4) -> Machine:
    """Fit on at most about ``train_docs`` labelled rows of each label."""
    known = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label"))
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    pick = F.lit(False)
    for label in (0, 1):
        pick = pick | ((F.col("label") == label) & by_hash("id", bounded_fraction(sizes.get(label, 0), train_docs), 5))
    sample = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known.filter(pick)), "id").withColumn("no", F.monotonically_increasing_id()), "toxic-sample")

    def presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = _Terms(buckets, None)
        total = np.zeros((2, buckets), np.int64)
        seen = [0, 0]
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                total[label, of.of(text)] += 1
                seen[label] += 1
        some = np.flatnonzero(total.any(axis=0))
        yield pd.DataFrame({"bucket": np.append(some, -1), "n0": np.append(total[0, some], seen[0]), "n1": np.append(total[1, some], seen[1])})

    table = sample.mapInPandas(presence, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow().to_pandas()
    all_ = table[table["bucket"] < 0]
    n0, n1 = (int(all_[c].sum()) for c in ("n0", "n1"))
    if not n0 or not n1:
        p = min(max(float(share), 0.0), 1.0)
        return Machine(buckets, {}, float(np.log((p + 1e-6) / (1 - p + 1e-6))), np.zeros(0), np.zeros((0, rank)))
    table = table[table["bucket"] >= 0].sort_values("bucket")
    p0, p1 = (table["n0"] + 0.5) / (n0 + 1), (table["n1"] + 0.5) / (n1 + 1)
    pooled = (table["n0"] + table["n1"] + 1) / (n0 + n1 + 2)
    z = (p1 - p0) / np.sqrt(pooled * (1 - pooled) * (1 / (n0 + 1) + 1 / (n1 + 1)))
    single = {int(x) for x in table["bucket"][z.abs() >= chance(len(table))]}
    common = table["bucket"][table["n0"] + table["n1"] >= max(2, pair_share * (n0 + n1))].to_numpy()

    def vectors(wanted: dict[int, int]) -> DataFrame:
        """Columns of the wanted buckets in each document of the sample."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of = _Terms(buckets, wanted)
            for batch in batches:
                yield pd.DataFrame({"no": batch["no"], "label": batch["label"], "columns": [of.of(t) for t in batch["text"]]})

        return sample.mapInPandas(run, "no long, label int, columns array<int>")

    def machine(chosen: set[int]) -> tuple[Machine, np.ndarray, list[np.ndarray], np.ndarray]:
        """Fitted on some buckets, for the sample's share of labels; documents' numbers, columns and labels."""
        index = {x: i for i, x in enumerate(sorted(chosen))}
        data = vectors(index).toArrow()
        numbers, labels_, columns = data["no"].to_numpy(), data["label"].to_numpy(), data["columns"].combine_chunks()
        flat, ends = columns.flatten().to_numpy(), np.cumsum(columns.value_lengths().to_numpy())
        rows = np.split(flat, ends[:-1])
        # A total order, so that sums don't depend on how tasks ended; big-endian bytes stand in the order of the columns.
        order = sorted(range(len(rows)), key=lambda i: (labels_[i], rows[i].astype(">i4").tobytes(), numbers[i]))
        rows, labels_ = [rows[i] for i in order], labels_[order].astype(float)
        return Machine(buckets, index, *fit(rows, labels_, len(index), rank)), numbers[order], rows, labels_

    found, numbers, rows, labels_ = machine(single)
    if len(common) > 1:
        p = 1 / (1 + np.exp(-np.clip([found.logit(r.tolist()) for r in rows], -30, 30)))
        left = docs.sparkSession.createDataFrame(pd.DataFrame({"no": numbers, "residual": labels_ - p, "variance": p * (1 - p) + 0.01}))
        places = {int(x): i for i, x in enumerate(common)}
        more = {int(common[c]) for c in telling_pairs(vectors(places).join(F.broadcast(left), "no").select("no", "residual", "variance", "columns"), len(common))}
        if more - single:
            found = machine(single | more)[0]
    # The sample may hold the labels in another proportion than all rows.
    found.bias += float(np.log((share / (1 - share)) / (n1 / n0))) if 0 < share < 1 else 0.0
    return found


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = sent.value
        of = _Terms(machine.buckets, machine.kept)
        for batch in batches:
            z = np.array([machine.logit(of.of(t)) for t in batch["text"]])
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pd.DataFrame({"id": batch["id"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def reject(docs: DataFrame, machine: Machine, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose score is below ``threshold``; columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def prob(texts: pd.Series) -> pd.Series:
        machine = sent.value
        of = _Terms(machine.buckets, machine.kept)
        z = np.array([machine.logit(of.of(t)) for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.filter(prob(F.col(text_col)) < threshold)
