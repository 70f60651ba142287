"""Hashed maximum-entropy language model with a class-factored softmax.

Tokens are words (bytes lower-cased in A-Z, split at ASCII white space) and one
end for each text. A token's probability is P(class | context) times
P(slot | class, context) times P(token | slot). Words belong to a unit, a hash
of the whole of a short word or of a longer word's last letters; units whose
tokens follow like tokens form a class (k-means over all training bigrams of
units). In a class the commonest words have a slot each; all others share
slots by a hash, and inside a shared slot the distribution is the add-one
unigram one with room for one unknown word. So probabilities sum to one over
the training words and an unknown one for each shared slot.

Both softmaxes are maximum-entropy models over hashed features of the context:
for classes the previous word, the one before it (a skip), both together, and
the two words' classes; for slots the previous word and its class. Every class
has slots, so the features reach every word.

Counts cover all training texts. Weights come from ``rounds`` of distributed
gradient updates, which together see every training text once: each task takes
blockwise AdaGrad steps, on all features and biases at every step, on its share
of the round's texts from the same weights, and the tasks' changes are
averaged, weighted by how often a task used a row. Weights have a fixed size,
as have the tables sent to tasks: counts of words outside the ``heavy``
commonest are joined, not sent.

Null text counts as empty (one end). Without training texts the model is
uniform over its classes and slots. Null ids keep their rows, and repeated rows
count as often as they occur. Other columns are ignored. An empty table gives
an empty result. Texts have no length limit.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remainder, shuffle_partitions

END = b""  # no word is empty
CLASSES, SLOTS, OWN = 16, 16, 8
PLACES = CLASSES * SLOTS
UNITS, NEAR = 1024, 64
#: Rows of class weights: previous word, skipped word, both, both classes, bias.
ONE, TWO, BOTH, PAIR = 4096, 4096, 16384, (CLASSES + 1) ** 2
ROWS = ONE + TWO + BOTH + PAIR + 1
#: Rows of slot weights of a class: previous word, its class, bias.
IN_ONE = 512
IN_CLASS = IN_ONE + CLASSES + 1 + 1
IN_ROWS = IN_CLASS * CLASSES
#: Code of the place before a text's first word: no class has it.
HASHES = 1 << 17
START = PLACES * (HASHES + 1)
#: Words outside the vocabulary's table that a task remembers.
EXTRA = 200_000
BLOCK = 400_000
STEP = 16384
FLOOR = -30.0


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def unit_of(token: bytes) -> int:
    """Short words stand for themselves, longer ones for their last letters."""
    return zlib.crc32(token if len(token) < 5 else token[-3:]) % UNITS


def code_of(token: bytes, own: dict[bytes, int], class_of_unit: np.ndarray) -> int:
    """Place (class and slot) of a word; in a shared slot also a hash of it."""
    at = own.get(token)
    if at is not None:
        return at
    h = zlib.crc32(token)
    return int(class_of_unit[unit_of(token)]) * SLOTS + OWN + (h >> 20) % (SLOTS - OWN) + PLACES * (1 + h % HASHES)


def _mix(x: np.ndarray, size: int) -> np.ndarray:
    """Hash into ``size`` rows, a power of two."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def features(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Class and slot of each token, rows of class weights, rows of slot weights.

    ``starts`` marks the first token of each text.
    """
    one = np.append(START, codes[:-1])
    two = np.append(np.array([START, START]), codes[:-2])[: len(codes)]
    first = np.flatnonzero(starts)
    one[first] = two[first] = START
    second = first + 1
    second = second[second < len(codes)]
    two[second[~starts[second]]] = START
    place = codes % PLACES
    own, slot = place // SLOTS, place % SLOTS
    k1 = np.append(CLASSES, own[:-1])
    k1[first] = CLASSES
    k2 = np.where(two == START, CLASSES, np.append(np.array([CLASSES, CLASSES]), own[:-2])[: len(codes)])
    h1 = _mix(one, ONE)
    rows = [h1, ONE + _mix(two, TWO), ONE + TWO + _mix(one * 1_000_003 + two, BOTH), ONE + TWO + BOTH + k1 * (CLASSES + 1) + k2]
    inner = [own * IN_CLASS + h1 % IN_ONE, own * IN_CLASS + IN_ONE + k1]
    return own, slot, [x.astype(np.uint16) for x in rows], [x.astype(np.uint16) for x in inner]


BIAS = np.arange(1, CLASSES + 1) * IN_CLASS - 1


@dataclass
class Weights:
    outer: np.ndarray  # ROWS x CLASSES
    inner: np.ndarray  # IN_ROWS x SLOTS

    @staticmethod
    def initial(places: np.ndarray) -> Weights:
        """Biases at the unigram distribution of places, all else zero."""
        outer = np.zeros((ROWS, CLASSES), np.float32)
        inner = np.zeros((IN_ROWS, SLOTS), np.float32)
        by_class = places.reshape(CLASSES, SLOTS)
        total = by_class.sum(axis=1) + 1.0
        outer[-1] = np.log(total / total.sum())
        # A shared slot has room for unknown words; an own one needs its word.
        seen = by_class + (np.arange(SLOTS) >= OWN)
        inner[BIAS] = np.where(seen > 0, np.log(np.maximum(seen, 1e-9) / seen.sum(axis=1, keepdims=True)), FLOOR)
        return Weights(outer, inner)


def _softmax(logits: np.ndarray) -> np.ndarray:
    np.clip(logits, -60, 60, out=logits)
    np.exp(logits, out=logits)
    # Not by matrix product, which would start threads of its own.
    logits *= (1 / np.einsum("ij->i", logits))[:, None]
    return logits


def probabilities(w: Weights, own: np.ndarray, rows: list[np.ndarray], inner: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Class distribution of each token, and slot distribution in its class."""
    z = w.outer.take(rows[0], axis=0)
    for r in rows[1:]:
        z += w.outer.take(r, axis=0)
    z += w.outer[-1]
    y = w.inner.take(BIAS[own], axis=0)
    for r in inner:
        y += w.inner.take(r, axis=0)
    return _softmax(z), _softmax(y)


def _step(target: np.ndarray, sums: np.ndarray, used: np.ndarray, rows: np.ndarray, g: np.ndarray, times: np.ndarray, rate: float) -> None:
    """One AdaGrad step on distinct rows."""
    s = sums.take(rows, axis=0)
    s += g * g
    sums[rows] = s
    np.sqrt(s, out=s)
    np.divide(g, s, out=s)
    s *= -rate
    s += target.take(rows, axis=0)
    target[rows] = s
    used[rows] += times


def _scatter(target: np.ndarray, grads: np.ndarray, sums: np.ndarray, used: np.ndarray, index: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One AdaGrad step on the rows named by ``index``; rows, gradients, uses."""
    # Two-byte row numbers are sorted by radix.
    order = np.argsort(index, kind="stable")
    at = index[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    # Pairs of floats are added as one complex number.
    g = np.add.reduceat(grads.take(order, axis=0).view(np.complex64), first, axis=0).view(np.float32)
    rows, times = at[first], np.diff(np.append(first, len(at)))
    _step(target, sums, used, rows, g, times, rate)
    return rows, g, times


def learn(w: Weights, codes: np.ndarray, starts: np.ndarray, state: dict, rate: float = 0.2) -> None:
    """Steps over a run of texts; ``state`` keeps sums of squares and uses."""
    own, slot, rows, inner = features(codes, starts)
    for at in range(0, len(codes), STEP):
        part = slice(at, at + STEP)
        k, r, q = own[part], [x[part] for x in rows], [x[part] for x in inner]
        p, y = probabilities(w, k, r, q)
        n = np.arange(len(k))
        p[n, k] -= 1
        y[n, slot[part]] -= 1
        for index in r:
            _scatter(w.outer, p, state["outer"], state["outer_used"], index, rate)
        _step(w.outer, state["outer"], state["outer_used"], np.array([ROWS - 1]), np.einsum("ij->j", p)[None, :], np.array([len(k)]), rate)
        for index in q:
            at_, g, times = _scatter(w.inner, y, state["inner"], state["inner_used"], index, rate)
        # The last rows are in order of class, so a class's sum is its bias's.
        first = np.flatnonzero(np.append(True, np.diff(at_ // IN_CLASS) > 0))
        _step(w.inner, state["inner"], state["inner_used"], BIAS[at_[first] // IN_CLASS], np.add.reduceat(g, first, axis=0), np.add.reduceat(times, first), rate)


def score_codes(w: Weights, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 of each token's class and slot."""
    own, slot, rows, inner = features(codes, starts)
    out = np.empty(len(codes))
    for at in range(0, len(codes), STEP):
        part = slice(at, at + STEP)
        k = own[part]
        p, y = probabilities(w, k, [x[part] for x in rows], [x[part] for x in inner])
        n = np.arange(len(k))
        out[part] = np.log10(np.maximum(p[n, k], 1e-30).astype(float)) + np.log10(np.maximum(y[n, slot[part]], 1e-30).astype(float))
    return out


@dataclass
class Vocabulary:
    """What every task knows: the commonest words, and totals over all words."""

    tokens: list[bytes]
    counts: np.ndarray
    codes: np.ndarray
    own: dict[bytes, int]
    class_of_unit: np.ndarray
    total: int  # N
    distinct: int  # V
    #: log10 of the add-one unigram mass of each place; 0 for own slots.
    mass: np.ndarray
    _lexicon: _Lexicon | None = field(default=None, repr=False)

    def base(self, count: np.ndarray | int) -> np.ndarray:
        return np.log10((np.asarray(count) + 1) / (self.total + self.distinct + 1))

    def lexicon(self) -> _Lexicon:
        """One for a worker; later tasks go on with it."""
        if self._lexicon is None:
            self._lexicon = _Lexicon(self)
        return self._lexicon

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_lexicon": None}


class _Lexicon(dict):
    """Token to number: the vocabulary's words first, then others as they come."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__(zip(vocabulary.tokens, range(len(vocabulary.tokens))))
        self.v, self.first = vocabulary, len(vocabulary.tokens)
        self.names: list[bytes] = []
        self.more = array("q")

    def __missing__(self, token: bytes) -> int:
        number = self.first + len(self.names)
        self.names.append(token)
        self.more.append(code_of(token, self.v.own, self.v.class_of_unit))
        self[token] = number
        return number

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))

    def codes(self, numbers: np.ndarray) -> np.ndarray:
        return np.concatenate([self.v.codes, np.array(self.more, np.int64)])[numbers]

    def trim(self) -> None:
        if len(self.names) > EXTRA:
            for t in self.names:
                del self[t]
            self.names, self.more = [], array("q")


def _key(unit: int, near: int) -> bytes:
    """Key of a bigram of units in the table of counts: no token has a space."""
    return b" %d %d" % (unit, near)


def count_tokens(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """token (binary) and count over all texts; summed before the shuffle.

    Keys that begin with a space count bigrams of units.
    """

    class Numbers(dict):
        def __init__(self) -> None:
            super().__init__()
            self.units = array("q")

        def __missing__(self, token: bytes) -> int:
            self[token] = number = len(self)
            self.units.append(unit_of(token))
            return number

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, counts = Numbers(), np.zeros(0, np.int64)
        near = np.zeros((UNITS, NEAR), np.int64)

        def settle(held: list[np.ndarray]) -> None:
            nonlocal counts
            ids = np.concatenate(held)
            own = np.bincount(ids, minlength=len(seen))
            own[: len(counts)] += counts
            counts = own
            units = np.array(seen.units, np.int64)[ids]
            before = np.append(0, units[:-1] % (NEAR - 1) + 1)
            before[np.cumsum([0, *map(len, held[:-1])])] = 0
            near.ravel()[:] += np.bincount(units * NEAR + before, minlength=UNITS * NEAR)

        def table() -> pd.DataFrame:
            return pd.DataFrame({"token": list(seen), "count": counts})

        for batch in batches:
            held, size = [], 0
            for text in batch["text"]:
                tokens = tokens_of(text)
                held.append(np.fromiter(map(seen.__getitem__, tokens), np.int64, len(tokens)))
                size += len(tokens)
                if size > BLOCK:
                    settle(held)
                    held, size = [], 0
                    if len(seen) > 2 * EXTRA:
                        yield table()
                        seen, counts = Numbers(), np.zeros(0, np.int64)
            if held:
                settle(held)
        yield table()
        u, n = np.nonzero(near)
        yield pd.DataFrame({"token": [_key(a, b) for a, b in zip(u.tolist(), n.tolist())], "count": near[u, n]})

    return texts.select(F.col(text_col).alias("text")).mapInPandas(run, "token binary, count long").groupBy("token").agg(F.sum("count").alias("count"))


def cluster(near: np.ndarray, classes: int = CLASSES, rounds: int = 30) -> np.ndarray:
    """Class of each unit: weighted k-means of the roots of what precedes it."""
    weight = near.sum(axis=1).astype(float)
    points = np.sqrt((near + 1e-9) / (near + 1e-9).sum(axis=1, keepdims=True))
    rng = np.random.default_rng(7)
    centres = points[[int(weight.argmax())]]
    for _ in range(classes - 1):
        far = np.maximum(0, 1 - (points @ centres.T).max(axis=1)) * weight
        pick = int(rng.choice(len(points), p=far / far.sum())) if far.sum() > 0 else 0
        centres = np.concatenate([centres, points[[pick]]])
    own = np.zeros(len(points), np.int64)
    for _ in range(rounds):
        own = np.round(points @ centres.T, 9).argmax(axis=1)
        for k in range(classes):
            m = (points * weight[:, None])[own == k].sum(axis=0)
            if m.any():
                centres[k] = m / np.linalg.norm(m)
    return own


def read_vocabulary(counts: DataFrame, heavy: int) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary, and token counts by place."""
    near = np.zeros((UNITS, NEAR), np.int64)
    pairs = counts.filter(F.substring("token", 1, 1) == F.lit(b" ")).toArrow()  # at most UNITS x NEAR rows
    for key, c in zip(pairs["token"].to_pylist(), pairs["count"].to_pylist()):
        u, n = key.split()
        near[int(u), int(n)] = c
    class_of_unit = cluster(near)
    words_only = counts.filter(F.substring("token", 1, 1) != F.lit(b" "))
    # Counts by size, to find from which count on at most ``heavy`` words are left.
    step = F.floor(F.log2("count") * 8)
    least, words_left = None, 0
    for r in sorted(words_only.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).collect(), key=lambda r: -r["step"]):
        words_left += r["n"]
        if words_left > heavy:
            break
        least = r["least"]
    top = words_only.filter(F.col("count") >= least).toArrow() if least is not None else None
    tokens, sizes = (top["token"].to_pylist(), top["count"].to_numpy()) if top is not None else ([], np.zeros(0, np.int64))
    order = sorted(range(len(tokens)), key=lambda i: (-sizes[i], tokens[i]))
    tokens, sizes = [tokens[i] for i in order], sizes[order]
    own: dict[bytes, int] = {}
    places = np.zeros(PLACES)
    taken = [0] * CLASSES
    for t, c in zip(tokens, sizes.tolist()):
        k = int(class_of_unit[unit_of(t)])
        if taken[k] < OWN:
            own[t] = k * SLOTS + taken[k]
            places[own[t]] = c
            taken[k] += 1
            if len(own) == CLASSES * OWN:
                break

    def by_place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, types = np.zeros(PLACES, np.int64), np.zeros(PLACES, np.int64)
        for batch in batches:
            at = np.fromiter((code_of(bytes(t), own, class_of_unit) % PLACES for t in batch["token"]), np.int64, len(batch))
            np.add.at(total, at, batch["count"].to_numpy())
            np.add.at(types, at, 1)
        some = np.flatnonzero(types)
        yield pd.DataFrame({"k": some, "total": total[some], "types": types[some]})

    mass = np.zeros(PLACES)
    n = v = 0
    for k, c, t in words_only.mapInPandas(by_place, "k int, total long, types long").groupBy("k").agg(F.sum("total"), F.sum("types")).collect():
        n, v = n + c, v + t
        if k % SLOTS >= OWN:
            places[k], mass[k] = c, math.log10(c + t + 1)
    codes = np.array([code_of(t, own, class_of_unit) for t in tokens], np.int64)
    return Vocabulary(tokens, sizes.astype(np.int64), codes, own, class_of_unit, n, v, mass), places


def _blocks(batches: Iterator[pd.DataFrame], lexicon: _Lexicon, limit: int = BLOCK):
    """Runs of whole texts: ids, numbers, codes, starts."""
    held: list[tuple] = []
    size = 0

    def flush():
        starts = np.zeros(size, bool)
        starts[np.cumsum([0, *(len(h[1]) for h in held[:-1])])] = True
        numbers = np.concatenate([h[1] for h in held])
        return [h[0] for h in held], numbers, lexicon.codes(numbers), starts

    for batch in batches:
        for key, text in zip(batch["id"], batch["text"]):
            held.append((key, lexicon.numbers(tokens_of(text))))
            size += len(held[-1][1])
            if size >= limit:
                yield flush()
                held, size = [], 0
                lexicon.trim()
    if held:
        yield flush()
        lexicon.trim()


def train(texts: DataFrame, vocabulary: Vocabulary, places: np.ndarray, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, rate: float = 0.2) -> Weights:
    """Rounds of distributed updates; each sees its own share of the texts."""
    w = Weights.initial(places)
    sc = texts.sparkSession.sparkContext
    known = sc.broadcast(vocabulary)
    share = F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(rounds))
    for r in range(rounds):
        sent = sc.broadcast(w)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            start = sent.value  # noqa: B023
            now = Weights(start.outer.copy(), start.inner.copy())
            state = {"outer": np.full_like(now.outer, 1.0), "inner": np.full_like(now.inner, 1.0), "outer_used": np.zeros(ROWS, np.int64), "inner_used": np.zeros(IN_ROWS, np.int64)}
            for _, _, codes, starts in _blocks(batches, known.value.lexicon()):
                learn(now, codes, starts, state, rate)
            for which, name in enumerate(("outer", "inner")):
                used = state[f"{name}_used"]
                rows = np.flatnonzero(used)
                if len(rows):
                    change = (getattr(now, name) - getattr(start, name))[rows].astype(np.float32)
                    yield pd.DataFrame({"which": which, "row": rows, "used": used[rows].astype(float), "change": [x.tobytes() for x in change]})

        parts = texts.filter(share == r).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "which int, row long, used double, change binary")

        def mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = [np.zeros((ROWS, CLASSES)), np.zeros((IN_ROWS, SLOTS))]
            used = [np.zeros(ROWS), np.zeros(IN_ROWS)]
            for batch in batches:
                for which, own in batch.groupby("which"):
                    change = np.frombuffer(b"".join(own["change"]), np.float32).reshape(len(own), -1)
                    np.add.at(total[which], own["row"].to_numpy(), change * own["used"].to_numpy()[:, None])
                    np.add.at(used[which], own["row"].to_numpy(), own["used"].to_numpy())
            for which in (0, 1):
                rows = np.flatnonzero(used[which])
                if len(rows):
                    yield pd.DataFrame({"which": which, "row": rows, "change": [x.tobytes() for x in (total[which][rows] / used[which][rows, None]).astype(np.float32)]})

        averaged = parts.repartition(shuffle_partitions(texts.sparkSession), "which", "row").mapInPandas(mean, "which int, row long, change binary").toArrow().to_pandas()
        outer, inner = w.outer.copy(), w.inner.copy()
        for which, own in averaged.groupby("which"):
            change = np.frombuffer(b"".join(own["change"]), np.float32).reshape(len(own), -1)
            # Rounded, so that the order of sums leaves no trace.
            (outer if which == 0 else inner)[own["row"].to_numpy()] += np.round(change, 4)
        w = Weights(outer, inner)
        sent.unpersist()
    return w


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, w: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_tokens, n_known, base_score and score."""
    sc = docs.sparkSession.sparkContext
    known, sent = sc.broadcast(vocabulary), sc.broadcast(w)
    unit = float(vocabulary.base(0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, w = known.value, sent.value
        lexicon = v.lexicon()
        bases = np.append(v.base(v.counts), 0.0)  # the last place stands for words that are joined
        for ids, numbers, codes, starts in _blocks(batches, lexicon):
            first = np.flatnonzero(starts)
            ends = np.append(first[1:], len(codes))
            own = bases[np.minimum(numbers, lexicon.first)]
            joined = numbers >= lexicon.first
            place = codes % PLACES
            model = score_codes(w, codes, starts)
            # In shared slots: log10((c + 1) / mass) = base - unit - mass.
            model += np.where(place % SLOTS >= OWN, own - unit - v.mass[place], 0.0)
            n_joined = np.add.reduceat(joined.astype(np.int64), first)
            uids = np.array([x[0] for x in ids], np.int64)
            keys = pd.Series([x[1] for x in ids], dtype=object)
            n = ends - first
            yield pd.DataFrame({"uid": uids, "id": keys, "token": [b" #%d" % x for x in uids.tolist()], "times": 0, "n_tokens": n, "n_known": n - n_joined, "base": np.add.reduceat(own, first), "model": np.add.reduceat(model, first)})
            at = np.flatnonzero(joined)
            if len(at):
                text = np.searchsorted(first, at, side="right") - 1
                pair, times = np.unique(text * (EXTRA + BLOCK * 4 + len(lexicon.names)) + numbers[at] - lexicon.first, return_counts=True)
                text, word = np.divmod(pair, EXTRA + BLOCK * 4 + len(lexicon.names))
                names = lexicon.names
                yield pd.DataFrame({"uid": uids[text], "id": keys.to_numpy()[text], "token": [names[i] for i in word.tolist()], "times": times, "n_tokens": 0, "n_known": 0, "base": 0.0, "model": 0.0})

    kind = docs.schema[id_col].dataType.simpleString()
    # Rows may share an id; each text has its own number beside it.
    picked = docs.select(F.struct(F.xxhash64(F.col(text_col)).alias("uid"), F.col(id_col).alias("key")).alias("id"), F.col(text_col).alias("text"))
    schema = f"uid long, id {kind}, token binary, times int, n_tokens long, n_known long, base double, model double"

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def tuples():
            for batch in batches:
                ids = batch["id"]
                keys = list(zip(ids["uid"], ids["key"])) if isinstance(ids, pd.DataFrame) else [(x["uid"], x["key"]) for x in ids]
                yield pd.DataFrame({"id": pd.Series(keys, dtype=object), "text": batch["text"]})

        yield from run(tuples())

    parts = picked.mapInPandas(unpack, schema)
    joined = parts.join(counts, "token", "left")
    c = F.coalesce(F.col("count"), F.lit(0))
    base = F.col("times") * F.log10((c + 1) / F.lit(float(vocabulary.total + vocabulary.distinct + 1)))
    own = F.col("n_tokens") > 0
    found = joined.groupBy("uid", "id").agg(
        F.sum(own.cast("long")).alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(own, 0.0).otherwise(base)).alias("base_score"),
        # A joined word is in a shared slot; its count adds log10(c + 1) there.
        F.sum(F.col("model") + F.when(own, 0.0).otherwise(base)).alias("score"),
    )
    # Equal rows were summed together; each gets its share back.
    each = found.select(F.col("id").alias(id_col), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"), *[(F.col(x) / F.col("copies")).cast(t).alias(x) for x, t in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"))])
    return each.drop("_copy")


def fit(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 300_000, rounds: int = 3, rate: float = 0.2) -> tuple[DataFrame, Vocabulary, Weights]:
    """Counts, vocabulary and weights from all training texts."""
    counts = materialize(count_tokens(training, text_col), "token-counts")
    vocabulary, places = read_vocabulary(counts, heavy)
    return counts, vocabulary, train(training, vocabulary, places, id_col, text_col, rounds, rate)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, **options) -> DataFrame:
    """Learn from all but the held-out remainder; score every text."""
    counts, vocabulary, w = fit(docs.filter(remainder(id_col, modulus) != held), id_col, text_col, **options)
    return score(docs, counts, vocabulary, w, id_col, text_col).withColumn("train_tokens", F.lit(vocabulary.total).cast("long"))
