"""SimHash near-duplicates through deletion-variant signatures.

A text's fingerprint takes the majority of each bit over the XXH64 hashes of
its word shingles. Two fingerprints link at ``distance`` or fewer differing
bits. The fingerprint is cut into ``(distance + 1) // 2`` segments, few enough
that one of them differs by at most one bit; each segment is indexed under
every variant with one bit made a wildcard, and equal variants meet in a join
on the key. Each meeting is verified on the whole fingerprints.

A key's fingerprints are handled together up to ``run_limit``. Beyond it the
same scheme is applied again to the bits outside the key, so that a common key
splits by a second key: exact, without emitting pairs. A run gives at most one
edge for a fingerprint, to the smallest of its part of the run; the parts of
all runs are joined into components by large-star and small-star steps. Only
distinct fingerprints enter, so groups of exact copies cost one row.

Null text counts as empty; empty texts have fingerprint zero and link like any
other. Null ids never become a component's name unless nothing else is in it.
Repeated rows keep their rows. Other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, shuffle_partitions

BITS = 64
#: XXH64 seed.
SEED = 42
#: Runs of so many rows are linked pair by pair.
SHORT = 8


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits over the shingles' hashes, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    bits = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        parts = [joined[a:b] for a, b in zip(starts[at : min(n, at + (1 << 16))].tolist(), last[at : at + (1 << 16)].tolist())]
        h = np.array(list(map(xxhash.xxh64_intdigest, parts, repeat(SEED))), dtype=">u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Per row: the id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": batch["id"], "fp": fp.view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def segments(positions: list[int], distance: int) -> list[list[int]]:
    """Cut bit positions so that one segment differs by at most one bit."""
    n = max(1, (distance + 1 + 1) // 2)
    edges = [round(i * len(positions) / n) for i in range(n + 1)]
    return [positions[a:b] for a, b in zip(edges, edges[1:])]


def _mask(positions: list[int]) -> int:
    return sum(1 << p for p in positions)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(distance: int) -> list[tuple[int, int]]:
    """(key number, mask of the bits that the key fixes) of the first level."""
    return [(i, m) for i, m in enumerate(_mask(s) & ~(1 << p) for s in segments(list(range(BITS)), distance) for p in s)]


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def first_link(fps: np.ndarray, distance: int) -> np.ndarray:
    """For each of a run's fingerprints the first index within the distance."""
    n = len(fps)
    step = max(1, (1 << 22) // n)
    return np.concatenate([(popcount(fps[a : a + step, None] ^ fps[None, :]) <= distance).argmax(axis=1) for a in range(0, n, step)])


def link_run(fps: np.ndarray, distance: int) -> np.ndarray:
    """For each of a run's fingerprints the first index of its component.

    Blocks of the run meet all of it; memory stays at block x run.
    """
    n = len(fps)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    step = max(1, (1 << 22) // n)
    for a in range(0, n, step):
        near = popcount(fps[a : a + step, None] ^ fps[None, :]) <= distance
        # A row's smallest neighbour stands for it; other links may join roots.
        rows, cols = np.nonzero(near)
        rows += a
        keep = cols < rows
        rows, cols = rows[keep], cols[keep]
        while len(rows):
            roots = parent.copy()
            while True:  # flatten
                up = roots[roots]
                if (up == roots).all():
                    break
                roots = up
            parent = roots
            x, y = parent[rows], parent[cols]
            open_ = x != y
            if not open_.any():
                break
            hi, lo = np.maximum(x[open_], y[open_]), np.minimum(x[open_], y[open_])
            np.minimum.at(parent, hi, lo)
    for i in range(n):
        parent[i] = root(i)
    return parent


def first_met(differ: np.ndarray, key_no: np.ndarray, masks: list[np.uint64]) -> np.ndarray:
    """Whether pairs that differ in these bits meet under no key before ``key_no``."""
    met = np.zeros(len(differ), bool)
    for k, mask in enumerate(masks):
        met |= (k < key_no) & ((differ & mask) == 0)
    return ~met


def _short_runs(starts: np.ndarray, ends: np.ndarray, fp: np.ndarray, rep: np.ndarray, key_no: np.ndarray, before: list[np.uint64], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (greater, smaller name) inside runs of at most ``SHORT`` rows, together.

    Two fingerprints meet under many keys; a link is given under the first of
    them alone. ``before`` holds the masks of the keys in order.
    """
    lengths = ends - starts
    index = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    f, r, run, own = fp[index].view(np.uint64), rep[index], np.repeat(np.arange(len(starts)), lengths), key_no[index]
    a, b = [], []
    for lag in range(1, int(lengths.max())):
        near = np.flatnonzero((run[lag:] == run[:-lag]) & (popcount(f[lag:] ^ f[:-lag]) <= distance))
        near = near[first_met(f[near + lag] ^ f[near], own[near], before)]
        a.append(np.maximum(r[near + lag], r[near]))
        b.append(np.minimum(r[near + lag], r[near]))
    return np.concatenate(a), np.concatenate(b)


def _links(distance: int, run_limit: int, level: int, direct: bool):
    """Edges inside runs of equal keys; long runs come back under second keys.

    With ``direct`` no2 is -2 where a is one of a long run.
    """
    masks = dict(variants(distance))
    before = [np.uint64(m) for _, m in variants(distance)] if level == 1 else []

    def second(key_no: int) -> list[tuple[int, int]]:
        rest = [p for p in range(BITS) if not masks[key_no] >> p & 1]
        return [(i, m) for i, m in enumerate(_mask(s) & ~(1 << p) for s in segments(rest, distance) for p in s)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # of the open run: fps, reps
        size, long_run = 0, False

        def spill(key_no, fp, rep) -> pd.DataFrame:
            parts = [pd.DataFrame({"a": rep, "b": rep, "key_no": key_no, "key": fp & np.int64(_signed(masks[key_no])), "no2": i, "key2": fp & np.int64(_signed(m)), "fp": fp}) for i, m in second(key_no)]
            return pd.concat(parts)

        def close(fp, rep) -> Iterator[pd.DataFrame]:
            if len(fp) < 2:
                return
            order = np.argsort(rep, kind="stable")
            fp, rep = fp[order].view(np.uint64), rep[order]
            first = rep[(first_link if direct else link_run)(fp, distance)]
            a, b = (rep, first) if direct else (rep[rep != first], first[rep != first])
            if len(a):
                yield pd.DataFrame({"a": a, "b": b, "key_no": -1, "key": np.int64(0), "no2": -2 if direct else -1, "key2": np.int64(0), "fp": np.int64(0)})

        open_key = None
        for batch in batches:
            keys = batch[["key_no", "key", "no2", "key2"]].to_numpy()
            fp, rep = batch["fp"].to_numpy(), batch["rep"].to_numpy()
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            ends = np.append(starts[1:], len(keys))
            # Runs of one row inside the batch can't link; only its ends may go on.
            edge = (starts == 0) | (ends == len(keys))
            short = (ends - starts > 1) & (ends - starts <= SHORT) & ~edge
            if short.any():
                # Under second keys the first ones have the same number; each run stands for itself.
                a, b = _short_runs(starts[short], ends[short], fp, rep, keys[:, 0], before, distance)
                if len(a):
                    yield pd.DataFrame({"a": a, "b": b, "key_no": -1, "key": np.int64(0), "no2": -1, "key2": np.int64(0), "fp": np.int64(0)})
            some = (ends - starts > SHORT) | edge
            for s, e in zip(starts[some].tolist(), ends[some].tolist()):
                key = tuple(keys[s])
                if key != open_key:
                    if held and not long_run:
                        yield from close(*(np.concatenate(x) for x in zip(*held)))
                    open_key, held, size, long_run = key, [], 0, False
                if level == 1 and (long_run or size + e - s > run_limit):
                    for part in [*held, (fp[s:e], rep[s:e])]:
                        yield spill(int(key[0]), *part)
                    held, long_run = [], True
                else:
                    held.append((fp[s:e], rep[s:e]))
                    size += e - s
        if held and not long_run:
            yield from close(*(np.concatenate(x) for x in zip(*held)))

    return run


_EDGE = "a long, b long, key_no int, key long, no2 int, key2 long, fp long"


def edges(reps: DataFrame, distance: int = 3, run_limit: int = 4096, direct: bool = False) -> DataFrame:
    """Edges (a, b), b < a, that span the links among distinct fingerprints.

    With ``direct`` each edge is a link itself: all links of a short run, and
    in a long one those to the smallest name within the distance, be it a
    itself; a column, long, tells that a is one of a long run.

    ``reps`` has fp and rep, a long that names the fingerprint.
    """
    n = shuffle_partitions(reps.sparkSession)
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("key_no"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in variants(distance)])).alias("v")
    first = reps.select("fp", "rep", key).select(F.col("v.key_no"), F.col("v.key"), F.lit(-1).alias("no2"), F.lit(0).cast("long").alias("key2"), "fp", "rep")
    sort = ["key_no", "key", "no2", "key2"]
    one = materialize(first.repartition(n, *sort).sortWithinPartitions(*sort).mapInPandas(_links(distance, run_limit, 1, direct), _EDGE), "simhash-runs")
    more = one.filter("no2 >= 0").select("key_no", "key", "no2", "key2", "fp", F.col("a").alias("rep"))
    two = more.repartition(n, *sort).sortWithinPartitions(*sort).mapInPandas(_links(distance, run_limit, 2, direct), _EDGE)
    cols = ["a", "b", *([(F.col("no2") == -2).alias("long")] if direct else [])]
    return one.filter("no2 < 0").select(*cols).union(two.select(*cols)).distinct()


def components(edge: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest name reachable, for each name in an edge (a, b).

    Large-star and small-star steps (Kiveris et al., "Connected components in
    MapReduce and beyond") until nothing changes; each round is written.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    now = materialize(edge.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "components")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = smallest(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u > v").distinct(), "components")
        low = smallest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").union(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "components")
        changed = after.exceptAll(now).limit(1).count()
        now = after
        if not changed:
            return now.select(F.col("u").alias("name"), F.col("v").alias("component"))
    raise RuntimeError("components did not settle")


#: Stand-ins for rows without id begin here; ids must be below.
NAMELESS = 1 << 62


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """Per row: the id, fp and component_id, the smallest id reachable.

    A fingerprint that only rows without id have still links others; a
    component without any id has a null component_id.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    stand_in = F.lit(NAMELESS) + F.xxhash64("fp").bitwiseAND(F.lit(NAMELESS - 1))
    reps = materialize(fps.groupBy("fp").agg(F.min(id_col).cast("long").alias("rep")).select("fp", F.coalesce("rep", stand_in).alias("rep")), "representatives")
    found = components(edges(reps, distance))
    name = F.coalesce("component", "rep")
    named = reps.join(found, reps["rep"] == found["name"], "left").select("fp", F.when(name < NAMELESS, name).alias("component_id"))
    return fps.join(named, "fp").select(id_col, "fp", "component_id")


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of a hash for each ``k`` (the finalizer of splitmix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles; a shorter text is one."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - shingle + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(h))):
        rolled = rolled * np.uint64(0x100000001B3) + h[k : k + n]
    return np.unique(_mix(rolled, len(h) if len(h) < shingle else shingle))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Values in both of two sorted arrays of distinct values."""
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())


def word_fingerprints(words: np.ndarray, number: int) -> list[int]:
    """Independent fingerprints of distinct words, given as their hashes.

    An edited word changes one feature, not as many as a shingle has words.
    """
    if not len(words):
        return [0] * number
    out = []
    for k in range(number):
        bits = np.zeros(BITS, np.int64)
        for at in range(0, len(words), 1 << 16):
            bits += np.unpackbits(_mix(words[at : at + (1 << 16)], k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(bits * 2 > len(words)).tobytes(), "big"))
    return out


#: Longs of a sketch's bitmap.
LONGS = 8


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of 64 * LONGS places."""
    places = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % (64 * LONGS), minlength=64 * LONGS)
    return np.packbits((places & 1).astype(np.uint8)).view(np.int64)


def sketches(texts: DataFrame, shingle: int, number: int) -> DataFrame:
    """Per row of (id, text): fingerprints f0.., n distinct shingles, bitmap m0.."""
    names = [*(f"f{k}" for k in range(number)), "n", *(f"m{k}" for k in range(LONGS))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = np.zeros((len(batch), len(names)), np.int64)
            for i, text in enumerate(batch["text"]):
                own = shingle_set(text, shingle)
                rows[i, :number] = [_signed(x) for x in word_fingerprints(np.unique(word_hashes(text)), number)]
                rows[i, number] = len(own)
                rows[i, number + 1 :] = bitmap(own)
            yield pd.DataFrame({"id": batch["id"], **{c: rows[:, k] for k, c in enumerate(names)}})

    return texts.select("id", "text").mapInPandas(run, "id long, " + ", ".join(f"{c} long" for c in names))


def possible(pairs: DataFrame, sketch: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that may reach the similarity, by an exact bound.

    Two sets of n and m differ in at most (1 - s) / (1 + s) * (n + m) elements
    at similarity s, and each place where their parities differ takes one.
    """
    cols = ["n", *(f"m{k}" for k in range(LONGS))]
    left = sketch.select(F.col("id").alias("a"), *[F.col(c).alias(f"x{c}") for c in cols])
    right = sketch.select(F.col("id").alias("b"), *[F.col(c).alias(f"y{c}") for c in cols])
    differ = sum((F.bit_count(F.col(f"xm{k}").bitwiseXOR(F.col(f"ym{k}"))) for k in range(LONGS)), F.lit(0))
    most = (1 - similarity) / (1 + similarity) * (F.col("xn") + F.col("yn")) + 1e-6
    return pairs.join(left, "a").join(right, "b").filter((differ <= most) & (F.abs(F.col("xn") - F.col("yn")) <= most)).select("a", "b")


def similar(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``docs`` (id, text) whose shingles' Jaccard similarity is enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            for b, x, y in zip(batch["b"], batch["x"], batch["y"]):
                if b != last[0]:
                    last = (b, shingle_set(y, shingle))
                own, other = shingle_set(x, shingle), last[1]
                both = overlap(own, other)
                keep.append(both >= similarity * (len(own) + len(other) - both))
            yield batch.loc[keep, ["a", "b"]]

    left = docs.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = docs.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def apart(run: np.ndarray, fp: np.ndarray, comp: np.ndarray, distance: int, second: Callable[[int], list[np.uint64]] | None = None, run_limit: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows in one run, within the distance and in different components.

    ``run`` numbers the runs of adjacent rows. A run of more than ``run_limit``
    rows is split by its second keys; ``second`` gives their masks for the
    run's first row. Each pair comes once.
    """
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    lengths = np.diff(np.append(starts, len(run)))
    few = np.flatnonzero(np.repeat((lengths > 1) & (lengths <= SHORT), lengths))
    for lag in range(1, min(SHORT, len(few))):
        i, j = few[lag:], few[:-lag]
        at = (run[i] == run[j]) & (comp[i] != comp[j]) & (popcount(fp[i] ^ fp[j]) <= distance)
        yield i[at], j[at]
    for s, n in zip(starts[lengths > SHORT].tolist(), lengths[lengths > SHORT].tolist()):
        own = comp[s : s + n]
        names, sizes = np.unique(own, return_counts=True)
        if len(names) == 1:
            continue
        if second is not None and n > run_limit:
            masks = second(s)
            for k, mask in enumerate(masks):
                keys = fp[s : s + n] & mask
                order = np.argsort(keys, kind="stable") + s
                for i, j in apart(keys[order - s], fp[order], comp[order], distance):
                    i, j = order[i], order[j]
                    once = first_met(fp[i] ^ fp[j], np.full(len(i), k), masks)
                    yield i[once], j[once]
            continue
        # The largest component's rows needn't meet each other.
        most = names[sizes.argmax()]
        rest = np.flatnonzero(own != most)
        step = max(1, (1 << 20) // n)
        for a in range(0, len(rest), step):
            x = rest[a : a + step, None]
            near = (popcount(fp[s + x] ^ fp[None, s : s + n]) <= distance) & (own[x] != own[None])
            i, j = np.nonzero(near & ((own[None] == most) | (x > np.arange(n)[None])))
            yield s + x[i, 0], s + j


def _whole_runs(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """Rows of longs, sorted by their first two columns; no run of these is cut."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = batch.to_numpy(np.int64)
        if not len(rows):
            continue
        if held and (held[0][0, :2] == rows[0, :2]).all() and (rows[0, :2] == rows[-1, :2]).all():
            held.append(rows)
            continue
        rows = np.concatenate([*held, rows])
        other = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
        last = other[-1] + 1 if len(other) else 0
        if last:
            yield rows[:last]
        held = [rows[last:]]
    if held:
        yield np.concatenate(held)


def pairs_apart(texts: DataFrame, sketch: DataFrame, similarity: float, distance: int, run_limit: int = 4096) -> DataFrame:
    """Pairs (a, b), b < a, that may reach the similarity, of texts in different components.

    ``texts`` has k, the number of a fingerprint, fp, that fingerprint, id, comp
    and n, a row for each fingerprint of an id that takes part. All pairs
    within the distance in one of them are tested by size and by the sketches'
    bound (see ``possible``) where they meet, under the first key they share:
    only those not ruled out become rows. Sketches are sent to keys under which
    a text has a partner, not to all.
    """
    keys = variants(distance)
    masks = [np.uint64(m) for _, m in keys]
    by_key: dict[int, list[np.uint64]] = {}

    def second(key_no: int) -> list[np.uint64]:
        if key_no not in by_key:
            rest = [p for p in range(BITS) if not int(masks[key_no]) >> p & 1]
            by_key[key_no] = [np.uint64(_mask(s) & ~(1 << p)) for s in segments(rest, distance) for p in s]
        return by_key[key_no]

    cols = ["key_no", "key", "id", "comp", "n", "fp"]

    def met(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        run = np.cumsum(np.append(False, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
        fp, n, own = np.ascontiguousarray(rows[:, 5]).view(np.uint64), rows[:, 4], rows[:, 0] % len(keys)
        for i, j in apart(run, fp, rows[:, 3], distance, lambda s: second(int(own[s])), run_limit):
            at = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6
            i, j = i[at], j[at]
            at = first_met(fp[i] ^ fp[j], own[i], masks)
            yield i[at], j[at]

    def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_runs(batches):
            some = np.zeros(len(rows), bool)
            for i, j in met(rows):
                some[i] = some[j] = True
            if some.any():
                yield pd.DataFrame(rows[some], columns=cols)

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_runs(batches):
            for i, j in met(rows):
                differ = popcount(np.ascontiguousarray(rows[i, 6:] ^ rows[j, 6:]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                at = differ <= (1 - similarity) / (1 + similarity) * (rows[i, 4] + rows[j, 4]) + 1e-6
                if at.any():
                    a, b = rows[i[at], 2], rows[j[at], 2]
                    yield pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    count = shuffle_partitions(texts.sparkSession)
    by = ["key_no", "key"]
    key = F.explode(F.array(*[F.struct((F.col("k") * len(keys) + i).cast("long").alias("key_no"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in keys]))
    rows = texts.select(key.alias("v"), "id", "comp", "n", "fp").select("v.key_no", "v.key", "id", "comp", "n", "fp")
    kinds = ", ".join(f"{c} long" for c in cols)
    some = materialize(rows.repartition(count, *by).sortWithinPartitions(*by).mapInPandas(partners, kinds), "near-partners")
    bits = [f"m{k}" for k in range(LONGS)]
    with_bits = some.join(sketch.select("id", *bits), "id").select(*cols, *bits)
    return with_bits.repartition(count, *by).sortWithinPartitions(*by).mapInPandas(tested, "a long, b long").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, distance: int = 5, number: int = 3) -> DataFrame:
    """Rows of ``docs`` with one of each group of near copies, the smallest id.

    Exact copies are grouped by a hash of the text. ``number`` independent
    fingerprints of a text's distinct words, each linked at ``distance`` bits
    through the deletion variants, propose pairs; a pair links if the Jaccard
    similarity of its ``shingle``-word shingles is at least ``similarity``.
    Pairs that an exact bound on sketches rules out don't reach the texts.

    First a fingerprint's texts are compared with its smallest id, and
    fingerprints of a run with each other (in a long run with the first in
    reach). Then come all pairs of texts still in different components whose
    fingerprints link and which that left out: those of fingerprints with more
    than one text or in a long run, and of the fingerprints linked to them. The
    bound rules these out where they meet, before they become rows. So the
    components are those of all linked pairs.

    Null and empty texts are copies of each other. Rows without id have no part
    in the choice and stay. Of rows that repeat an id all stay or go; where
    their texts differ one of them speaks for the id. Other columns stay as
    they are, whatever their names. An empty table gives an empty result.
    """
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    body = F.coalesce("text", F.lit(""))
    hashed = texts.select(F.xxhash64(body, F.octet_length(body)).alias("copy"), "id")
    firsts = materialize(hashed.groupBy("copy").agg(F.min("id").alias("first")), "copies")
    own = materialize(sketches(texts, shingle, number).join(firsts.select(F.col("first").alias("id")), "id", "left_semi").dropDuplicates(["id"]), "near-sketches")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = materialize(pairs, "near-pairs")
        ids = left.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        some = materialize(texts.join(ids, "id", "left_semi").dropDuplicates(["id"]), "near-texts")
        return materialize(similar(left, some, shingle, similarity), "near-links")

    proposals, wide = [], []
    for k in range(number):
        reps = materialize(own.groupBy(F.col(f"f{k}").alias("fp")).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("texts")), "representatives")
        met = materialize(edges(reps.select("fp", "rep"), distance, direct=True), "near-edges")
        many = reps.filter("texts > 1").select("rep").union(met.filter("long").select(F.col("a").alias("rep"))).distinct()
        met = met.filter("a != b").select("a", "b")
        both = met.union(met.select("b", "a"))
        around = both.join(many.withColumnRenamed("rep", "a"), "a", "left_semi").select(F.col("b").alias("rep"))
        wide.append(materialize(reps.join(many.union(around).distinct(), "rep", "left_semi").select("fp"), "near-wide"))
        same = own.select("id", F.col(f"f{k}").alias("fp")).join(reps.select("fp", "rep"), "fp").filter("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        proposals.append(same.union(met))
    found = components(confirmed(possible(reduce(DataFrame.union, proposals).distinct(), own, similarity)))
    fps = [own.select(F.lit(k).alias("k"), F.col(f"f{k}").alias("fp"), "id", "n").join(wide[k], "fp", "left_semi") for k in range(number)]
    here = reduce(DataFrame.unionByName, fps).join(found, F.col("id") == found["name"], "left").withColumn("comp", F.coalesce("component", "id"))
    rest = confirmed(pairs_apart(here, own, similarity, distance))
    # A component stands for its links.
    found = components(found.select(F.col("name").alias("a"), F.col("component").alias("b")).union(rest))
    gone = fresh(docs, "_gone")
    near = found.filter("name != component").select(F.col("name").alias(gone))
    copies = hashed.join(firsts, "copy").filter("id != first").select(F.col("id").alias(gone))
    return docs.join(near.union(copies).distinct(), F.col(id_col) == F.col(gone), "left_anti")
