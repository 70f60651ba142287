"""Removal of repeated byte strings by deep-shallow suffix sorting.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts in a
document with a smaller id. Suffixes are sorted deep-shallow: multikey
quicksort, on eight bytes at a time, to a shallow depth, and blind tries for
the groups that are still equal there. A blind trie keeps only branch positions
and branch bytes; each string is compared once with its group's leader.

Not all suffixes are sorted, only those that can matter. Each window has an
anchor, the first of its ``GRAM``-byte strings with the smallest hash; equal
windows have equal anchors at the same place. Anchors are one in 17 positions,
and only those whose hash occurs twice are followed up:

1. Blocks of texts find their anchors. A hash that occurs twice in a block is
   settled there, and one row stands for it in the shuffle, so a passage in a
   third of all texts costs one row a block. Others meet by hash.
2. Texts meet their surviving anchors again and cut out each anchor's context,
   the bytes of its windows. Contexts that are equal within a block are settled
   there; one of them goes on.
3. Contexts meet by anchor hash; their windows are sorted, and those equal to
   one of a smaller id give removed ranges.
4. Ranges meet their texts.

Hashes only choose candidates; what is removed is compared byte for byte.

Null text counts as empty. A null id counts as larger than all others. Rows
with one id never take bytes from each other. Repeated rows keep their rows.
Other columns are ignored. An empty table gives an empty result; texts shorter
than a window keep all bytes. Texts have no length limit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

WINDOW, GRAM, SHALLOW = 50, 16, 16
CHUNK, POSITION = 1 << 19, (1 << 23) - 1
NONE = 0xFFFFFFFF
LAST = np.iinfo(np.int64).max
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def anchors_of(buf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash) of each anchor of joined texts.

    An anchor's windows are neighbours. Places are those in ``buf``, whose size
    is at most POSITION.
    """
    n = len(buf)
    ends = np.cumsum(lengths)
    valid = np.zeros(n + 1, np.int8)
    long_ = lengths >= WINDOW
    np.add.at(valid, (ends - lengths)[long_], 1)
    np.add.at(valid, (ends - WINDOW + 1)[long_], -1)
    windows = np.flatnonzero(np.cumsum(valid[:n]))
    if not len(windows):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    h = _TABLE[buf]
    span = 1
    while span < GRAM:
        h[: n - span] = h[: n - span] * np.uint64(0xBF58476D1CE4E5B9) + h[span:]
        h ^= h >> np.uint64(29)
        span *= 2
    key = h & ~np.uint64(POSITION)
    key |= np.arange(n, dtype=np.uint64)
    width, span = WINDOW - GRAM + 1, 1
    while span * 2 <= width:
        np.minimum(key[: n - span], key[span:], out=key[: n - span])
        span *= 2
    if span < width:
        more = width - span
        key[: n - more] = np.minimum(key[: n - more], key[more:])
    anchor = (key[windows] & np.uint64(POSITION)).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    return windows[first], np.diff(np.append(first, len(windows))), h[anchor[first]]


def text_anchors(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window in it, number of windows, hash), in order."""
    out: list[tuple] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            lengths = np.array([len(b) for _, _, b in held])
            first, n, h = anchors_of(np.frombuffer(b"".join(b for _, _, b in held), np.uint8), lengths)
            starts = np.cumsum(lengths) - lengths
            which = np.searchsorted(starts, first, side="right") - 1
            out.append((np.array([i for i, _, _ in held])[which], first - starts[which] + np.array([o for _, o, _ in held])[which], n, h))
        held, size = [], 0

    for i, b in enumerate(raw):
        if len(b) < WINDOW:
            continue
        step = POSITION - 2 * CHUNK
        for at in range(0, len(b) - WINDOW + 1, step):  # pieces share WINDOW - 1 bytes
            piece = b[at : at + step + WINDOW - 1]
            if size and size + len(piece) > POSITION:
                flush()
            held.append((i, at, piece))
            size += len(piece)
            if size >= CHUNK:
                flush()
    flush()
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out))


def earlier_copies(buf: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each window equals one of a smaller order; deep-shallow sorting.

    ``buf`` ends with at least eight spare bytes.
    """
    out = np.zeros(len(starts), bool)
    words = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    act, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)

    def split(key: np.ndarray):
        """Order by group and key; groups of one are done."""
        nonlocal act, group
        o = np.lexsort((key, group))
        act, key, group = act[o], key[o], group[o]
        fresh = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
        group = np.cumsum(fresh) - 1
        keep = np.bincount(group)[group] > 1
        act, group = act[keep], group[keep]

    # Multikey quicksort: only the part equal to the pivot goes deeper.
    for at in range(0, SHALLOW, 8):
        if len(act):
            split(words[starts[act] + at].byteswap())
    # Blind tries: leaders, branch position, branch byte.
    while len(act):
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(first, len(act)))
        leader = np.repeat(act[first], sizes)
        depth = np.full(len(act), WINDOW)
        rest = np.arange(len(act))
        for at in (*range(SHALLOW, WINDOW - 8, 8), WINDOW - 8):
            x = words[starts[act[rest]] + at] ^ words[starts[leader[rest]] + at]
            differs = x != 0
            low = x[differs]
            # Bytes before the first that differs, in a little-endian word.
            skip = np.zeros(len(low), np.int64)
            for k in range(1, 8):
                skip += (low & np.uint64((1 << 8 * k) - 1)) == 0
            depth[rest[differs]] = at + skip
            rest = rest[~differs]
        leaf = depth == WINDOW
        least = np.repeat(np.minimum.reduceat(np.where(leaf, order[act], LAST), first), sizes)
        out[act[leaf]] = order[act[leaf]] > least[leaf]
        act, group, depth = act[~leaf], group[~leaf], depth[~leaf]
        if len(act):
            split(depth * 256 + buf[starts[act] + depth])
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bytes(blob), max_output_size=1 << 31)


def _planes(values: np.ndarray) -> np.ndarray:
    """Bytes of like place together, for the compressor."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)


def _unplanes(raw: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(-1, n).T.copy().view(kind).reshape(-1)


def _by_key(keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """(key, values...) for each distinct key, values in order."""
    o = np.argsort(keys, kind="stable")
    keys, values = keys[o], [v[o] for v in values]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    for a, b in zip(first, np.append(first[1:], len(keys))):
        yield (int(keys[a]), *(v[a:b] for v in values))


_ROW = "bucket int, kind int, key long, blob binary"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "kind", "key", "blob"])


def _raw(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _find(buckets: int):
    """Step 1, before the shuffle: hashes by bucket; kind 1 is settled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            which, _, _, h = text_anchors(_raw(batch["text"]))
            if not len(which):
                continue
            doc = (batch["rk"].to_numpy() & NONE).astype(np.uint32)
            first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
            number = (np.arange(len(which)) - np.repeat(first, np.diff(np.append(first, len(which))))).astype(np.uint32)
            o = np.argsort(h, kind="stable")
            h, own, number = h[o], doc[which[o]], number[o]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            n = np.diff(np.append(first, len(h)))
            many = np.repeat(n > 1, n)
            rows = [(key % buckets, 1, key, v.tobytes()) for key, v in _by_key(own[many].astype(np.int64), number[many])]
            number = np.where(many, np.uint32(NONE), number)
            h, own, number = h[first], own[first], number[first]
            b = (h >> np.uint64(32)) % np.uint64(buckets)
            for bucket, hs, ds, ns in _by_key(b.astype(np.int64), h, own, number):
                gaps = np.diff(hs, prepend=np.uint64(0))
                rows.append((bucket, 0, len(hs), _pack(_planes(gaps), _planes(ds), _planes(ns))))
            yield _frame(rows)

    return run


def _deal(keys: np.ndarray, numbers: np.ndarray, parts: int) -> pd.DataFrame:
    """Anchor numbers by text key, one row for each part of the keys."""
    return pd.DataFrame([(k, _pack(_planes(a), _planes(b)), len(a)) for k, a, b in _by_key((keys % parts).astype(np.int64), keys, numbers)], columns=["part", "blob", "n"])


def _gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each text key: its anchor numbers."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> pd.DataFrame:
        keys, numbers = (np.concatenate(x) for x in zip(*held))
        return pd.DataFrame([(k, v.tobytes()) for k, v in _by_key(keys.astype(np.int64), numbers)], columns=["key", "blob"])

    open_ = None
    for batch in batches:
        for part, blob, n in zip(batch["part"], batch["blob"], batch["n"]):
            if part != open_ and held:
                yield settle()
                held = []
            open_ = part
            raw = _unpack(blob)
            held.append((_unplanes(raw[: 4 * n], n, np.uint32), _unplanes(raw[4 * n :], n, np.uint32)))
    if held:
        yield settle()


def _meet(parts: int):
    """Step 1, after it: anchors whose hash was met, dealt by text key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, numbers, size = [], [], 0
        for found in _met(batches):
            for key, blob in zip(found["key"], found["blob"]):
                own = np.frombuffer(blob, np.uint32)
                keys.append(np.full(len(own), key, np.uint32))
                numbers.append(own)
                size += len(own)
            if size > 4_000_000:
                yield _deal(np.concatenate(keys), np.concatenate(numbers), parts)
                keys, numbers, size = [], [], 0
        if size:
            yield _deal(np.concatenate(keys), np.concatenate(numbers), parts)

    return run


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(text key, anchor numbers) of hashes that met."""

    def settle(blobs: list[tuple[int, bytes]]) -> pd.DataFrame:
        parts = []
        for n, blob in blobs:
            raw = _unpack(blob)
            parts.append((np.cumsum(_unplanes(raw[: 8 * n], n, np.uint64), dtype=np.uint64), _unplanes(raw[8 * n : 12 * n], n, np.uint32), _unplanes(raw[12 * n :], n, np.uint32)))
        h, own, number = (np.concatenate(x) for x in zip(*parts))
        o = np.argsort(h, kind="stable")
        h, own, number = h[o], own[o], number[o]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        n = np.diff(np.append(first, len(h)))
        keep = np.repeat(n > 1, n) & (number != NONE)
        return pd.DataFrame([(k, v.tobytes()) for k, v in _by_key(own[keep].astype(np.int64), number[keep])], columns=["key", "blob"])

    held: list[tuple[int, bytes]] = []
    open_ = None
    for batch in batches:
        done = batch[batch["kind"] == 1]
        if len(done):
            yield done[["key", "blob"]]
        own = batch[batch["kind"] == 0]
        for bucket, n, blob in zip(own["bucket"], own["key"], own["blob"]):
            if bucket != open_ and held:
                yield settle(held)
                held = []
            open_ = bucket
            held.append((n, blob))
    if held:
        yield settle(held)


def _cut_out(buckets: int):
    """Step 2: contexts by bucket; kind 1 holds ranges already settled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = _raw(batch["text"])
            rk, order = batch["rk"].to_numpy(), batch["ord"].to_numpy()
            which, lo, n, h = text_anchors(raw)
            if not len(which):
                continue
            wanted = np.zeros(len(which), bool)
            starts = np.searchsorted(which, np.arange(len(raw) + 1))
            for i, blob in enumerate(batch["blob"]):
                numbers = np.frombuffer(blob, np.uint32).astype(np.int64)
                numbers = numbers[numbers < starts[i + 1] - starts[i]]
                wanted[starts[i] + numbers] = True
            which, lo, n, h = which[wanted], lo[wanted], n[wanted], h[wanted]
            seen: dict[bytes, list[int]] = {}
            settled: list[int] = []
            whose = order[which]
            for k, (i, a, m) in enumerate(zip(which.tolist(), lo.tolist(), n.tolist())):
                text = raw[i][a : a + m + WINDOW - 1]
                have = seen.get(text)
                if have is None:
                    seen[text] = [k]
                elif whose[have[0]] < whose[k]:
                    settled.append(k)
                elif whose[have[0]] > whose[k]:
                    settled += have
                    seen[text] = [k]
                else:
                    have.append(k)
            done = np.array(settled, np.int64)
            rows = [(key % buckets, 1, key, np.stack([a, m], axis=1).astype(np.uint32).tobytes()) for key, a, m in _by_key(rk[which[done]], lo[done], n[done])]
            left = np.array([k for ks in seen.values() for k in ks], np.int64)
            b = ((h[left] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            for bucket, ks in _by_key(b, left):
                ks = ks[np.argsort(h[ks], kind="stable")]
                text = b"".join(raw[i][a : a + m + WINDOW - 1] for i, a, m in zip(which[ks].tolist(), lo[ks].tolist(), n[ks].tolist()))
                blob = _pack(_planes(h[ks]), _planes(order[which[ks]]), _planes(rk[which[ks]]), _planes(lo[ks].astype(np.uint32)), _planes(n[ks].astype(np.uint32)), np.frombuffer(text, np.uint8))
                rows.append((bucket, 0, len(ks), blob))
            yield _frame(rows)

    return run


def _sort(limit: int):
    """Step 3: ranges of windows that an earlier text has, by text key."""

    def settle(blobs: list[tuple[int, bytes]]) -> pd.DataFrame | None:
        parts = []
        for k, blob in blobs:
            raw = _unpack(blob)
            cols, at = [], 0
            for kind, size in ((np.uint64, 8), (np.int64, 8), (np.int64, 8), (np.uint32, 4), (np.uint32, 4)):
                cols.append(_unplanes(raw[at : at + size * k], k, kind))
                at += size * k
            parts.append((*cols, np.frombuffer(raw, np.uint8, offset=at)))
        h, order, rk, lo, n = (np.concatenate([p[i] for p in parts]) for i in range(5))
        n = n.astype(np.int64)
        buf = np.concatenate([*(p[5] for p in parts), np.zeros(64, np.uint8)])
        size = n + WINDOW - 1
        place = np.cumsum(size) - size
        o = np.argsort(h, kind="stable")
        hs = h[o]
        first = np.flatnonzero(np.append(True, hs[1:] != hs[:-1]))
        many = np.diff(np.append(first, len(hs))) > 1
        o = o[np.repeat(many, np.diff(np.append(first, len(hs))))]
        out = []
        total = np.cumsum(n[o])
        hs = h[o]
        ends = np.flatnonzero(np.append(hs[1:] != hs[:-1], True)) + 1 if len(o) else np.zeros(0, np.int64)
        at = 0
        while at < len(o):
            base = total[at - 1] if at else 0
            # Whole groups of one hash, up to the limit of windows or one group.
            fits = ends[(ends > at) & (total[ends - 1] - base <= limit)]
            to = int(fits[-1]) if len(fits) else int(ends[ends > at][0])
            own = o[at:to]
            at = to
            k = np.repeat(np.arange(len(own)), n[own])
            j = np.arange(len(k)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
            gone = earlier_copies(buf, place[own][k] + j, order[own][k])
            edge = np.append(True, (k[1:] != k[:-1]) | (gone[1:] != gone[:-1]))
            start = np.flatnonzero(edge)
            count = np.diff(np.append(start, len(k)))
            some = gone[start]
            e = own[k[start[some]]]
            out.append((rk[e], lo[e] + j[start[some]], count[some]))
        if not out:
            return None
        keys, a, m = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame([(key, np.stack([x, y], axis=1).astype(np.uint32).tobytes()) for key, x, y in _by_key(keys, a, m)], columns=["key", "blob"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, bytes]] = []
        open_ = None
        for batch in batches:
            done = batch[batch["kind"] == 1]
            if len(done):
                yield done[["key", "blob"]]
            own = batch[batch["kind"] == 0]
            for bucket, k, blob in zip(own["bucket"], own["key"], own["blob"]):
                if bucket != open_ and held:
                    found = settle(held)
                    if found is not None:
                        yield found
                    held = []
                open_ = bucket
                held.append((k, blob))
        if held:
            found = settle(held)
            if found is not None:
                yield found

    return run


def kept_runs(n: int, blobs: list[bytes]) -> tuple[list[tuple[int, int]], int]:
    """(start, end) of the bytes kept, and the number of removed runs."""
    if not len(blobs):
        return ([(0, n)] if n else []), 0
    pairs = np.frombuffer(b"".join(blobs), np.uint32).reshape(-1, 2).astype(np.int64)
    start, end = pairs[:, 0], pairs[:, 0] + pairs[:, 1] + WINDOW - 1
    o = np.argsort(start, kind="stable")
    start, reach = start[o], np.maximum.accumulate(end[o])
    fresh = np.append(True, start[1:] > reach[:-1])
    a = start[fresh]
    b = reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(reach) - 1)]
    edges = np.concatenate([[0], np.stack([a, b], axis=1).ravel(), [n]]).reshape(-1, 2)
    return [(int(x), int(y)) for x, y in edges if y > x], len(a)


def removed_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", windows: int = 400_000) -> tuple[DataFrame, DataFrame]:
    """Texts with their row key, and by that key the removed ranges."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    buckets = 4 * n
    own = F.col(id_col).cast("long")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(own, F.lit(int(LAST))).alias("ord"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rk"))
    long_ = texts.filter(F.octet_length("text") >= WINDOW)
    met = long_.select("text", "rk").mapInPandas(_find(buckets), _ROW).repartition(n, "bucket").sortWithinPartitions("bucket", "kind").mapInPandas(_meet(buckets), "part int, blob binary, n long")
    gathered = met.repartition(n, "part").sortWithinPartitions("part").mapInPandas(_gather, "key long, blob binary")
    survivors = materialize(gathered, "suffix-anchors")
    again = long_.withColumn("key", F.col("rk").bitwiseAND(F.lit(NONE))).join(survivors, "key").select("text", "rk", "ord", "blob")
    sorted_ = again.mapInPandas(_cut_out(buckets), _ROW).repartition(n, "bucket").sortWithinPartitions("bucket", "kind").mapInPandas(_sort(windows), "key long, blob binary")
    return texts, materialize(sorted_.groupBy(F.col("key").alias("rk")).agg(F.collect_list("blob").alias("blobs")), "suffix-ranges")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """Per row: the id, n_bytes, n_removed, n_spans, kept_sha256 (and kept bytes)."""
    texts, ranges = removed_ranges(docs, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, blobs in zip(batch["id"], batch["text"], batch["blobs"]):
                raw = (text or "").encode("utf-8", "surrogatepass")
                runs, spans = kept_runs(len(raw), list(blobs) if blobs is not None else [])
                kept = b"".join(raw[a:b] for a, b in runs)
                rows.append((key, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_kept else [])))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept]).astype({"id": object})

    kind = docs.schema[id_col].dataType.simpleString()
    out = texts.join(ranges, "rk", "left").select("id", "text", "blobs").mapInPandas(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
    return out.withColumnRenamed("id", id_col)
