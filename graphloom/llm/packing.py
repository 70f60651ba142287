"""Best-fit packing by the sum-of-squares rule.

Documents become token ids; only those longer than a sequence are cut, into
whole sequences, the first piece taking the rest. Each piece then goes where
the sum over residual gaps of the squared number of open sequences with that
gap becomes smallest (Csirik et al., "On the sum-of-squares algorithm for bin
packing"). Pieces are dealt by a hash of document and piece into groups of a
few thousand that are packed apart, so no task grows with the input; a group
leaves a handful of sequences open.

Null text counts as empty (only the end id). Null ids and repeated rows keep
their pieces. Only id and text are read, so other columns can't clash. An
empty table gives an empty result. Ties go to the smallest gap left.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: A run of white space that tiktoken isn't given.
LONG_RUN = 20_000


@lru_cache(maxsize=4)
def load_encoder(path: str):
    """Encode function for a byte-level BPE file of the ``tokenizers`` library.

    The vocabulary file's ids are merge ranks, so tiktoken gives the same ids
    several times faster; tests hold both libraries against each other. Its
    pattern backtracks over white space and ends on a run of a million, so
    texts with a long run, and any other on which it ends, go to ``tokenizers``.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.load(open(path, encoding="utf-8"))
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in visible}
    hidden = [b for b in range(256) if b not in set(visible)]
    to_byte |= {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    enc = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    plain: list[Tokenizer] = []

    def slow(text: str) -> list[int]:
        if not plain:
            plain.append(Tokenizer.from_file(path))
        return plain[0].encode(text, add_special_tokens=False).ids

    def encode(text: str) -> list[int]:
        if len(text) > LONG_RUN and re.search(rf"\s{{{LONG_RUN}}}", text):
            return slow(text)
        try:
            if any(s in text for s in special):
                return enc.encode(text, allowed_special="all")
            return enc.encode_ordinary(text)
        except BaseException as e:
            # What the library raises when its pattern gives up isn't an Exception.
            if type(e).__name__ != "PanicException":
                raise
            return slow(text)

    return encode


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be short."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_encoder(tokenizer)
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    rows.append((key, piece, start, length, zlib.crc32(own.tobytes()), *([own.astype(np.int64)] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]).astype({"id": object})

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids).withColumnRenamed("id", id_col)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for each length, in the given order.

    Moving an open sequence from gap g to g - s changes the sum of squares by
    2 * (N[g - s] - N[g]) + 2 (closing one, at gap 0, costs nothing there);
    opening a new one changes it by 2 * N[capacity - s] + 1.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    big = np.iinfo(np.int64).max // 4
    for i, s in enumerate(map(int, lengths)):
        # count[0] stays 0: full sequences are closed.
        change = 2 * (count[: capacity + 1 - s] - count[s:]) + 2
        change[0] -= 1
        change[count[s:] == 0] = big
        rest = int(change.argmin()) if len(change) else 0
        fresh = 2 * int(count[capacity - s]) + (1 if s < capacity else 0)
        if s < capacity and len(change) and change[rest] <= fresh and change[rest] < big:
            gap = rest + s
            bin_ = open_at[gap].pop()
            count[gap] -= 1
            offset[i] = capacity - gap
        else:
            bin_, rest, used = used, capacity - s, used + 1
            offset[i] = 0
        where[i] = bin_
        if rest:
            open_at[rest].append(bin_)
            count[rest] += 1
    return where, offset


def pack(pieces: DataFrame, capacity: int, id_col: str = "doc_id", group_rows: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to a table of pieces.

    ``pieces`` should be a written table; it is counted once to choose the
    number of groups. Whole sequences need no packing. Within a group pieces
    of over half a sequence come first, the longest leading, then the others
    in order of a hash: with both orders mixed fewer gaps stay open than with
    either alone.
    """
    short = pieces.filter(F.col("length") < capacity)
    groups = max(1, round(short.count() / group_rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(parts: list[pd.DataFrame]) -> pd.DataFrame:
            rows = pd.concat(parts)
            where, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
            return rows.assign(sequence_id=(rows["group"].to_numpy().astype(np.int64) << 32) + where, offset=offset).drop(columns=["group"])

        held: list[pd.DataFrame] = []
        for batch in batches:
            for group, own in batch.groupby("group", sort=False):
                if held and held[0]["group"].iat[0] != group:
                    yield flush(held)
                    held = []
                held.append(own)
        if held:
            yield flush(held)

    dealt = short.withColumn("group", F.pmod(F.xxhash64(F.col(id_col), F.col("piece"), F.lit(1)), F.lit(groups)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    long_ = F.col("length") * 2 > capacity
    order = ["group", F.desc(long_), F.desc(F.when(long_, F.col("length"))), F.xxhash64(F.col(id_col), F.col("piece"), F.lit(2)), "length"]
    packed = dealt.repartition(groups, "group").sortWithinPartitions(*order).mapInPandas(run, schema + ", sequence_id long, offset long")
    whole = pieces.filter(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack all documents; one row per piece."""
    pieces = materialize(tokenize(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids), "pieces")
    return pack(pieces, capacity, id_col)
