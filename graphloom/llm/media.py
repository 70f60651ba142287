"""Media columns: content-addressed payloads in tar shards.

Each task appends its payloads, as PNG images named by the SHA-256 of their
payload, to tar shards in the shared folder; a payload occurs once in a shard.
Rows carry only digest, shard, offset and length. Metadata columns come from
range reads of the header bytes alone; payload features from a range read of
the stored bytes.

A payload is the text's UTF-8 bytes followed by zero bytes up to a positive
multiple of 64; it is stored losslessly as 8-bit grey samples, 64 to a line.
Null text counts as empty (64 zero bytes). Null ids, repeated rows and ties
keep their rows. Other columns are ignored, so their names can't clash. An
empty table gives an empty result. Texts have no length limit but PNG's of
2**31 lines.

A shard's name is new for each attempt of a task, and the references are
written to the shared folder before anything reads them, so a repeated task
leaves an unused shard behind but never a wrong reference.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, shuffle_partitions

LINE = 64
HEADER_BYTES = 33  # signature and IHDR
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % LINE or (0 if raw else LINE)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_encode(payload: bytes, level: int = 4) -> bytes:
    """8-bit grey PNG, 64 samples to a line, no line filter."""
    lines = np.zeros((len(payload) // LINE, LINE + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> dict:
    """Width, height, bit depth and colour type from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour_type": colour}


def png_decode(stored: bytes) -> bytes:
    meta, at, data = png_header(stored[:HEADER_BYTES]), 8, []
    while at < len(stored):
        (n,) = struct.unpack(">I", stored[at : at + 4])
        if stored[at + 4 : at + 8] == b"IDAT":
            data.append(stored[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(meta["height"], meta["width"] + 1)
    return lines[:, 1:].tobytes()


def _filesystem(uri: str):
    """pyarrow's file system for any URI Spark writes to, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


class _Shard:
    """One tar file being written; offsets are known as members are added."""

    def __init__(self, root: str) -> None:
        self.name = f"shard-{uuid.uuid4().hex}.tar"
        fs, path = _filesystem(root)
        fs.create_dir(path, recursive=True)
        self.out, self.size, self.seen = fs.open_output_stream(f"{path}/{self.name}", compression=None), 0, {}

    def add(self, digest: str, make) -> tuple[int, int]:
        if digest not in self.seen:
            stored = make()
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(stored)
            head = info.tobuf(tarfile.PAX_FORMAT)
            self.out.write(head)
            self.out.write(stored)
            self.out.write(bytes(-len(stored) % 512))
            self.seen[digest] = (self.size + len(head), len(stored))
            self.size += len(head) + len(stored) + -len(stored) % 512
        return self.seen[digest]

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def store(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 256 << 20, level: int = 4) -> DataFrame:
    """Write payloads to tar shards under ``root``; return their references.

    Columns: the id, digest, shard, offset, length, n_bytes. The references
    are a written table, so shards are made once.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                payload, n = payload_of(text)
                if shard is None or shard.size >= shard_bytes:
                    if shard is not None:
                        shard.close()
                    shard = _Shard(root)
                digest = hashlib.sha256(payload).hexdigest()
                offset, length = shard.add(digest, lambda: png_encode(payload, level))  # noqa: B023
                rows.append((key, digest, shard.name, offset, length, n))
            yield pd.DataFrame(rows, columns=["id", "digest", "shard", "offset", "length", "n_bytes"]).astype({"id": object})
        if shard is not None:
            shard.close()

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    refs = picked.mapInPandas(write, f"id {kind}, digest string, shard string, offset long, length long, n_bytes long")
    return materialize(refs, "media-refs").withColumnRenamed("id", id_col)


def _ranges(root: str):
    """A function that reads bytes of a shard; the last shard stays open."""
    fs, path = _filesystem(root)
    now: list = [None, None]

    def get(shard: str, offset: int, length: int) -> bytes:
        if now[0] != shard:
            if now[1] is not None:
                now[1].close()
            now[:] = shard, fs.open_input_file(f"{path}/{shard}")
        now[1].seek(offset)
        return now[1].read(length)

    return get


def read_metadata(refs: DataFrame, root: str) -> DataFrame:
    """Add width, height, bit_depth, colour_type from 33-byte range reads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = _ranges(root)
        for batch in batches:
            metas = [png_header(get(s, o, HEADER_BYTES)) for s, o in zip(batch["shard"], batch["offset"])]
            yield pd.concat([batch, pd.DataFrame(metas, columns=["width", "height", "bit_depth", "colour_type"], index=batch.index)], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in refs.schema)
    return refs.mapInPandas(run, schema + ", width long, height long, bit_depth int, colour_type int")


def read_features(refs: DataFrame, root: str) -> DataFrame:
    """Add digests and a feature string computed from the bytes read back."""

    def features(payload: bytes) -> str:
        counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        p = counts[counts > 0] / len(payload)
        mean = float(counts @ np.arange(256)) / len(payload)
        return f"lines={len(payload) // LINE};mean={mean:.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};distinct={len(p)}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = _ranges(root)
        for batch in batches:
            rows = []
            for s, o, n in zip(batch["shard"], batch["offset"], batch["length"]):
                stored = get(s, o, n)
                payload = png_decode(stored)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-LINE:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload)))
            yield pd.concat([batch, pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], index=batch.index)], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in refs.schema)
    return refs.mapInPandas(run, schema + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", root: str | None = None) -> DataFrame:
    """Store every text as media and return references, metadata and features."""
    root = root or scratch(docs.sparkSession, "media")
    refs = store(docs, root, id_col, text_col)
    # Rows of a shard are read together and in order of offset.
    placed = refs.repartition(shuffle_partitions(docs.sparkSession), "shard").sortWithinPartitions("shard", "offset")
    return read_features(read_metadata(placed, root), root)


def tar_members(data: bytes) -> dict[str, bytes]:
    """All members of a shard, for tests and for readers without an index."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar.getmembers()}
