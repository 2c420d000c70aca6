"""Documents in chunks, and exchanges between chunks and buckets of hashes.

Rows are few and large: what a chunk tells a bucket is one compressed blob,
so hashes cost a few bytes each on their way.  A chunk has about ``CHUNK``
bytes and a bucket about ``BUCKET`` hashes, which keeps the row of a chunk and
a bucket at hundreds of hashes or more up to some ten TB of text.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK = 1 << 22
#: Hashes that a bucket should hold; one bucket is in memory at a time.
BUCKET = 1 << 20
#: Stands for a null id, which is larger than all others.
LAST = 2**63 - 1
CHUNKS = "chunk long, blob binary"
ROW = "chunk long, kind int, bucket int, blob binary"
_NAMES = ["chunk", "kind", "bucket", "blob"]


def pack(*arrays: np.ndarray) -> bytes:
    """64-bit arrays of one length, their bytes by significance, compressed."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(3).compress(struct.pack("<I", len(arrays)) + b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (k,) = struct.unpack_from("<I", raw)
    planes = np.frombuffer(raw, np.uint8, offset=4).reshape(k, 8, -1) if len(raw) > 4 else np.zeros((k, 8, 0), np.uint8)
    return [np.ascontiguousarray(p.T).view(np.int64).ravel() for p in planes]


class Chunk:
    """Documents one after the other."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray):
        self.ids, self.sizes, self.data = ids, sizes, data
        self.starts = np.cumsum(sizes) - sizes

    def packed(self) -> bytes:
        head = pack(self.ids, self.sizes)
        return struct.pack("<I", len(head)) + head + zstandard.ZstdCompressor(6).compress(self.data.tobytes())

    @staticmethod
    def unpacked(blob: bytes) -> Chunk:
        (n,) = struct.unpack_from("<I", blob)
        ids, sizes = unpack(blob[4 : 4 + n])
        raw = zstandard.ZstdDecompressor().decompress(blob[4 + n :], max_output_size=max(int(sizes.sum()), 1))
        return Chunk(ids, sizes, np.frombuffer(raw, np.uint8))


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, ids, texts, size = 0, [], [], 0

    def row():
        data = np.frombuffer(b"".join(texts), np.uint8)
        c = Chunk(np.array(ids, np.int64), np.array(list(map(len, texts)), np.int64), data)
        name = TaskContext.get().partitionId() << 20 | n
        return pa.RecordBatch.from_pydict({"chunk": [name], "blob": [c.packed()]})

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            texts.append(t.as_buffer().to_pybytes())
            ids.append(LAST if i is None else i)
            size += len(texts[-1])
            if size >= CHUNK or len(ids) >= 1 << 16:
                yield row()
                n, ids, texts, size = n + 1, [], [], 0
    if ids:
        yield row()


def text_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", F.lit(0).alias("kind"), F.lit(-1).alias("bucket"), "blob")


def by(key: str, df: DataFrame) -> DataFrame:
    """Rows of one ``key`` after each other, by kind and bucket."""
    return df.repartition(key).sortWithinPartitions(key, "kind", "bucket")


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    chunk, kind, bucket, blob = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], _NAMES)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[tuple]]:
    """Rows that follow each other with one ``key``; a blob is a view, not a copy."""
    held, last = [], None
    for b in batches:
        blobs = (x.as_buffer() for x in b.column("blob"))
        rows = zip(*(b.column(c).to_pylist() for c in _NAMES[:-1]), blobs)
        for k, r in zip(b.column(key).to_pylist(), rows):
            if k != last and held:
                yield held
                held = []
            held.append(r)
            last = k
    if held:
        yield held


def split(values: np.ndarray, low: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted ``values`` by the bits above ``low``."""
    top = values >> low
    cuts = np.flatnonzero(np.diff(top, prepend=-1, append=-1)).tolist()
    return [(int(top[a]), a, b) for a, b in zip(cuts, cuts[1:])]


def widths(hashes: int, bucket: int) -> tuple[int, int]:
    """(bits of a hash, bits of it within a bucket) for so many hashes; false hits of the hash only cost time."""
    top = max((hashes // bucket).bit_length(), 2)
    bits = min(max(hashes.bit_length() + 14, top + 8), 62)
    return bits, bits - top


def told(h: np.ndarray, count: np.ndarray, many: np.ndarray, name: int, low: int) -> list[tuple]:
    """For each bucket a row with a chunk's sorted hashes, how often each is there and whether that alone makes it shared."""
    mask = (1 << low) - 1
    return [(name, 1, k, pack(np.diff(h[a:z] & mask, prepend=0), count[a:z], many[a:z].astype(np.int64))) for k, a, z in split(h, low)]


def answer(hot: int = LAST):
    """Bucket -> for each chunk those of its hashes that another has too, or that the chunk calls shared.

    With each comes whether all chunks together have it over ``hot`` times.
    """

    def each(batches):
        for rows in groups(batches, "bucket"):
            parts = [unpack(r[3]) for r in rows]
            h = np.concatenate([np.cumsum(p[0]) for p in parts])
            count = np.concatenate([p[1] for p in parts])
            many = np.concatenate([p[2] for p in parts]) > 0
            owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])
            del parts
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.diff(h[order], prepend=-1))
            size = np.diff(first, append=len(h))
            shared, often = np.empty(len(h), bool), np.empty(len(h), bool)
            shared[order] = np.repeat((size > 1) | np.logical_or.reduceat(many[order], first), size)
            often[order] = np.repeat(np.add.reduceat(count[order], first) > hot, size)
            h, often, owner = h[shared], often[shared], owner[shared]
            cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
            out = [(r[0], 1, r[2], pack(np.diff(h[a:z], prepend=0), often[a:z].astype(np.int64))) for r, a, z in zip(rows, cuts, cuts[1:]) if a < z]
            if out:
                yield rows_batch(out)

    return each


def answered(rows: list[tuple], low: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shared hashes that the buckets' ``rows`` hold, and which of them are hot."""
    parts = [unpack(r[3]) for r in rows]
    h = np.concatenate([(r[2] << low) + np.cumsum(p[0]) for r, p in zip(rows, parts)])
    order = np.argsort(h)
    return h[order], np.concatenate([p[1] for p in parts])[order] > 0


def found(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each of ``h`` its place in the sorted ``known``, -1 where it isn't there."""
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)
