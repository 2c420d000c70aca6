"""Exact substring dedup by blockwise suffix sorting with a difference cover.

A byte goes when a string of ``LENGTH`` bytes over it also starts in a
document with a smaller id.  So suffixes matter to that depth only, and they
are sorted a bucket at a time:

1. Documents are packed into chunks, which are written once.  A suffix
   belongs to the bucket of the smallest hash among the 16-byte strings in its
   first ``LENGTH`` bytes, so equal suffixes share a bucket, and neighbouring
   suffixes mostly do as well and travel together as one string.
2. Each chunk tells each bucket its hashes; a bucket answers which of them
   other documents have too.  Suffixes of other hashes are unique and stay home.
3. The others go to their buckets, each string once a chunk with its smallest
   id.  A bucket merges equal strings and sorts what is left, one of its
   ``PARTS`` after the other: the first 8 bytes decide, and only ties are
   resolved by ranks that a cover sample of the positions was given before.
   For any two positions some shift below 7 takes both into the difference
   cover {0, 1, 3} modulo 7, so no pair is compared byte by byte.
4. The smallest id of each suffix goes back to the chunks, which cut.

A hash that stands at over ``HOT`` places, as in a passage that very many
documents share, would fill one bucket.  Its suffixes travel one by one to the
buckets of their own hashes; equal ones are one string a chunk.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BUCKET, CHUNKS, LAST, ROW, Chunk, answer, answered, by, chunks_of, found, groups, pack, rows_batch, split, text_rows, told, unpack, widths
from .common import scratch, small_batches, tidy, written

LENGTH = 50
GRAM = 16
WINDOW = LENGTH - GRAM + 1
COVER, MODULUS = (0, 1, 3), 7
_COVERED = np.isin(np.arange(MODULUS), COVER)
TIE = LENGTH - MODULUS + 1
#: Bits of a hash that tell the parts of a bucket apart; parts are sorted one at a time.
PARTS = 5
#: Places beyond which a hash's suffixes are dealt out one by one.
HOT = 1 << 16
#: Bytes that are hashed at a time.
PIECE = 1 << 19


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(len(data), np.uint64)
    for o in range(8):
        part = out[o::8]
        part[:] = np.frombuffer(padded.tobytes()[o : o + 8 * len(part)], ">u8")
    return out


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    rest = width - have
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def _mixed(x: np.ndarray, bits: int) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - bits)


def _hashes(data: np.ndarray, bits: int) -> np.ndarray:
    """For each suffix of ``LENGTH`` bytes the smallest hash of the 16-byte strings in it."""
    x = _words(data)
    h = x[: len(x) - 8] * np.uint64(0x9E3779B97F4A7C15) ^ (x[8:] + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return _least(h[: len(data) - GRAM + 1], WINDOW)


def runs(c: Chunk, bits: int) -> tuple[np.ndarray, ...]:
    """(start, count, hash, document) of the runs of neighbouring suffixes with one hash of ``bits`` bits."""
    n = len(c.data) - LENGTH + 1
    past = c.starts + np.maximum(c.sizes - LENGTH + 1, 0)
    forced = np.unique(np.concatenate([c.starts, past]))
    at, least, last = [], [], None
    for p in range(0, max(n, 0), PIECE):
        v = _hashes(c.data[p : min(p + PIECE, n) + LENGTH - 1], bits)
        cut = np.ones(len(v), bool)
        cut[1:] = v[1:] != v[:-1]
        cut[0] = last is None or v[0] != last
        cut[forced[np.searchsorted(forced, p) : np.searchsorted(forced, p + len(v))] - p] = True
        here = np.flatnonzero(cut)
        at.append(here + p)
        least.append(v[here])
        last = v[-1]
    if not at:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    start, h = np.concatenate(at), np.concatenate(least)
    count = np.diff(start, append=n)
    doc = np.searchsorted(c.starts, start, "right") - 1
    inside = start < past[doc]
    # minima crowd near zero: they are mixed again so that buckets come out even
    return start[inside], count[inside], _mixed(h[inside], bits).astype(np.int64), doc[inside]


def _ask(bits: int, low: int):
    """Chunk -> for each bucket its hashes, how many places have each and whether several documents do."""

    def each(batches):
        for b in batches:
            for name, blob in zip(b.column(0).to_pylist(), (x.as_buffer() for x in b.column(1))):
                _, _, h, doc = runs(Chunk.unpacked(blob), bits)
                if not len(h):
                    continue
                order = np.argsort(h, kind="stable")
                h, doc = h[order], doc[order]
                first = np.flatnonzero(np.diff(h, prepend=-1))
                # places are in the order of documents
                many = doc[first] != doc[np.append(first[1:], len(h)) - 1]
                yield rows_batch(told(h[first], np.diff(first, append=len(h)), many, name, low))

    return each


def _window_hash(data: np.ndarray, start: np.ndarray, bits: int) -> np.ndarray:
    """A hash of the ``LENGTH`` bytes from each of ``start`` on."""
    word = _words(data)
    h = np.zeros(len(start), np.uint64)
    for o in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        h = (h ^ word[start + o]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return _mixed(h, bits).astype(np.int64)


class _Candidates:
    """The runs of a chunk whose hash is shared, equal strings once, by bucket."""

    def __init__(self, c: Chunk, shared: list[tuple], bits: int, low: int):
        known, hot = answered(shared, low)
        start, count, h, doc = runs(c, bits)
        at = found(known, h)
        hit = at >= 0
        start, count, h, doc, often = start[hit], count[hit], h[hit], doc[hit], hot[at[hit]]
        if often.any():
            n = count[often]
            one = np.repeat(start[often] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            start, doc = np.concatenate([start[~often], one]), np.concatenate([doc[~often], np.repeat(doc[often], n)])
            count = np.concatenate([count[~often], np.ones(len(one), np.int64)])
            h = np.concatenate([h[~often], _window_hash(c.data, one, bits)])
        part = h >> (low - PARTS)
        order = np.argsort(part, kind="stable")
        self.start, self.count, self.doc = start[order], count[order], doc[order]
        raw, number, parts = c.data.tobytes(), {}, []
        self.number = np.empty(len(order), np.int64)
        for i, (s, n, b) in enumerate(zip(self.start.tolist(), self.count.tolist(), part[order].tolist())):
            text = raw[s : s + n + LENGTH - 1]
            k = number.get(text)
            if k is None:
                k = number[text] = len(number)
                parts.append(b)
            self.number[i] = k
        self.texts, self.parts = list(number), np.array(parts, np.int64)
        self.sizes = np.array([len(t) - LENGTH + 1 for t in self.texts], np.int64)
        self.ids = np.full(len(self.texts), LAST, np.int64)
        np.minimum.at(self.ids, self.number, c.ids[self.doc])


def _send(bits: int, low: int):
    """Chunk and answers -> for each bucket the strings that hold shared suffixes, part by part."""

    def each(batches):
        for rows in groups(batches, "chunk"):
            if len(rows) < 2:
                continue
            got = _Candidates(Chunk.unpacked(rows[0][3]), rows[1:], bits, low)
            out = []
            for bucket, a, z in split(got.parts, PARTS):
                head = pack(got.sizes[a:z], got.ids[a:z], got.parts[a:z])
                body = zstandard.ZstdCompressor(3).compress(b"".join(got.texts[a:z]))
                out.append((rows[0][0], 2, bucket, struct.pack("<I", len(head)) + head + body))
            if out:
                yield rows_batch(out)

    return each


def _dense(*keys: np.ndarray) -> np.ndarray:
    """The rank of each row by ``keys``, the first most significant; equal rows share it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    step = np.zeros(len(order), np.int64)
    for k in keys:
        step[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    return rank


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of small non-negative numbers, and where in it each different one begins.

    Number and place are sorted as one where they fit, which is much faster
    than sorting places by number.
    """
    place = len(key).bit_length()
    if len(key) and int(key.max()).bit_length() + place <= 63:
        both = np.sort((key << place) | np.arange(len(key)))
        order, key = both & ((1 << place) - 1), both >> place
    else:
        order = np.argsort(key)
        key = key[order]
    return order, np.flatnonzero(np.diff(key, prepend=-1))


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair of ranks."""
    return (a << int(b.max(initial=0)).bit_length()) | b


def smallest_ids(data: np.ndarray, start: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For the suffixes of ``data`` at ``start``, the smallest id among those equal to ``LENGTH`` bytes."""
    word, out = _words(data), ids.copy()
    order = np.argsort(word[start])
    key = word[start[order]]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    tied = np.sort(order[same[1:] | same[:-1]])
    if not len(tied):
        return out
    start, ids = start[tied], ids[tied]
    # ranks of the cover sample, by the TIE bytes that every shift leaves
    needed = np.zeros(len(data) + MODULUS, bool)
    for shift in range(MODULUS):
        needed[start + shift] = True
    sample = np.flatnonzero(needed)
    sample = sample[_COVERED[sample % MODULUS]]
    rank = np.zeros(len(needed), np.int64)
    offsets = [*range(0, TIE - 8, 8), TIE - 8]
    rank[sample] = _dense(*(word[sample + o] for o in offsets))
    # what the rank leaves out is in the first and the last 8 bytes
    ends = _paired(_dense(word[start]), _dense(word[start + LENGTH - 8]))
    order, first = _ordered(ends)
    ends[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(ends)))
    best = ids.copy()
    for shift in range(MODULUS):
        has = np.flatnonzero(_COVERED[(start + shift) % MODULUS])
        if not len(has):
            continue
        order, first = _ordered(_paired(rank[start[has] + shift], ends[has]))
        order = has[order]
        least = np.minimum.reduceat(ids[order], first)
        best[order] = np.minimum(best[order], np.repeat(least, np.diff(first, append=len(order))))
    out[tied] = best
    return out


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start``, ``start`` + 1, ... of each run of ``count`` numbers."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _part(texts: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(string of each text, first suffix of each string, smallest id of each suffix); equal texts are one string."""
    number: dict[bytes, int] = {}
    own = np.array([number.setdefault(t, len(number)) for t in texts], np.int64)
    least = np.full(len(number), LAST, np.int64)
    np.minimum.at(least, own, ids)
    data = np.frombuffer(b"".join(number), np.uint8)
    length = np.array([len(t) for t in number], np.int64)
    size = length - (LENGTH - 1)
    start = _spread(np.cumsum(length) - length, size)
    return own, np.cumsum(size) - size, smallest_ids(data, start, np.repeat(least, size))


class _Strings:
    """What a chunk has sent to a bucket, read part after part."""

    def __init__(self, row: tuple):
        (n,) = struct.unpack_from("<I", row[3])
        self.size, self.ids, part = unpack(row[3][4 : 4 + n])
        self.raw = zstandard.ZstdDecompressor().decompress(row[3][4 + n :])
        cut = np.searchsorted(part & ((1 << PARTS) - 1), np.arange((1 << PARTS) + 1))
        self.cut, self.to = cut.tolist(), np.cumsum(self.size + LENGTH - 1)
        self.least: list[np.ndarray] = []

    def part(self, k: int) -> tuple[list[bytes], np.ndarray]:
        a, z = self.cut[k : k + 2]
        to = self.to[a:z].tolist()
        at = [int(self.to[a - 1]) if a else 0, *to]
        return [self.raw[x:y] for x, y in zip(at, to)], self.ids[a:z]


def _sort(batches):
    """Bucket -> for each chunk the smallest id of each of its suffixes, as runs in the order it sent them."""
    for rows in groups(batches, "bucket"):
        sent = [_Strings(r) for r in rows]
        for k in range(1 << PARTS):
            some = [(s, *s.part(k)) for s in sent if s.cut[k] < s.cut[k + 1]]
            if not some:
                continue
            own, base, least = _part([t for _, texts, _ in some for t in texts], np.concatenate([ids for *_, ids in some]))
            at = 0
            for s, texts, _ in some:
                number = own[at : at + len(texts)]
                s.least.append(least[_spread(base[number], s.size[s.cut[k] : s.cut[k + 1]])])
                at += len(texts)
        out = []
        for r, s in zip(rows, sent):
            least = np.concatenate(s.least)
            first = np.flatnonzero(np.diff(least, prepend=least[0] - 1))
            out.append((r[0], 2, r[2], pack(np.diff(first, append=len(least)), least[first])))
        yield rows_batch(out)


_REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(bits: int, low: int, texts: bool):
    """Chunk and smallest ids -> what stays of each document."""

    def each(batches):
        for rows in groups(batches, "chunk"):
            c = Chunk.unpacked(rows[0][3])
            shared = [r for r in rows if r[1] == 1]
            gone = np.zeros(len(c.data) + 1, np.int64)
            if shared:
                got = _Candidates(c, shared, bits, low)
                least = [unpack(r[3]) for r in rows if r[1] == 2]
                least = np.repeat(np.concatenate([p[1] for p in least]), np.concatenate([p[0] for p in least]))
                base = np.cumsum(got.sizes) - got.sizes
                window = _spread(got.start, got.count)
                hit = least[_spread(base[got.number], got.count)] < np.repeat(c.ids[got.doc], got.count)
                window = window[hit]
                gone += np.bincount(window, minlength=len(gone)) - np.bincount(window + LENGTH, minlength=len(gone))
            gone = np.cumsum(gone)[:-1] > 0
            out = []
            for i, s, n in zip(c.ids.tolist(), c.starts.tolist(), c.sizes.tolist()):
                g = gone[s : s + n]
                kept = c.data[s : s + n][~g].tobytes()
                spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + bool(n and g[0]))
                out.append((None if i == LAST else i, n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            columns = zip(*out)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], _REPORT.replace(",", "").split()[::2])

    return each


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    ``kept`` holds the remaining bytes where ``texts`` is set and else is
    null.  A null text is empty.  Rows that share an id don't remove from each
    other.  A null id counts as larger than all others; ids are integers below
    2**63 - 1.  Other columns of ``docs`` are not read.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    # about a 17th of all positions start a run
    bits, low = widths(max(size // 17, 1), BUCKET)
    with small_batches(docs.sparkSession), tidy(docs.sparkSession), scratch() as kept:
        chunks = kept(base.mapInArrow(chunks_of, CHUNKS), "chunks")
        of_text = text_rows(chunks)
        asked = chunks.mapInArrow(_ask(bits, low), ROW)
        shared = kept(by("bucket", asked).mapInArrow(answer(HOT), ROW), "shared")
        sent = by("chunk", of_text.unionAll(shared)).mapInArrow(_send(bits, low), ROW)
        least = by("bucket", sent).mapInArrow(_sort, ROW)
        return written(by("chunk", of_text.unionAll(shared).unionAll(least)).mapInArrow(_cut(bits, low, texts), _REPORT), "cut")
