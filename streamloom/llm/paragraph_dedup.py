"""Substring dedup by paragraphs: MinHash bands, exact Jaccard, components.

A paragraph is a sentence or a line, whichever ends first, so that a passage
set into a longer line is found by its own sentences.  Paragraphs of at least
``MIN_WORDS`` words are compared by their sets of five-word shingles and link
at a Jaccard similarity of 0.8 or more; of each component of links the first
paragraph stays, by document id and place.  Lines of several sentences are
compared in the same way beside their sentences and go as a whole.

Sentences of fewer words are compared in windows: one with the sentences
before it, or after it, up to ``MIN_WORDS`` words or the text's end.  They go
where the words of a window stand in an earlier place as well.  Nothing goes
that wasn't compared.

Band keys are exchanged in chunks (see ``chunks``): only paragraphs that share
a key with another one become rows.  Equal paragraphs are one row, whatever
their number; a bucket of very many different ones is split into pairs of
blocks.  Band keys with the same paragraphs are one meeting, so a pair that
shares all its bands is verified once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import BUCKET, CHUNKS, LAST, ROW, Chunk, answer, answered, by, chunks_of, found, groups, rows_batch, text_rows, told, widths
from .common import scratch, small_batches, tidy, written
from .components import components
from .runs import linked_sets, meetings
from .textarrays import Words, mixed, ranges, sequence_hashes, text_shingles

SHINGLE, MIN_WORDS = 5, 8
#: Jaccard similarity that links, as a fraction.
NEAR = (4, 5)
RECALL = 0.995
SEED = 42


def tuned(similarity: float = NEAR[0] / NEAR[1], recall: float = RECALL, rows: int = 3) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` rows that find a pair of this similarity with this chance.

    At 0.8 that is 8 bands of 3 rows, which miss 0.3% of pairs; at 0.9 they
    miss one in 20,000.
    """
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands, rows


BANDS, ROWS = tuned()
_random = np.random.default_rng(SEED)
_XOR = _random.integers(0, 2**63, BANDS * ROWS, np.uint64)
_ODD = _random.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)

LINE, SENTENCE, WINDOW = range(3)
_PLACE = np.dtype([("doc", ">u8"), ("number", ">u4")])
#: Where a unit stands in its chunk: first sentence, and the one behind the last times 4 with the level.
_SPOT = np.dtype([("a", "<i4"), ("z", "<i4")])
#: What a chunk is asked for: a run, a node's place, and the bytes of its words.
_ASKED = np.dtype([("run", ">i8"), ("doc", ">u8"), ("number", ">u8"), ("from", ">i8"), ("to", ">i8")])
_SIGN = np.uint64(1 << 63)


def binaries(values: np.ndarray) -> pa.Array:
    """Each of ``values`` as its bytes."""
    offsets = (np.arange(len(values) + 1) * values.dtype.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _windows(first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, behind the last) of the windows of the short ones among sentences.

    ``first`` and ``last`` are the words each starts with and ends before,
    ``low`` and ``high`` the sentences its text starts with and ends before.
    """
    short = np.flatnonzero(last - first < MIN_WORDS)
    low, high = low[short], high[short]
    before = np.maximum(np.searchsorted(first, last[short] - MIN_WORDS, "right") - 1, low)
    after = np.minimum(np.searchsorted(last, first[short] + MIN_WORDS, "left") + 1, high)
    left = last[short] - first[before] >= MIN_WORDS
    right = last[after - 1] - first[short] >= MIN_WORDS
    alone = ~left & ~right
    pairs = np.concatenate(
        [
            np.stack([before, short + 1], 1)[left],
            np.stack([short, after], 1)[right],
            np.stack([before, after], 1)[alone],
        ]
    )
    n = len(first) + 1
    return np.divmod(np.unique(pairs[:, 0] * n + pairs[:, 1]), n)


class Sentences:
    """The sentences of a chunk: ``first`` and ``last`` are the words each starts with and ends before, ``doc`` its document and ``number`` its place in this."""

    def __init__(self, c: Chunk):
        self.chunk, self.words = c, Words(c.data, c.starts, c.sizes)
        self.line, sentence = self.words.ends()
        self.last = np.flatnonzero(sentence) + 1
        self.first = np.concatenate([[0], self.last[:-1]]).astype(np.int64)[: len(self.last)]
        self.doc = self.words.doc[self.first] if len(self.last) else np.zeros(0, np.int64)
        self.per_doc = np.bincount(self.doc, minlength=len(c.starts))
        self.below = np.cumsum(self.per_doc) - self.per_doc
        self.number = np.arange(len(self.doc)) - self.below[self.doc]

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of each: it reaches to the next one, and a text's first starts with the text."""
        if not len(self.doc):
            return self.doc, self.doc
        c = self.chunk
        from_ = np.where(self.number > 0, self.words.at[self.first], c.starts[self.doc])
        last = self.number + 1 == self.per_doc[self.doc]
        return from_, np.where(last, (c.starts + c.sizes)[self.doc], np.append(from_[1:], 0))


class Paragraphs(Sentences):
    """What is compared of a chunk: level, first sentence and the one behind the last, 128-bit name of each unit."""

    def __init__(self, c: Chunk):
        super().__init__(c)
        w, size = self.words, self.last - self.first
        some = np.flatnonzero(size >= MIN_WORDS)
        # sentences behind the last of each line
        z = np.flatnonzero(self.line[self.last - 1]) + 1
        a = np.concatenate([[0], z[:-1]]).astype(np.int64)[: len(z)]
        several = (z - a > 1) & (self.last[z - 1] - self.first[a] >= MIN_WORDS) if len(z) else np.zeros(0, bool)
        a, z = a[several], z[several]
        x, y = some[:0], some[:0]
        if len(some) < len(size):
            x, y = _windows(self.first, self.last, self.below[self.doc], (self.below + self.per_doc)[self.doc])
        self.level = np.repeat([SENTENCE, LINE, WINDOW], [len(some), len(a), len(x)])
        self.a, self.z = np.concatenate([some, a, x]), np.concatenate([some + 1, z, y])
        from_, to = self.first[self.a], self.last[self.z - 1]
        name = [sequence_hashes(mixed(w.hash + np.uint64(k)), from_, to, k) for k in (2, 3)]
        # windows meet windows only
        name[0] = np.where(self.level == WINDOW, mixed(name[0] + np.uint64(WINDOW)), name[0])
        self.name = np.stack(name, axis=1)
        # one of each different unit, how often it is there, and which of them each is
        order = np.lexsort((name[1], name[0]))
        new = np.ones(len(order), bool)
        new[1:] = (self.name[order[1:]] != self.name[order[:-1]]).any(axis=1)
        self.once, self.which = order[new], np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.times = np.bincount(self.which, minlength=len(self.once))

    def by_place(self) -> np.ndarray:
        """All units: those that are equal follow each other, by place."""
        return np.lexsort((self.level, self.number[self.a], self.chunk.ids[self.doc[self.a]], self.which))

    def keys(self) -> np.ndarray:
        """The band keys of each different unit, one row a unit; a window's are all one key, of its name."""
        out = np.empty((len(self.once), BANDS), np.uint64)
        level = self.level[self.once]
        out[:] = self.name[self.once, :1]
        if not (level != WINDOW).any():
            return out
        h = self.words.shingles(SHINGLE)
        for kind in (SENTENCE, LINE):
            rows = np.flatnonzero(level == kind)
            if not len(rows):
                continue
            # units of one level don't overlap; a range ends before the next one begins
            unit = self.once[rows]
            order = np.argsort(self.a[unit])
            rows, unit = rows[order], unit[order]
            from_, to = self.first[self.a[unit]], self.last[self.z[unit] - 1] - (SHINGLE - 1)
            cut = np.stack([from_, to], axis=1).ravel()
            band = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(unit), axis=0)
            for k, (x, o) in enumerate(zip(_XOR, _ODD)):
                least = np.minimum.reduceat((h ^ x) * o, cut)[::2]
                band[:, k // ROWS] = mixed(band[:, k // ROWS] * np.uint64(0xD6E8FEB86659FD93) + least)
            out[rows] = band
        return out


def _ask(bits: int, low: int):
    """Chunk -> for each bucket the band keys of its units, and which several of them have."""

    def each(batches):
        for b in batches:
            for name, blob in zip(b.column(0).to_pylist(), (x.as_buffer() for x in b.column(1))):
                p = Paragraphs(Chunk.unpacked(blob))
                if not len(p.once):
                    continue
                window = p.level[p.once] == WINDOW
                keys = (p.keys() >> np.uint64(64 - bits)).astype(np.int64)
                h = np.concatenate([keys[~window].ravel(), keys[window, 0]])
                times = np.concatenate([np.repeat(p.times[~window], BANDS), p.times[window]])
                order = np.argsort(h, kind="stable")
                h = h[order]
                first = np.flatnonzero(np.diff(h, prepend=-1))
                # also a unit that stands twice in the chunk makes its keys shared
                count = np.add.reduceat(times[order], first)
                yield rows_batch(told(h[first], count, count > 1, name, low))

    return each


_SENT = pa.schema([(x, pa.int64()) for x in ("chunk", "n1", "n2", "doc", "number", "from", "to", "n")] + [("keys", pa.list_(pa.int64())), ("spots", pa.binary())])


def _send(bits: int, low: int):
    """Chunk and answers -> a row for each unit that may have a partner: its name, first place, words, keys and spots."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "chunk"):
            if len(rows) < 2:
                continue
            known, _ = answered(rows[1:], low)
            p = Paragraphs(Chunk.unpacked(rows[0][3]))
            keys = p.keys()
            hit = found(known, (keys >> np.uint64(64 - bits)).astype(np.int64).ravel()).reshape(keys.shape) >= 0
            kept = hit.any(axis=1)
            units = p.by_place()
            units = units[kept[p.which[units]]]
            some, n = np.flatnonzero(kept), p.times[kept]
            early = units[np.cumsum(n) - n]
            # equal windows have met by name
            hit = hit[some] & (p.level[early] != WINDOW)[:, None]
            spots = np.empty(len(units), _SPOT)
            spots["a"], spots["z"] = p.a[units], 4 * p.z[units] + p.level[units]
            a, z = p.a[early], p.z[early]
            numbers = [
                np.full(len(some), rows[0][0]),
                *p.name[early].view(np.int64).T,
                p.chunk.ids[p.doc[a]],
                4 * p.number[a] + p.level[early],
                p.words.at[p.first[a]],
                p.words.to[p.last[z - 1] - 1],
                n,
            ]
            own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(hit.sum(axis=1))]), pa.int32()), pa.array(keys[some][hit].view(np.int64)))
            ends = np.concatenate([[0], np.cumsum(n) * _SPOT.itemsize]).astype(np.int32)
            at = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(spots.tobytes())])
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), own, at], schema=_SENT)

    return each


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk and what is asked of it -> a row for each run of each node, with the words."""
    for rows in groups(batches, "chunk"):
        if len(rows) < 2:
            continue
        raw = Chunk.unpacked(rows[0][3]).data.tobytes()
        asked = np.frombuffer(b"".join(r[3].to_pybytes() for r in rows[1:]), _ASKED)
        place = np.empty(len(asked), _PLACE)
        place["doc"], place["number"] = asked["doc"], asked["number"]
        texts = [raw[a:z] for a, z in zip(asked["from"].tolist(), asked["to"].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(asked["run"].astype(np.int64)), binaries(place), pa.array(texts, pa.binary())], ["run", "node", "text"])


def _sets(run: pa.Table) -> list[np.ndarray]:
    return [np.unique(h) for h in text_shingles(run["text"].to_pylist(), SHINGLE)]


_REPORT = "doc_id long, n_paragraphs long, n_removed long, n_bytes long, kept_bytes long, kept_sha256 string, repeats_of array<long>, kept binary"


def _cut(texts: bool):
    """Chunk and the roots of its units -> what stays of each document."""
    kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64()), pa.binary()]
    names = ["doc_id", "n_paragraphs", "n_removed", "n_bytes", "kept_bytes", "kept_sha256", "repeats_of", "kept"]

    def gone(p: Sentences, rows: list[tuple]) -> tuple[np.ndarray, dict[int, list[int]]]:
        """Which sentences go, and the documents that theirs repeat."""
        if not rows:
            return np.zeros(len(p.doc), bool), {}
        raw = np.frombuffer(b"".join(r[3].to_pybytes() for r in rows), np.uint8)
        size = np.array([r[3].size for r in rows])
        at = np.cumsum(size) - size
        root = raw[ranges(at, np.full(len(rows), _PLACE.itemsize))].view(_PLACE)
        n = (size - _PLACE.itemsize) // _SPOT.itemsize
        spots = raw[ranges(at + _PLACE.itemsize, n * _SPOT.itemsize)].view(_SPOT)
        a, z, level = spots["a"].astype(np.int64), spots["z"].astype(np.int64) >> 2, spots["z"] & 3
        root = np.repeat(root, n)
        doc = (root["doc"].astype(np.uint64) ^ _SIGN).view(np.int64)
        # the first of the equal and similar ones stays
        other = (doc != p.chunk.ids[p.doc[a]]) | (root["number"] != 4 * p.number[a] + level)
        a, z, doc, window = a[other], z[other], doc[other], level[other] == WINDOW

        def covered(some: np.ndarray) -> np.ndarray:
            steps = np.bincount(a[some], minlength=len(p.doc) + 1) - np.bincount(z[some], minlength=len(p.doc) + 1)
            return np.cumsum(steps)[:-1] > 0

        of: dict[int, list[int]] = {}
        pairs = np.empty(len(a), [("doc", np.int64), ("of", np.int64)])
        pairs["doc"], pairs["of"] = p.doc[a], doc
        for d, i in np.unique(pairs).tolist():
            of.setdefault(d, []).append(i)
        return covered(~window) | covered(window) & (p.last - p.first < MIN_WORDS), of

    def each(batches):
        for rows in groups(batches, "chunk"):
            c = Chunk.unpacked(rows[0][3])
            p = Sentences(c)
            cut, of = gone(p, rows[1:])
            from_, to = p.bounds()
            stays = np.ones(len(c.data), bool)
            stays[ranges(from_[cut], (to - from_)[cut])] = False
            removed = np.bincount(p.doc[cut], minlength=len(c.ids)).tolist()
            out = []
            for d, (i, s, n) in enumerate(zip(c.ids.tolist(), c.starts.tolist(), c.sizes.tolist())):
                text = c.data[s : s + n]
                kept = (text[stays[s : s + n]] if removed[d] else text).tobytes()
                repeats = [x for x in of.get(d, ()) if x != i]
                out.append((None if i == LAST else i, int(p.per_doc[d]), removed[d], n, len(kept), hashlib.sha256(kept).hexdigest(), repeats, kept if texts else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    return each


def _bytes(n: Column, digits: int = 16) -> Column:
    """A number as big-endian bytes."""
    return F.unhex(F.substring(F.lpad(F.hex(n), 16, "0"), 17 - digits, digits))


def _packed(*parts: tuple[str, int]) -> Column:
    """Columns of so many bits as one number, the first most significant: aggregates of numbers need no sort."""
    out = F.lit(0).cast("decimal(38,0)")
    for name, bits in parts:
        out = (out * F.lit(1 << bits).cast("decimal(20,0)")).cast("decimal(38,0)") + F.col(name).cast("decimal(20,0)")
    return out.cast("decimal(38,0)")


def _unpacked(n: str, *bits: int) -> list[Column]:
    out, left = [], F.col(n)
    for b in reversed(bits):
        size = F.lit(1 << b).cast("decimal(20,0)")
        low = F.pmod(left, size)
        out.append(low.cast("bigint"))
        left = ((left - low) / size).cast("decimal(38,0)")
    return [left.cast("bigint"), *out[::-1]]


def remove_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """A row for each row of ``docs``: how many paragraphs it has and loses, and what stays.

    ``repeats_of`` are the ids of the other documents whose paragraphs its
    removed ones repeat; ``kept`` holds the remaining bytes where ``texts`` is
    set and else is null.  A null text is empty.  Of rows with the same id
    the same place counts as one, so neither loses what both have there.  A
    null id is larger than all others.  Other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    bits, low = widths(max(size // 60 * BANDS, 1), BUCKET)

    def row(*parts: Column) -> list[Column]:
        return [F.col("chunk"), F.lit(1).alias("kind"), F.lit(0).alias("bucket"), F.concat(*parts).alias("blob")]

    with small_batches(docs.sparkSession), tidy(docs.sparkSession), scratch() as kept:
        chunks = kept(base.mapInArrow(chunks_of, CHUNKS), "chunks")
        of_text = text_rows(chunks)
        shared = by("bucket", chunks.mapInArrow(_ask(bits, low), ROW)).mapInArrow(answer(), ROW)
        columns = "chunk long, n1 long, n2 long, doc long, number long, from long, to long, n long, keys array<long>, spots binary"
        sent = kept(by("chunk", of_text.unionAll(shared)).mapInArrow(_send(bits, low), columns), "paragraphs")
        # equal paragraphs are one node: the first of their places, and words that stand in one of their chunks
        places = sent.groupBy("n1", "n2").agg(F.min(_packed(("doc", 32), ("number", 32))).alias("place"), F.min(_packed(("chunk", 31), ("from", 31), ("to", 31))).alias("where"), F.sum("n").alias("n"))
        doc, number = _unpacked("place", 32)
        chunk, from_, to = _unpacked("where", 31, 31)
        own = doc.bitwiseXOR(F.lit(-(2**63)).cast("bigint"))
        nodes = places.select("n1", "n2", F.xxhash64("n1", "n2").alias("id"), own.alias("doc"), number.alias("number"), chunk.alias("chunk"), from_.alias("from"), to.alias("to"), "n")
        nodes = kept(nodes.withColumn("place", F.concat(_bytes(F.col("doc")), _bytes(F.col("number"), 8))), "nodes")
        # keys meet first, without texts; by 64 bits of a name, which only chooses what is compared
        keys = sent.filter("size(keys) > 0").select(F.explode("keys").alias("key"), F.xxhash64("n1", "n2").alias("id"))
        met = kept(meetings(keys.distinct(), "key", "id"), "meetings")
        asked = nodes.join(met, "id").select(*row(*map(_bytes, map(F.col, ("run", "doc", "number", "from", "to")))))
        text = by("chunk", of_text.unionAll(asked)).mapInArrow(_texts, "run long, node binary, text binary")
        links = kept(linked_sets(text, _sets, NEAR, "a binary, b binary"), "links")
        rooted = nodes.select("n1", "n2", "place", "n").join(components(links), F.col("place") == F.col("node"), "left")
        moved = rooted.filter("n > 1 or root is not null").select("n1", "n2", F.coalesce("root", "place").alias("root"))
        # the rows that hold a very frequent paragraph are one a chunk at most
        gone = sent.select("chunk", "n1", "n2", "spots").join(moved, ["n1", "n2"]).select(*row(F.col("root"), F.col("spots")))
        return written(by("chunk", of_text.unionAll(gone)).mapInArrow(_cut(texts), _REPORT), "cut")
