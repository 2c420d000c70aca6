"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Tokenizers are not trained here, and the only vocabulary at hand in this format
is a BPE model, whose scores are merge ranks.  A piece's log score is then
-log(id), by Zipf's law; a unigram model's scores are used as they are.

All different words of a batch are segmented at once, one step for each offset
in a word.  A run without a space is one word, so a very long one takes a step
a byte: right, but slow (about 9 s for a MB).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary is; it is read on the driver and broadcast (some MB).
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNK_PENALTY = 10.0
NORMAL, UNKNOWN, BYTE, USER_DEFINED = 1, 2, 6, 4
UNIGRAM = 1
#: Characters that are encoded together, and distinct words a worker remembers.
GROUP, REMEMBERED = 1 << 21, 300_000


class DoubleArray:
    """A trie over byte strings: from node s, byte c leads to t = base[s] + c + 1 where check[t] == s."""

    def __init__(self, words: list[bytes], values: list[int]):
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for w, v in zip(words, values):
            at = 0
            for c in w:
                if c not in tree[at]:
                    tree[at][c] = len(tree)
                    tree.append({})
                at = tree[at][c]
            ends[at] = v
        size = 2 * len(tree) + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], free = 0, 1
        todo = [(0, 0)]
        for node, slot in todo:
            kids = sorted(tree[node])
            if not kids:
                continue
            while check[free] != -1:
                free += 1
            # a crowded region is given up after some tries, which keeps the build linear
            at, tries = free, 0
            while True:
                b = at - kids[0] - 1
                if b >= 0 and all(b + c + 1 < size and check[b + c + 1] == -1 for c in kids):
                    break
                at, tries = at + 1, tries + 1
                if at + 512 >= size:
                    grow = size
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                    size += grow
            if tries > 2000:
                free += 200
            base[slot] = b
            for c in kids:
                t = b + c + 1
                check[t] = slot
                value[t] = ends.get(tree[node][c], -1)
                todo.append((tree[node][c], t))
        pad = [0] * 257
        self.base = np.array(base + pad, np.int32)
        self.check = np.array(check + [-1] * 257, np.int32)
        self.check[0] = -1
        self.value = np.array(value + [-1] * 257, np.int32)
        self.depth = max(map(len, words), default=0)

    def matches(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, value) of each word of the trie at ``starts`` of ``data``, all positions at once."""
        found, at, node = [], starts, np.zeros(len(starts), np.int32)
        for depth in range(1, self.depth + 1):
            inside = at + depth - 1 < len(data)
            at, node = at[inside], node[inside]
            nxt = self.base[node] + data[at + depth - 1] + 1
            ok = self.check[nxt] == node
            at, node = at[ok], nxt[ok]
            if not len(at):
                break
            v = self.value[node]
            hit = v >= 0
            found.append((at[hit], np.full(int(hit.sum()), depth), v[hit]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3


class Codec:
    """Encodes and decodes with the pieces of one model.

    A unigram model's scores are log probabilities and are used as they are.
    A BPE model has merge ranks instead; there a piece's score is -log of its
    id, by Zipf's law.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(model)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with the identity normalizer are supported")
        self.prefix = spec.add_dummy_prefix
        pieces = list(proto.pieces)
        as_is = proto.trainer_spec.model_type == UNIGRAM
        self.scores = np.array([p.score if as_is else -np.log(i + 1.0) for i, p in enumerate(pieces)], np.float32)
        used = [i for i, p in enumerate(pieces) if p.type in (NORMAL, USER_DEFINED)]
        self.unk = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
        self.unk_score = np.float32(min((self.scores[i] for i in used), default=0) - UNK_PENALTY)
        self.trie = DoubleArray([pieces[i].piece.encode() for i in used], used)
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == BYTE}
        self.byte_ids = np.array([byte.get(b, self.unk) for b in range(256)], np.int32)
        self.is_byte = np.isin(np.arange(len(pieces)), list(byte.values()))
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() if p.type in (NORMAL, USER_DEFINED) else b"" for p in pieces]
        # No piece goes on from another character to a space marker, so a text
        # can be cut before each space and its parts encoded one by one.
        cut = not any(re.search(f"[^{SPACE}]{SPACE}", pieces[i].piece) for i in used)
        self.part = re.compile(" *[^ ]+| +" if cut else "(?s:.+)")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "flat", "starts", "lengths")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _viterbi(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``parts``, and how many each has."""
        coded = [p.replace(" ", SPACE).encode() for p in parts]
        data = np.frombuffer(b"\xff".join(coded) + b"\xff", np.uint8).astype(np.int32)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        chars = np.flatnonzero((data & 0xC0 != 0x80) & (data != 0xFF))
        width = np.select([data[chars] < 0x80, data[chars] < 0xE0, data[chars] < 0xF0], [1, 2, 3], 4)
        start, length, piece = self.trie.matches(data, chars)
        single = np.zeros(len(data), bool)
        wide = np.zeros(len(data), np.int64)
        wide[chars] = width
        single[start[length == wide[start]]] = True
        lone = ~single[chars]
        start = np.concatenate([start, chars[lone]])
        length = np.concatenate([length, width[lone]])
        score = np.concatenate([self.scores[piece], np.full(int(lone.sum()), self.unk_score, np.float32)])
        piece = np.concatenate([piece, np.full(int(lone.sum()), self.unk)])
        offset = start - first[np.searchsorted(first, start, "right") - 1]
        order = np.argsort(offset, kind="stable")
        start, length, piece, score, offset = start[order], length[order], piece[order], score[order], offset[order]
        best = np.full(len(data) + 1, -np.inf, np.float32)
        best[first] = 0
        back, by = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
        cuts = np.flatnonzero(np.diff(offset, prepend=-1, append=-1)).tolist()
        # Paths are extended from all positions at the same offset in their
        # parts; they reach different ends, so none overwrites another.
        for lo, hi in zip(cuts, cuts[1:]):
            s = start[lo:hi]
            end, reached = s + length[lo:hi], best[s] + score[lo:hi]
            better = reached > best[end]
            end = end[better]
            best[end], back[end], by[end] = reached[better], s[better], piece[lo:hi][better]
        ids, counts = [], []
        raw, byte_ids, unk = data, self.byte_ids, self.unk
        for lo, hi in zip(first.tolist(), (first + sizes).tolist()):
            own = []
            while hi > lo:
                p, at = by[hi], back[hi]
                if p == unk:
                    own.extend(byte_ids[raw[at:hi][::-1]].tolist())
                else:
                    own.append(p)
                hi = at
            ids.extend(reversed(own))
            counts.append(len(own))
        return np.array(ids, np.int32), np.array(counts, np.int64)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        lead = " " if self.prefix else ""
        cut = [self.part.findall(lead + t.replace(SPACE, " ")) if t else [] for t in texts]
        new = [p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = list(dict.fromkeys(chain.from_iterable(cut)))
        if new:
            ids, counts = self._viterbi(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.lengths = np.concatenate([self.lengths, counts])
            self.flat = np.concatenate([self.flat, ids])
        out = []
        for parts in cut:
            k = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
            n = self.lengths[k]
            out.append(self.flat[np.repeat(self.starts[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids) -> str:
        """The text of ``ids``; control pieces are empty and broken UTF-8 becomes U+FFFD."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@cache
def codec(path: str = MODEL) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


def _groups(column: pa.Array) -> Iterator[list[str]]:
    group, size = [], 0
    for t in column.to_pylist():
        group.append(t)
        size += len(t)
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """doc_id, ids (array of int) of each row of ``docs``.

    A row for each row, repeated ones too.  Null and empty texts have no ids;
    texts are encoded whole, however long.  Of segmentations with the same
    score the one found first counts, always the same.  A literal U+2581 in a
    text is a space to this format and comes back as one; all else decodes to
    itself.  Other columns of ``docs`` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec(path))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for group in _groups(b.column(1)):
                ids = shared.value.encode_batch(group)
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(group)), lists], ["doc_id", "ids"])
                at += len(group)

    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(each, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text of rows with doc_id, ids.  Null ids have the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(codec(path))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [shared.value.decode(x or ()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(each, "doc_id long, text string")


def encode_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_sha256, round_trip of each row of ``docs``.

    ids_sha256 is over the ids as little-endian 32-bit numbers; round_trip
    tells whether decoding the ids gives the text (with U+2581 as a space).
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec(path))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, at = shared.value, 0
            for group in _groups(b.column(1)):
                ids = c.encode_batch(group)
                columns = [
                    b.column(0).slice(at, len(group)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([int(c.is_byte[x].sum()) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]),
                    pa.array([c.decode(x.tolist()) == t.replace(SPACE, " ") for x, t in zip(ids, group)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip"])
                at += len(group)

    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(each, "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean")
