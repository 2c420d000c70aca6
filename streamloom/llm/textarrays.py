"""The words, sentences and lines of many texts at once, as arrays.

Texts stand one after the other in one array of UTF-8 bytes.  A word is a run
``[^\\x20\\x09-\\x0D]+``; A-Z count as a-z.  Words have 64-bit hashes, which
shingles, minima and names are made from without a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache, cached_property

import numpy as np

#: Bytes whose words are hashed at a time.
PIECE = 1 << 20
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_random = np.random.default_rng(20)
#: A number for each byte, the same for both cases of a letter.
_BYTE = _random.integers(0, 2**64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_STEP = _random.integers(0, 2**64, 8, np.uint64) * np.uint64(8) + np.uint64(3)
#: A sentence ends with a word that ends with one of these.
_MARK = np.isin(np.arange(256), list(b".!?"))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@cache
def _powers(step: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse modulo 2**64, 2**bits of each."""
    out = []
    for x in (step, pow(step, -1, 1 << 64)):
        p = np.full(1 << bits, x, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def sequence_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray, step: int) -> np.ndarray:
    """A hash of each ``values[start:stop]``, which doesn't depend on where it stands."""
    n = len(values)
    power, inverse = _powers(int(_STEP[step]), max(n.bit_length(), 12))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * power[:n], out=sums[1:])
    return mixed((sums[stop] - sums[start]) * inverse[start])


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start``, ``start`` + 1, ... for each ``count``."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Words:
    """``at`` and ``to``: where each word starts and ends; ``doc``: the text it is in; ``hash``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.data, self.starts, self.sizes = data, starts, sizes
        first = np.zeros(len(data) + 1, bool)
        first[starts] = True
        solid = ~_SPACE[data]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1] | first[1:-1]
        end[:-1] &= ~solid[1:] | first[1:-1]
        self.at, self.to = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.words_of = np.diff(np.searchsorted(self.at, np.append(starts, len(data))))
        self.doc = np.repeat(np.arange(len(starts)), self.words_of)

    @cached_property
    def hash(self) -> np.ndarray:
        out, i = np.empty(len(self.at), np.uint64), 0
        while i < len(self.at):
            j = max(int(np.searchsorted(self.at, self.at[i] + PIECE)), i + 1)
            lo, hi = self.at[i], self.to[j - 1]
            out[i:j] = sequence_hashes(_BYTE[self.data[lo:hi]], self.at[i:j] - lo, self.to[i:j] - lo, 0)
            i = j
        return out

    def __len__(self) -> int:
        return len(self.at)

    def counts(self) -> np.ndarray:
        """The words of each text."""
        return self.words_of

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a line, and whether a sentence ends with each word; a line ends a sentence, a text a line."""
        if not len(self):
            return np.zeros(0, bool), np.zeros(0, bool)
        line = np.append(self.doc[1:] != self.doc[:-1], True)
        # the word before each line break
        before = np.searchsorted(self.at, np.flatnonzero(self.data == 10)) - 1
        line[before[before >= 0]] = True
        return line, line | _MARK[self.data[self.to - 1]]

    def shingles(self, size: int) -> np.ndarray:
        """The hash of the ``size`` words from each word on; zero where there are fewer."""
        n = len(self) - size + 1
        out = np.zeros(len(self), np.uint64)
        if n > 0:
            h = np.zeros(n, np.uint64)
            for k in range(size):
                h = mixed((h + self.hash[k : k + n]) * _STEP[1])
            out[:n] = h
        return out


def text_shingles(texts: Iterable[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its shingles in order; of fewer words the one there is, of none none."""

    def out() -> Iterator[np.ndarray]:
        sizes = np.array(list(map(len, held)), np.int64)
        w = Words(np.frombuffer(b"".join(held), np.uint8), np.cumsum(sizes) - sizes, sizes)
        h, n = w.shingles(size), w.counts()
        first = np.cumsum(n) - n
        whole = sequence_hashes(mixed(w.hash), first, first + n, 4)
        for d, (a, k) in enumerate(zip(first.tolist(), n.tolist())):
            yield h[a : a + k - size + 1] if k >= size else whole[d : d + 1] if k else h[:0]

    held, length = [], 0
    for t in texts:
        held.append(t)
        length += len(t)
        if length >= PIECE:
            yield from out()
            held, length = [], 0
    if held:
        yield from out()
