"""Fuzzy keys from the binary Golay code [23, 12, 7].

The code is perfect: each 23-bit word is within 3 bits of one codeword.  A
word at distance 3 from it has five more codewords at distance 4.  Two words
that differ in one bit share their nearest codeword, or else both are at
distance 3 and each one's nearest codeword is among the other's five.  So the
nearest index, with those of the five that are smaller, meet for any such pair.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code.
GENERATOR = 0xC75
LENGTH, CHECK = 23, 11


def _remainder(word: int) -> int:
    for i in range(LENGTH - 1, CHECK - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECK)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes by byte of a word, and by syndrome up to six error patterns, nearest first, -1 where there are fewer."""
    one = [_remainder(1 << i) for i in range(LENGTH)]

    def of(bits) -> int:
        s = 0
        for i in bits:
            s ^= one[i]
        return s

    by_byte = np.array([[of(8 * k + i for i in range(8) if v >> i & 1 and 8 * k + i < LENGTH) for v in range(256)] for k in range(3)], np.uint32)
    errors = np.full((1 << CHECK, 6), -1, np.int64)
    used = np.zeros(1 << CHECK, np.int64)
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            s = of(bits)
            if weight < 4 or errors[s, 0].item().bit_count() == 3:
                errors[s, used[s]] = sum(1 << i for i in bits)
                used[s] += 1
    return by_byte, errors


def indices(words: np.ndarray) -> np.ndarray:
    """Codeword indices of 23-bit ``words``: six columns, the nearest first, -1 for none."""
    by_byte, errors = _tables()
    w = words.astype(np.uint32)
    syndrome = by_byte[0][w & 255] ^ by_byte[1][w >> 8 & 255] ^ by_byte[2][w >> 16 & 127]
    e = errors[syndrome]
    found = np.where(e >= 0, (w[:, None].astype(np.int64) ^ e) >> CHECK, -1)
    found[:, 1:][found[:, 1:] >= found[:, :1]] = -1
    return found


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each fuzzy key of 64-bit ``fingerprints``.

    Of at most 3 differing bits in four 16-bit segments either two segments
    have none, or one has none and each other segment one.  For the first case
    a key is a pair of whole segments; for the second it is a whole segment
    with codeword indices of the next two.  So two fingerprints within 3 bits
    share a key, and a key tells 32 bits or more apart.
    """
    f = fingerprints.astype(np.uint64)
    segment = [((f >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    index = [indices(s) for s in segment]
    rows, out = [], []
    for kind, (i, j) in enumerate(combinations(range(4), 2)):
        rows.append(np.arange(len(f)))
        out.append(segment[i] | segment[j] << 16 | kind << 40)
    for i in range(4):
        a, b = index[(i + 1) % 4], index[(i + 2) % 4]
        r, x, y = np.nonzero((a >= 0)[:, :, None] & (b >= 0)[:, None, :])
        rows.append(r)
        out.append(segment[i][r] | a[r, x] << 16 | b[r, y] << 28 | (6 + i) << 40)
    return np.concatenate(rows), np.concatenate(out)
