"""Vectorised 64-bit hashes of words and word n-grams over the UTF-8 bytes of many texts at once.

A word's hash is a polynomial over random byte values, taken from prefix sums: multiplying a
range's sum by the inverse power of its start makes it independent of the position.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)
_STEP = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes between words: space, tab, line feed, vertical tab, form feed, carriage return
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self, base: int):
        self.base, self.a = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.a) < n:
            m = max(n, _STEP + 1)
            a = np.full(m, self.base, np.uint64)
            a[0] = 1
            self.a = np.multiply.accumulate(a)
        return self.a[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INV)


def word_ranges(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of the words of all texts, and for each text the index of
    its first word (n+1 long). Words are maximal runs of bytes that are not ``space``; none spans two texts."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    begin[cut] = inside[cut]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | begin[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, with A-Z lower-cased; ranges in ascending order."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _STEP, side="right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[LOWER[data[a:b]]] * _UP.upto(b - a), out=total[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = mix((total[e] - total[s]) * _DOWN.upto(b - a + 1)[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): hashes of the n-word windows of each text, and each text's first window.
    A text of 1 to n-1 words gives its whole sequence as one window; one without words gives none."""
    count = np.diff(first)
    windows = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = np.zeros(len(first), np.int64)
    np.cumsum(windows, out=at[1:])
    start = np.repeat(first[:-1] - at[:-1], windows) + np.arange(at[-1])
    width = np.repeat(np.minimum(count, n), windows)
    acc = width.astype(np.uint64)
    for k in range(n):
        use = width > k
        term = np.zeros(len(start), np.uint64)
        term[use] = words[start[use] + k]
        acc = mix(acc * np.uint64(_BASE) + term) if k else acc * np.uint64(_BASE) + term
    return mix(acc), at
