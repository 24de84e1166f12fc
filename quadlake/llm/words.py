"""64-bit hashes of the words of a text, all at once.

Words are runs of bytes other than blank and the five control characters after it; in
UTF-8 these bytes are never part of another character. The hash of a word is a polynomial
over a table of random bytes' values, modulo 2 ** 64, taken for all words by differences
of running sums; a final mix spreads it. Different words share a hash with a probability
of about 2 ** -64 for each pair.
"""

from __future__ import annotations

import functools

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SOLID = ~_SPACE
_SHIFTS = np.array([30, 27, 31], np.uint64)
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_STEP = 0xC2B2AE3D27D4EB4F


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P), np.full(n, _P_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    out = h >> _SHIFTS[0]
    out ^= h
    out *= _MIX[0]
    out ^= out >> _SHIFTS[1]
    out *= _MIX[1]
    out ^= out >> _SHIFTS[2]
    return out


class WordHashes:
    """The words of a text; hashes as written and with A-Z lower-cased."""

    def __init__(self, text: str):
        self.data = np.frombuffer(text.encode(), np.uint8)
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = _SOLID[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def n_chars(self) -> int:
        """Code points in words."""
        return int(np.count_nonzero(((self.data & 0xC0) != 0x80) & ~_SPACE[self.data]))

    def _hashes(self, table: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.empty(0, np.uint64)
        n = len(self.data)
        size = 1 << max(10, (n - 1).bit_length())
        up, down = _powers(size)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[self.data] * up[:n], out=sums[1:])
        lengths = (self.ends - self.starts).astype(np.uint64)
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + lengths)

    @functools.cached_property
    def exact(self) -> np.ndarray:
        return self._hashes(_TABLE)

    @functools.cached_property
    def lower(self) -> np.ndarray:
        return self._hashes(_LOWER)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, in order; of all words where there are fewer."""
    if not len(words):
        return words
    n = min(n, len(words))
    last = len(words) - n + 1
    h = np.full(last, n, np.uint64)
    for k in range(n):
        h += words[k:k + last] * np.uint64(pow(_STEP, k + 1, 1 << 64))
    return mix(h)
