"""Simple-8b words: 4 bits of selector, 60 bits of payload.

Selectors 1 to 15 pack as many values as the table says, each in 60 // values bits.
Selector 0 is the escape: its payload counts the raw 64-bit words that follow, for
values of more than 60 bits. A block is coded by itself, so blocks decode in any order.
"""

from __future__ import annotations

import numpy as np

# Values in a word, by selector.
PER_WORD = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
_SELECTORS = range(1, 15)


def _run(values: np.ndarray) -> np.ndarray:
    """Words of values below 2 ** 60."""
    n = len(values)
    if n == 0:
        return np.empty(0, np.uint64)
    step = np.ones(n, np.int64)
    selector = np.full(n, 14, np.uint8)
    largest = int(values.max())
    narrow = int(values.min())
    for s in reversed(_SELECTORS):
        bits, per = int(BITS[s]), int(PER_WORD[s])
        if narrow >> bits:
            break
        if largest >> bits:
            wide = np.concatenate(([0], np.cumsum(values >= np.uint64(1 << bits), dtype=np.int32)))
            ends = np.minimum(np.arange(n) + per, n)
            fits = wide[ends] == wide[:-1]
        else:
            fits = slice(None)
        step[fits], selector[fits] = per, s
    starts, at, steps = [], 0, step.tolist()
    while at < n:
        starts.append(at)
        at += steps[at]
    first = np.asarray(starts)
    chosen = selector[first]
    padded = np.concatenate((values, np.zeros(64, np.uint64)))
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        of = np.flatnonzero(chosen == s)
        per, bits = int(PER_WORD[s]), int(BITS[s])
        for j in range(per):
            words[of] |= padded[first[of] + j] << np.uint64(bits * j)
    # The last word may reach beyond the values; what lies there is zero.
    return words


def pack(values: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The words of a block of unsigned values, and the (word, value) places of escapes."""
    values = np.asarray(values, np.uint64)
    large = np.flatnonzero(values >> np.uint64(60))
    if not len(large):
        return _run(values), []
    parts, escapes, at, n_words = [], [], 0, 0
    for group in np.split(large, np.flatnonzero(np.diff(large) > 1) + 1):
        parts += [_run(values[at:group[0]]), np.array([len(group)], np.uint64), values[group]]
        escapes.append((n_words + len(parts[-3]), int(group[0])))
        n_words += sum(map(len, parts[-3:]))
        at = int(group[-1]) + 1
    return np.concatenate([*parts, _run(values[at:])]), escapes


def _unrun(words: np.ndarray) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = PER_WORD[selector]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(selector):
        of = np.flatnonzero(selector == s)
        per, bits = int(PER_WORD[s]), int(BITS[s])
        mask, first = np.uint64((1 << bits) - 1), ends[of] - per
        for j in range(per):
            out[first + j] = (words[of] >> np.uint64(bits * j)) & mask
    return out


def unpack(words: np.ndarray, n: int, escapes: list[tuple[int, int]] = ()) -> np.ndarray:
    """The n values of a block, given the places of its escapes."""
    if not len(escapes):
        return _unrun(words)[:n]
    out, at, done = [], 0, 0
    for word, value in escapes:
        out.append(_unrun(words[at:word])[:value - done])
        count = int(words[word])
        out.append(words[word + 1:word + 1 + count])
        at, done = word + 1 + count, value + count
    out.append(_unrun(words[at:])[:n - done])
    return np.concatenate(out)

