"""Hashes of word shingles, computed for whole texts at once with NumPy."""

from __future__ import annotations

import numpy as np

UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_draw = np.random.default_rng(20240229)
#: Random values per byte, an odd base for words and one for shingles.
BYTE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE, STEP = (np.uint64(int(x) | 1) for x in _draw.integers(1 << 60, 1 << 63, 2, dtype=np.uint64))
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to 0 .. n - 1, kept and doubled as longer texts come."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * BASE)])
    return _powers[:n]


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word of ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased."""
    raw = np.frombuffer(text.translate(UPPER), np.uint8)
    word = ~BLANK[raw]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    # Digits run from a word's end backwards, so that equal words have equal sums anywhere.
    values = np.where(word, BYTE[raw], np.uint64(0))
    longest = int((ends - starts).max())
    place = np.repeat(ends, ends - starts) - 1 - np.flatnonzero(word)
    total = np.cumsum(values[word] * powers(longest)[place])
    lengths = ends - starts
    last = np.cumsum(lengths) - 1
    sums = total[last].copy()
    sums[1:] -= total[last[:-1]]
    return mix(sums)


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``width`` consecutive words; all words as one where there are fewer."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    size = min(width, n)
    rolled = np.full(n - size + 1, np.uint64(size))
    for k in range(size):
        rolled = rolled * STEP + words[k : n - size + 1 + k]
    return np.unique(mix(rolled))
