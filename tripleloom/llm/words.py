"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy.

A word is a maximal run of ASCII letters, digits and bytes above 127; A-Z count as a-z. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _WORD[_lo : _hi + 1] = True
_LETTER = np.arange(256, dtype=np.uint64)
_LETTER[65:91] += np.uint64(32)
_LETTER = mix(_LETTER + np.uint64(77))
_BASE = int(constants(1, 5)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """base**i and base**-i for i up to n; kept, at the size of the largest slice met so far."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


class Words:
    """hashes, start and end bytes of all words of some texts; words of text i are bounds[i] up to bounds[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = _WORD[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[offsets] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        after[offsets] = False
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        up, down = powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTER[data] * up[: len(data)], out=sums[1:])
        self.hashes = mix((sums[self.end] - sums[self.start]) * down[self.start])

    def texts(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, and bounds by text. A text of 1 to k-1 words has one shingle, all its words."""
        return ngrams(self.hashes, self.bounds, k)


def ngrams(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    factors = constants(k, 11)
    n = np.diff(bounds)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    total = int(out_bounds[-1])
    # the place of each shingle's first word
    first = np.arange(total) + np.repeat(bounds[:-1] - out_bounds[:-1], counts)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    sums = np.zeros(total, np.uint64)
    short = np.repeat(np.where(n < k, n, k), counts)
    any_short = bool((short < k).any())
    for j in range(k):
        part = padded[first + j] * factors[j]
        sums += np.where(short > j, part, np.uint64(0)) if any_short else part
    return mix(sums), out_bounds


def least_per_row(values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """The least value of each row; `empty` where a row has none."""
    out = np.full(len(bounds) - 1, empty, values.dtype)
    has = np.flatnonzero(np.diff(bounds))
    if len(has):
        out[has] = np.minimum.reduceat(values, bounds[has])
    return out
