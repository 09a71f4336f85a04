"""Vectorised 64-bit hashes of words, word windows and byte windows.

A sequence x0, x1, ... is hashed as the sum of x[i] * B**i modulo 2**64 over a window, divided by B**start (odd numbers
have an inverse modulo 2**64), so one running sum serves the windows of every place and length. Bytes and words enter
through a mixing function, and the result leaves through one.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C55 | 5
INVERSE = pow(BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(256), 7)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]


def powers(base: int, count: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < count:
        size = max(count, 1 << 16)
        with np.errstate(over="ignore"):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            held = np.cumprod(factors, dtype=np.uint64)
        if size <= 1 << 23:
            _powers[base] = held
    return held[:count]


class Windows:
    """Hashes of windows over a flat sequence of 64-bit items."""

    def __init__(self, items: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(items) + 1, np.uint64)
            np.cumsum(items * powers(BASE, len(items)), out=self.sums[1:])
        self.inverse = powers(INVERSE, len(items) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts], salt)

    def every(self, length: int, salt: int = 0) -> np.ndarray:
        """Hash of the window at every start at which ``length`` items follow."""
        count = max(0, len(self.sums) - length)
        with np.errstate(over="ignore"):
            return mix((self.sums[length : length + count] - self.sums[:count]) * self.inverse[:count], salt)


def byte_windows(data: np.ndarray) -> Windows:
    return Windows(_BYTES[data])


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end, and the number of words before each text.

    Words are runs of bytes other than the six ASCII blanks; none crosses from one text to the next.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """One 64-bit hash per word; ``lower`` treats A-Z as a-z."""
    return Windows((_LOWER if lower else _BYTES)[data])(starts, ends, 1)
