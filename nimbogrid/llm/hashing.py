"""Hashes of words and byte windows of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of two polynomial hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; kept, and grown when more are asked for."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = 1 << max(16, (n - 1).bit_length())
        held = np.full(size, base, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        _POWERS[base] = held
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Prefix:
    """Hashes of any slices of a sequence of bytes or 64-bit numbers: equal slices get equal hashes wherever they are."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        n = len(values)
        self.n, self.inverse = n, powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


#: Bytes of words: ASCII letters and digits, and all bytes of other characters.
WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words in a byte array: the longest runs of WORD bytes."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = WORD[raw]
    edge = np.flatnonzero(np.diff(inside))
    return edge[::2], edge[1::2]


def slabs(texts, most: int = 4 << 20):
    """(from, to) of consecutive texts of about ``most`` characters together; a longer text has a slab of its own."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
