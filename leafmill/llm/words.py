"""Hashes of a text's words, made from its bytes at once instead of word by word."""

from __future__ import annotations

import numpy as np

from .common import mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def letters(separators: str) -> np.ndarray:
    """Table of bytes: 0 for those of ``separators`` (ASCII), else the byte plus one, A-Z as a-z."""
    t = np.arange(1, 257, dtype=np.uint64)
    t[65:91] += np.uint64(32)
    t[[ord(c) for c in separators]] = 0
    return t


#: Words of anything but white space, and words of digits, letters and characters beyond ASCII.
SPACED = letters("\t\n\x0b\x0c\r ")
LETTERS = letters("".join(chr(i) for i in range(128) if not chr(i).isalnum()))


class _Powers:
    """Powers of the base and of its inverse, as many as the longest text had bytes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            both = []
            for b in (_BASE, _INVERSE):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                both.append(np.multiply.accumulate(x))
            self.up, self.down = both
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(text: str | None, table: np.ndarray = SPACED) -> np.ndarray:
    """64-bit hash of each word, in order: a polynomial of its bytes, found as a difference of sums over
    the text. Equal words have equal hashes wherever they stand."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros(0, np.uint64)
    a = table[np.frombuffer(data, np.uint8)]
    inside = a != 0
    start = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    if not len(start):
        return np.zeros(0, np.uint64)
    end = np.flatnonzero(inside & np.r_[~inside[1:], True])
    up, down = _POWERS.upto(len(a))
    a *= up
    total = np.cumsum(a, dtype=np.uint64)
    h = total[end] - total[start] + a[start]
    return mix64(h * down[start], 7)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of ``k`` words (none if there are fewer)."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_BASE) + words[j : j + n]
    return mix64(h)
