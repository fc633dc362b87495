"""Vectorised 64-bit polynomial hashes of all substrings of a byte string."""

from __future__ import annotations

import numpy as np

from .common import mixed

BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.random.default_rng(20240301).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below n at least."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 16, 2 * len(_powers[0])) if n < 1 << 24 else n
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


class Rolling:
    """Hashes of any substrings of one byte string by differences of one running sum."""

    def __init__(self, text: bytes | np.ndarray):
        a = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
        up, self.down = powers(len(a) + 1)
        self.sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_TABLE[a] * up[: len(a)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """The sorted set of hashed n-word shingles of a text, A-Z lowered; with fewer words the whole sequence is one; none without words."""
    if not text:
        return np.zeros(0, np.uint64)
    a = np.frombuffer(text.lower(), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[a], [True]]).astype(np.int8)))
    words = Rolling(a).of(edge[::2], edge[1::2])
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _STEP[k]
    return np.unique(mixed(total))
