"""Hashed word shingles of texts, by arrays."""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes; they depend on a span's bytes alone."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's runs of ``words`` lower-cased words.

    Words are parted by white space. A text of fewer words has one shingle, all its words; a null or blank text
    has none.
    """
    parts = text.lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(" ".join(parts).encode(), np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    k = min(words, len(starts))
    starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
    return np.unique(span_hashes(data, starts, ends))


class MinHash:
    """Signatures of hashed sets: the minimum of each of ``size`` multiply-add permutations of 32 bits."""

    def __init__(self, size: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 32, size, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)[:, None]

    def of(self, hashes: np.ndarray, block: int = 2048) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), block):
            y = self.a * x[None, at : at + block]
            y += self.b
            np.minimum(low, y.min(axis=1), out=low)
        return low
