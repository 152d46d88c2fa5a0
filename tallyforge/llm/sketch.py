"""Shingle sets and their SetSketch registers.

A set's register i is floor(1 - log_b x_i), where x_i is the least of exponentially distributed values
that hash i gives the set's elements: a truncated minimum on an exponential scale. Registers of a union
are the element-wise maxima, and two sets agree in a register with a probability close to their Jaccard
similarity, so runs of registers serve as bands.
"""

from __future__ import annotations

import numpy as np

from tallyforge.llm.common import hashed_words, mix64

#: Base and rate of the scale; registers are 16-bit.
BASE, RATE = 1.001, 20.0
TOP = 65_535

_STEPS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows, in order; k is 16 at most."""
    n = len(h) - k + 1
    x = h[:n] * _STEPS[0]
    for j in range(1, k):
        x += h[j : n + j] * _STEPS[j]
    return mix64(x + np.uint64(k))


def shingles_of(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles, A-Z lower-cased; fewer words are one shingle, none is empty."""
    h = hashed_words(text.encode("utf-8", "surrogatepass").lower())[2] if text else ()
    return np.unique(windows(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64)


class SetSketch:
    def __init__(self, rows: int, bands: int, seed: int = 2024):
        self.rows, self.bands, self.m = rows, bands, rows * bands
        rng = np.random.Generator(np.random.PCG64(seed))
        # 32-bit arithmetic: processors multiply eight such numbers at once
        self.a = rng.integers(0, 1 << 31, self.m, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, self.m, dtype=np.uint32)
        self.mixers = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def registers(self, elements: np.ndarray) -> np.ndarray:
        low = np.full(self.m, np.iinfo(np.uint32).max, np.uint32)
        folded = (elements >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(folded), 1024):  # blocks that stay in the processor's cache
            values = self.a[:, None] * folded[None, at : at + 1024]
            values += self.b[:, None]
            np.minimum(low, values.min(axis=1), out=low)
        x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
        return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, TOP).astype(np.uint16)

    def keys(self, registers: np.ndarray) -> np.ndarray:
        """(sets, m) registers -> (sets, bands) signed 64-bit keys of the bands."""
        parts = registers.reshape(len(registers), self.bands, self.rows).astype(np.uint64)
        key = np.tile(np.arange(1, self.bands + 1, dtype=np.uint64), (len(registers), 1))
        for j in range(self.rows):
            key = mix64(key * self.mixers[j] + parts[:, :, j])
        return key.view(np.int64)

    def similarity(self, n_a: np.ndarray, n_b: np.ndarray, greater: np.ndarray, less: np.ndarray, steps: int = 25) -> np.ndarray:
        """Jaccard similarities of largest joint likelihood, from set sizes and the counts of greater and lesser registers."""
        n_a, n_b = n_a.astype(float), n_b.astype(float)
        u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
        most = np.minimum(u / v, v / u)
        equal = self.m - greater - less
        part = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

        def likelihood(j: np.ndarray) -> np.ndarray:
            up, down = part(u - v * j), part(v - u * j)
            return greater * np.log(up) + less * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))

        low, high = np.zeros(len(u)), most
        for _ in range(steps):  # the likelihood has one peak
            one, two = low + 0.382 * (high - low), low + 0.618 * (high - low)
            left = likelihood(one) > likelihood(two)
            low, high = np.where(left, low, one), np.where(left, two, high)
        return (low + high) / 2

    def compare(self, n_a, r_a, n_b, r_b) -> np.ndarray:
        return self.similarity(n_a, n_b, (r_a > r_b).sum(1), (r_a < r_b).sum(1))


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(one, other)
