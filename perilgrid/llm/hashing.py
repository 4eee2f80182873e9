"""Vectorised 64-bit hashes of words, windows of words and windows of bytes.

A window's hash is a polynomial of the hashes of its items, modulo 2**64, with an odd multiplier: prefix sums of
``item * B**i`` give every window by one subtraction and one multiplication with an inverse power.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

U64 = np.uint64
_MASK = (1 << 64) - 1
#: Odd multipliers of two independent polynomials.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits (a bijection)."""
    x = x ^ (x >> U64(31))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


class Powers:
    """The powers of a multiplier and of its inverse, as many as asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0
        self.up = self.down = np.empty(0, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1024)
            self.up, self.down = (self._table(b, self.n) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.ones(n, U64)
        k = 1
        while k < n:  # doubles the known part
            out[k : 2 * k] = out[: min(k, n - k)] * U64(pow(base, k, 1 << 64))
            k *= 2
        return out


_powers = [Powers(b) for b in BASES]


def prefix(items: np.ndarray, which: int = 0) -> np.ndarray:
    up, _ = _powers[which].get(len(items))
    out = np.zeros(len(items) + 1, U64)
    np.cumsum(items * up, out=out[1:])
    return out


def windows(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the items from start to end, of prefix sums; mixed."""
    _, down = _powers[which].get(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def rolling(sums: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of all windows of k items."""
    n = len(sums) - k
    if n <= 0:
        return np.empty(0, U64)
    _, down = _powers[which].get(n)
    return mix((sums[k:] - sums[:-k]) * down)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of a text's shingles, with repeats: A-Z lower-cased (all that bytes.lower() does), blank-separated words; a text
    of fewer words is one shingle, and one without words has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, "<u8")
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-1].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=False)]
    return np.array(hashes, "<u8")


class WordHashes(dict):
    """XXH64 of words; a store of those seen, bounded in number and, since long words aren't kept, in bytes (some 60 MB)."""

    most, longest = 500_000, 40

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h


def word_hashes(words: list[list[bytes]], store: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of some texts, in order, and the places where the texts start, and the end."""
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    return np.fromiter(map(store.__getitem__, chain.from_iterable(words)), U64, int(starts[-1])), starts


def sums_by(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the values between neighbouring starts (empty ones give 0)."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[starts[1:]] - sums[starts[:-1]]


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n items a window of k items from one of the starts covers."""
    edge = np.zeros(n + k + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return np.cumsum(edge[:n]) > 0
