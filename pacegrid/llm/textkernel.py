"""Numpy kernels over the bytes of many texts at once: words and their 64-bit hashes.

A word hash is the polynomial sum of the word's mapped bytes modulo 2**64, taken from one
prefix sum over the whole chunk and finished by a bijective mixer, so no Python object is
made per word.
"""

from __future__ import annotations

import functools

import numpy as np

#: Odd multiplier and the finaliser's constants (splitmix64); the values are fixed.
P = 0x9E3779B97F4A7C15
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Bytes that end a word: space, tab to carriage return.
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@functools.lru_cache(maxsize=2)
def _tables(bits: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(P, 1 << bits), _powers(pow(P, -1, 2**64), 1 << bits)


def spaced_words() -> np.ndarray:
    """Byte map for words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; 0 ends a word."""
    table = np.arange(1, 257, dtype=np.uint64)
    table[ord("A") : ord("Z") + 1] += 32
    table[list(SPACES)] = 0
    return table


def letter_words(digits: bool = True) -> np.ndarray:
    """Byte map for runs of ASCII letters (lower-cased), digits and bytes above 127."""
    table = np.zeros(256, np.uint64)
    table[128:] = np.arange(129, 257)
    for c in range(ord("a"), ord("z") + 1):
        table[c] = table[c - 32] = c + 1
    if digits:
        table[ord("0") : ord("9") + 1] = np.arange(ord("0") + 1, ord("9") + 2)
    return table


class Words:
    """Words of a chunk of texts: start, end (exclusive), document index and hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        n = len(data)
        self.mapped = table[data]
        inside = self.mapped != 0
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        after = np.ones(n, bool)
        if n:
            before[1:] = ~inside[:-1]
            after[:-1] = ~inside[1:]
        self.start = np.flatnonzero(inside & (before | edge[:-1]))
        self.end = np.flatnonzero(inside & (after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))
        self.up, self.down = _tables(max(12, int(n).bit_length()))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.mapped * self.up[:n], out=self.sums[1:])

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges [start, end)."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * M2)

    @functools.cached_property
    def hash(self) -> np.ndarray:
        return self.part(self.start, self.end)


def hash_bytes(word: bytes, table: np.ndarray) -> int:
    """The hash that ``Words`` gives a word of these bytes."""
    w = Words(np.frombuffer(word, np.uint8), np.array([0, len(word)]), table)
    return int(w.part(np.array([0]), np.array([len(word)]))[0])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its word shingles; with fewer words than
    ``size`` the one hash of the whole sequence; without words an empty set."""
    w = Words(data, offsets, spaced_words())
    h, n = w.hash, len(w.start)
    many = max(0, n - size + 1)
    grams = np.zeros(many, np.uint64)
    for j in range(size):
        grams = grams * np.uint64(P) + h[j : j + many]
    grams = mix(grams)
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            g = np.uint64(0)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    g = g * np.uint64(P) + x
                g += np.uint64(b - a) * M1
            out.append(mix(np.array([g], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def flat_shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all word shingles of the texts that have ``size`` words, repeats included."""
    w = Words(data, offsets, spaced_words())
    many = max(0, len(w.start) - size + 1)
    if not many:
        return np.zeros(0, np.uint64)
    grams = np.zeros(many, np.uint64)
    for j in range(size):
        grams = grams * np.uint64(P) + w.hash[j : j + many]
    return mix(grams[w.doc[:many] == w.doc[size - 1 :]])
