"""Hashes of byte ranges by prefix sums: all ranges of a buffer in a few numpy operations.

The hash of bytes b0 b1 ... is the sum of value(b_i) * BASE^i, modulo 2^64, mixed.  With prefix sums of
value(b_i) * BASE^i over the buffer, a range's sum is a difference times a power of the inverse of BASE.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Entries that the tables of powers begin with; they grow with the longest buffer.
_LEAST = 1 << 19
_TABLES: dict = {}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte, and powers of the base and of its inverse, for buffers of n bytes."""
    if _TABLES.get("n", 0) < n:
        size = max(n, _LEAST + 4096)
        up, down = np.full(size, _BASE, U), np.full(size, pow(_BASE, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _TABLES.update(n=size, values=np.random.default_rng(7).integers(0, 2**64, 256, dtype=U), up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _TABLES["values"], _TABLES["up"], _TABLES["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def prefix_sums(buffer: np.ndarray) -> np.ndarray:
    values, up, _ = tables(len(buffer) + 1)
    out = np.zeros(len(buffer) + 1, U)
    np.cumsum(values[buffer] * up[: len(buffer)], out=out[1:])
    return out


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word, A-Z in lower case; words are runs of bytes other than white space."""
    if not raw:
        return np.empty(0, U)
    buffer = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[buffer], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    sums = prefix_sums(_LOWER[buffer])
    return mix((sums[ends] - sums[starts]) * tables(len(raw) + 1)[2][starts] + (ends - starts).astype(U))


def shingle_set(raw: bytes, size: int) -> np.ndarray:
    """Sorted hashes of the set of runs of `size` words (fewer words: all of them as one); no words: the one element 0."""
    words = word_hashes(raw)
    if not len(words):
        return np.zeros(1, U)
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, U)
    for k in range(size):
        total = (total + words[k : len(words) - size + 1 + k]) * U(_BASE)
        total ^= total >> U(29)
    return np.unique(mix(total))


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)
