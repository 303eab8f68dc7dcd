"""Hashes of words and word sequences in numpy, alike on every machine."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64; its constants are fixed)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


INSIDE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)], np.int8)
#: The low bytes of a number of 8, by how many.
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
STEP = U(0x9E3779B97F4A7C15)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word (bytes between ASCII white space), in order, without a Python step for most words.

    It depends on the word's own bytes alone: up to 8 are mixed at once, so words as short differ in their hashes if
    they differ; 9 to 16 in two steps; longer words have XXH3's.
    """
    size = len(data)
    inside = np.zeros(size + 2, np.int8)
    inside[1:-1] = INSIDE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, n = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((size + 9,), "<u8", data + bytes(17), strides=(1,))  # the 8 bytes from each place on
    out = mix((eight[start] & LOW[np.minimum(n, 8)]) + n.astype(U) * STEP)
    more = np.flatnonzero(n > 8)
    if len(more):
        out[more] = mix(out[more] ^ mix((eight[start[more] + 8] & LOW[np.minimum(n[more] - 8, 8)]) + STEP))
        for i in more[n[more] > 16]:
            out[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + n[i]])
    return out


class Rolling:
    """Polynomial hashes modulo 2**64 of all n-word windows of a sequence of word hashes."""

    def __init__(self, base: int):
        self.base, self.power, self.inverse = base, np.ones(1, U), np.ones(1, U)

    def windows(self, h: np.ndarray, n: int) -> np.ndarray:
        if len(h) < n:
            return np.zeros(0, U)
        if len(self.power) < len(h):
            size = 2 * len(h)
            self.power = np.cumprod(np.r_[U(1), np.full(size, self.base, U)])
            self.inverse = np.cumprod(np.r_[U(1), np.full(size, pow(self.base, -1, 1 << 64), U)])
        sums = np.r_[U(0), np.cumsum(h * self.power[: len(h)])]
        return mix((sums[n:] - sums[:-n]) * self.inverse[: len(h) - n + 1])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n consecutive numbers, by doubling."""
    if len(x) < n:
        return x[:0]
    m, have = x, 1
    while 2 * have <= n:
        m, have = np.minimum(m[:-have], m[have:]), 2 * have
    return m if have == n else np.minimum(m[: len(x) - n + 1], m[n - have :][: len(x) - n + 1])
