"""Texts as arrays of code points: words, sentences and hashes of a whole batch at once, in numpy."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


_POWERS = np.array([pow(BASE, n, 1 << 64) for n in range(256)], dtype=np.uint64)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): the code points of all texts, each followed by a 0, and where each text starts (one more at the end)."""
    codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return codes, np.concatenate([[0], np.cumsum(lengths)])


class CharClass:
    """A set of code points by a test on the character, kept as a table of those already seen."""

    def __init__(self, test) -> None:
        self.test, self.table, self.known = test, np.zeros(0x110000, dtype=bool), np.zeros(0x110000, dtype=bool)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        unknown = codes[~self.known[codes]]
        if len(unknown):
            for c in np.unique(unknown).tolist():
                self.table[c], self.known[c] = self.test(chr(c)), True
        return self.table[codes]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def words(codes: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each maximal run of word characters; equal runs have equal hashes."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    n = end - start
    total = int(n.sum())
    at = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    flat = codes[np.repeat(start, n) + at].astype(np.uint64) + np.uint64(1)
    long = at >= len(_POWERS)
    factor = _POWERS[np.where(long, 0, at)]
    for i in np.flatnonzero(long):
        factor[i] = power(int(at[i]))
    sums = np.add.reduceat(flat * factor, np.cumsum(n) - n)
    return mix(sums + n.astype(np.uint64) * power(257)), start, end


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` code points, by its start; there are ``len(codes) - size + 1``."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    runs, length, out, done = codes.astype(np.uint64) + np.uint64(1), 1, np.zeros(n, np.uint64), 0
    while True:
        if size & length:
            out += power(done) * runs[done : done + n]
            done += length
        if done == size:
            return mix(out)
        runs = runs[:-length] + power(length) * runs[length:]
        length *= 2


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values, by the first one's place."""
    n, length = len(values) - size + 1, 1
    if n <= 0:
        return values[:0]
    while 2 * length <= size:
        values = np.minimum(values[:-length], values[length:])
        length *= 2
    return np.minimum(values[:n], values[size - length : size - length + n])


def sliding_max(values: np.ndarray, size: int) -> np.ndarray:
    return ~sliding_min(~values, size)


def sliding_argmin(values: np.ndarray, size: int) -> np.ndarray:
    """Where the least of every ``size`` consecutive values is, the first of equal ones."""
    n, length = len(values) - size + 1, 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(len(values))
    while 2 * length <= size:
        left, right = at[:-length], at[length:]
        at = np.where(values[left] <= values[right], left, right)
        length *= 2
    left, right = at[:n], at[size - length : size - length + n]
    return np.where(values[left] <= values[right], left, right)
