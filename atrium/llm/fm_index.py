"""An FM-index over integer sequences: suffix array, Burrows-Wheeler transform, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix order of ``s`` by prefix doubling."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        if step < n:
            second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, dtype=np.int64)
        ordered = key[order]
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if n == 0 or new.max() == n - 1:
            return order
        rank, step = new, step * 2


class Bits:
    """A bit vector with constant-time rank: counts at every 64th bit, the rest by popcount."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(bits.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Rank of any symbol in a prefix of a sequence, one bit level at a time from the highest bit."""

    def __init__(self, s: np.ndarray, bits: int):
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        self.bits = bits
        for k in range(bits - 1, -1, -1):
            level = (s >> k) & 1
            self.levels.append(Bits(level))
            self.zeros.append(len(s) - self.levels[-1].ones)
            s = np.concatenate([s[level == 0], s[level == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands among the first ``i`` values."""
        low = np.zeros_like(i)
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            r_low, r_i = level.rank1(low), level.rank1(i)
            low, i = np.where(one, zeros + r_low, low - r_low), np.where(one, zeros + r_i, i - r_i)
        return i - low

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at ``i`` and its rank there."""
        value, low = np.zeros_like(i), np.zeros_like(i)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one = level[i] == 1
            value = value * 2 + one
            r_low, r_i = level.rank1(low), level.rank1(i)
            low, i = np.where(one, zeros + r_low, low - r_low), np.where(one, zeros + r_i, i - r_i)
        return value, i - low


class FMIndex:
    """``s``: values of 1 and more; a 0 is added as its end."""

    def __init__(self, s: np.ndarray, every: int = 8):
        s = np.concatenate([np.asarray(s, dtype=np.int64), [0]])
        order = suffix_array(s)
        self.n = len(s)
        self.wavelet = WaveletMatrix(s[order - 1], max(1, int(s.max()).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s))]).astype(np.int64)  # where each symbol's suffixes begin
        sampled = order % every == 0
        self.marked, self.sample = Bits(sampled.astype(np.uint8)), order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases of one length, a phrase a row, by backward search of all at once.

        A phrase is given up where its range gets empty, so most cost only their last few symbols.
        """
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, k].astype(np.int64)
            known = symbol < len(self.first) - 1
            alive, symbol = alive[known], symbol[known]
            start = self.first[symbol]
            a = start + self.wavelet.rank(symbol, low[alive])
            b = start + self.wavelet.rank(symbol, high[alive])
            high[:] = low  # empty, but for those that go on
            some = b > a
            alive = alive[some]
            low[alive], high[alive] = a[some], b[some]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks, by steps back to the next sampled position."""
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        open_ = np.nonzero(self.marked[rows] == 0)[0]
        while len(open_):
            value, rank = self.wavelet.access(rows[open_])
            rows[open_], steps[open_] = self.first[value] + rank, steps[open_] + 1
            open_ = open_[self.marked[rows[open_]] == 0]
        return self.sample[self.marked.rank1(rows)] + steps
