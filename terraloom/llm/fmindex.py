"""An FM-index over integer sequences: suffix order, wavelet-tree ranks and sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array of an integer sequence by prefix doubling; a proper prefix sorts before what it begins."""
    n = len(seq)
    _, rank = np.unique(seq, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] if width < n else rank[:0]
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[1], (np.diff(key[order]) != 0).astype(np.int64)]))
        rank = fresh
        if n == 0 or rank[order[-1]] == n or width >= n:
            return order
        width *= 2


class Wavelet:
    """Rank of symbols in prefixes of a sequence: one bit level per bit of the alphabet, high bits first."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            count = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(seq) - int(count[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its end."""
        begin, end = np.zeros_like(end), end.copy()
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            b1, e1 = self.ones[i][begin], self.ones[i][end]
            begin = np.where(one, self.zeros[i] + b1, begin - b1)
            end = np.where(one, self.zeros[i] + e1, end - e1)
        return end - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        """Symbols at places."""
        out, at = np.zeros(len(at), np.int64), at.copy()
        for i in range(self.levels):
            before = self.ones[i][at]
            one = self.ones[i][at + 1] > before
            out = out * 2 + one
            at = np.where(one, self.zeros[i] + before, at - before)
        return out


class FMIndex:
    """Finds all places of many patterns in a sequence of symbols 1..symbols-1 (0 ends the sequence)."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 8):
        seq = np.append(seq.astype(np.int64), 0)
        order = suffix_order(seq)
        self.n, self.symbols = len(seq), symbols
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])  # of smaller symbols
        self.last = Wavelet(seq[order - 1], symbols)
        self.sampled = np.where(order % sample == 0, order, -1)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each pattern (rows of `patterns`, padded at the end)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(patterns.shape[1] if len(patterns) else 0):
            on = np.flatnonzero((lengths > step) & (low < high))
            if not len(on):
                break
            symbol = patterns[on, lengths[on] - 1 - step]
            ranks = self.last.rank(np.concatenate([symbol, symbol]), np.concatenate([low[on], high[on]]))
            low[on], high[on] = self.before[symbol] + ranks[: len(on)], self.before[symbol] + ranks[len(on) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffix rows: walk back to a sampled suffix, counting steps."""
        rows, out, left = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        step = 0
        while len(left):
            known = self.sampled[rows[left]] >= 0
            out[left[known]] = self.sampled[rows[left[known]]] + step
            left = left[~known]
            symbol = self.last.access(rows[left])
            rows[left] = self.before[symbol] + self.last.rank(symbol, rows[left])
            step += 1
        return out
