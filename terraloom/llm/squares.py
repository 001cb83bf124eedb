"""Online search for squares, merged into periodic runs (a helper used inside tasks)."""

from __future__ import annotations

import numpy as np

from .textkit import mix64

_LEFT, _RIGHT = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
_NO_CHAINS = np.zeros((0, 3), np.int64)


class SquareCatchers:
    """Reads words as they come and keeps, for each power of two Q, catchers of squares with period Q to 2Q-1.

    The first half of such a square has a whole aligned block of L = max(1, Q/2) words. So each completed block is a catcher:
    as a word is appended, the L words that now end the text are compared with the blocks that lie Q to 2Q-1 words back, two a
    level, by names that are made of the names of their halves. Hits of consecutive blocks at one distance form a chain; a chain
    ends when a block's comparison fails. Its words are then compared one by one to both sides: `power` periods or more are
    a run. Hits inside a run that is known with a period dividing theirs are dropped: they are that run again. So n words take
    O(n log n) steps in all, whether appended one by one or at once.
    """

    def __init__(self, power: int = 2, longest_period: int | None = None):
        self.power, self.longest = power, longest_period
        self.words, self.n = np.zeros(64, np.uint64), 0
        #: By block size: the first place with a kept name, and the names from there on.
        self.names: dict[int, tuple[int, np.ndarray]] = {}
        #: By Q: open chains as rows of period, first block, last block.
        self.open: dict[int, np.ndarray] = {}
        self.known = _NO_CHAINS  # start, end, period of stretches of two periods or more
        self.found: dict[tuple[int, int], int] = {}

    def append(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """Reads on; returns runs (start, length, period) that these words ended."""
        n0, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            self.words = np.concatenate([self.words[:n0], np.zeros(max(self.n, n0), np.uint64)])
        self.words[n0 : self.n] = words
        ended, q = [], 1
        while (size := max(1, q // 2)) <= self.n and (self.longest is None or q <= self.longest):
            if q != 2:
                self._name(size)
            ended += self._advance(q, size, n0)
            q *= 2
        for size, (start, names) in self.names.items():
            spare = max(0, len(names) - 5 * size)
            self.names[size] = (start + spare, names[spare:].copy())
        return ended

    def finish(self) -> list[tuple[int, int, int]]:
        """All runs, those that the end of the text cuts off included: by start, then period."""
        for q, chains in self.open.items():
            self._settle(chains, max(1, q // 2), at_end=True)
        self.open = {}
        return sorted(((a, b - a, p) for (a, b), p in self.found.items()), key=lambda r: (r[0], r[2]))

    def _name(self, size: int) -> None:
        """Names of all blocks of `size` words that are complete now."""
        if size == 1:
            start, have = self.names.get(1, (0, self.words[:0]))
            self.names[1] = (start, np.concatenate([have, self.words[start + len(have) : self.n]]))
            return
        start, have = self.names.get(size, (0, self.words[:0]))
        half_start, half = self.names[size // 2]
        first = start + len(have)
        here = half[first - half_start :]
        new = max(0, len(here) - size // 2)
        with np.errstate(over="ignore"):
            made = mix64(here[:new] * _LEFT + mix64(here[size // 2 : size // 2 + new] + _RIGHT))
        self.names[size] = (start, np.concatenate([have, made]))

    def _advance(self, q: int, size: int, n0: int) -> list[tuple[int, int, int]]:
        start, names = self.names[size]
        ends = np.arange(max(n0 + 1, size + q, start + size), self.n + 1)
        hits = []
        for back in range(q // size):
            block = ((ends - size - q) // size - back) * size
            there = block >= start
            block, at = block[there], ends[there] - size
            hit = names[block - start] == names[at - start]
            hits.append(np.stack([(at - block)[hit], block[hit]], 1))
        hits = np.concatenate(hits)
        if len(hits):
            hits = hits[~self._covered(hits, size)]
        chains = np.concatenate([self.open.get(q, _NO_CHAINS), np.column_stack([hits, hits[:, 1]])])
        if len(chains):
            chains = chains[np.lexsort((chains[:, 1], chains[:, 0]))]
            new = np.ones(len(chains), bool)
            new[1:] = (chains[1:, 0] != chains[:-1, 0]) | (chains[1:, 1] != chains[:-1, 2] + size)
            begin = np.flatnonzero(new)
            chains = np.column_stack([chains[begin, 0], chains[begin, 1], chains[np.append(begin[1:], len(chains)) - 1, 2]])
            squares = chains[chains[:, 2] + size - chains[:, 1] >= chains[:, 0]]
            known = np.column_stack([squares[:, 1], squares[:, 2] + size + squares[:, 0], squares[:, 0]])
            self.known = np.concatenate([self.known, known])
            self.known = self.known[np.lexsort((self.known[:, 1], self.known[:, 0]))]
        closed = chains[:, 2] + 2 * size + chains[:, 0] <= self.n
        self.open[q] = chains[~closed]
        return self._settle(chains[closed], size)

    def _covered(self, hits: np.ndarray, size: int) -> np.ndarray:
        """Hits that lie in a known stretch whose period divides theirs."""
        if not len(self.known):
            return np.zeros(len(hits), bool)
        ends = self.known[:, 1]
        furthest = np.maximum.accumulate(np.where(ends >= np.maximum.accumulate(ends), np.arange(len(ends)), 0))
        at = np.searchsorted(self.known[:, 0], hits[:, 1], "right") - 1
        of = furthest[np.maximum(at, 0)]
        inside = (at >= 0) & (ends[of] >= hits.sum(1) + size)
        return inside & (self.known[of, 2] < hits[:, 0]) & (hits[:, 0] % self.known[of, 2] == 0)

    def _settle(self, chains: np.ndarray, size: int, at_end: bool = False) -> list[tuple[int, int, int]]:
        long_enough = chains[:, 2] - chains[:, 1] + 3 * size - 2 >= (self.power - 1) * chains[:, 0]
        ended = []
        for period, first, last in chains[long_enough].tolist():
            a, b = self._stretch(first, last + size, period)
            if b + period == self.n and not at_end:
                continue  # its further hits were dropped: a run of a smaller period goes on
            if b + period - a >= self.power * period and self.found.get((a, b + period), period + 1) > period:
                self.found[a, b + period] = period
                ended.append((a, b + period - a, period))
        return ended

    def _stretch(self, a: int, b: int, period: int) -> tuple[int, int]:
        """The widest stretch around a to b whose words equal those `period` on; it is empty if names were equal by chance."""
        words, top = self.words, self.n - period
        if not (words[a:b] == words[a + period : b + period]).all():
            return a, a
        step = max(1, b - a)
        while a > 0:
            lo = max(0, a - step)
            differ = np.flatnonzero(words[lo:a] != words[lo + period : a + period])
            if len(differ):
                a = lo + int(differ[-1]) + 1
                break
            a = lo
        while b < top:
            hi = min(top, b + step)
            differ = np.flatnonzero(words[b:hi] != words[b + period : hi + period])
            if len(differ):
                b += int(differ[0])
                break
            b = hi
        return a, b
