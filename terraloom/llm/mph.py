"""Minimal perfect hash over 64-bit key hashes: a cascade of bit arrays with rank counts, built with numpy."""

from __future__ import annotations

import numpy as np

from .textkit import mix64

_GAMMA = 2


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(keys + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Maps each of n distinct keys to its own slot in 0..n-1; any other key to some slot or to -1.

    A level has two bits a key. Keys alone at their bit stay there; the rest go to the next level. A slot is
    the number of set bits before the key's bit, found from counts kept per word of 64 bits.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes  # uint64 words of all levels, bits per level (multiples of 64)
        self.begin = np.concatenate([[0], np.cumsum(sizes // 64)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys repeat")
        levels, sizes = [], []
        while len(keys):
            size = -(-max(64, _GAMMA * len(keys)) // 64) * 64
            at = _place(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(np.concatenate(levels) if levels else np.zeros(0, np.uint64), np.array(sizes, np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = _place(keys[left], level, int(size))
            word, bit = self.begin[level] + at // 64, (at % 64).astype(np.uint64)
            here = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            out[left[here]] = self.before[word[here]] + np.bitwise_count(below)
            left = left[~here]
        return out
