"""Content-chosen anchors: every window of a text picks one short string in it, equal windows the same one."""

from __future__ import annotations

import numpy as np

from .textkit import _BYTE, _powers, mix64

_PLACE = 27  # bits for a place in a slice


class Runs:
    """Runs of neighbouring windows of `size` bytes that pick the same anchor of `gram` bytes.

    A window picks the anchor whose hash is least (of equal ones the rightmost). A run is windows lo..hi of one
    text (starts, in bytes of the slice), their anchor's place and hash.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int, gram: int):
        self.data, self.offsets, n = data, offsets, len(data)
        self.total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data] * _powers("up", n), out=self.total[1:])
        empty = np.zeros(0, np.int64)
        self.lo, self.hi, self.at, self.hash = empty, empty, empty, np.zeros(0, np.uint64)
        length = np.diff(offsets)
        if n < size or not (length >= size).any():
            return
        width = size - gram + 1
        grams = self.span_hash(np.arange(n - gram + 1), np.full(n - gram + 1, gram))
        key = (grams >> np.uint64(_PLACE)) << np.uint64(_PLACE) | (np.uint64((1 << _PLACE) - 1) - np.arange(len(grams), dtype=np.uint64))
        pad = -len(key) % width
        blocks = np.append(key, np.full(pad, np.iinfo(np.uint64).max)).reshape(-1, width)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = np.arange(n - size + 1)
        least = np.minimum(right[starts], left[starts + width - 1])
        place = (np.uint64((1 << _PLACE) - 1) - (least & np.uint64((1 << _PLACE) - 1))).astype(np.int64)
        good = np.zeros(n + 1, np.int64)
        on = length >= size
        np.add.at(good, offsets[:-1][on], 1)
        np.add.at(good, offsets[1:][on] - size + 1, -1)
        good = np.cumsum(good)[: len(starts)] > 0
        doc_start = np.zeros(n + 1, bool)
        doc_start[offsets[:-1]] = True
        first = good.copy()
        first[1:] &= ~good[:-1] | (place[1:] != place[:-1]) | doc_start[1 : len(starts)]
        last = good.copy()
        last[:-1] &= ~good[1:] | first[1:]
        self.lo, self.hi = np.flatnonzero(first), np.flatnonzero(last)
        self.at = place[self.lo]
        self.hash = grams[self.at]

    def span_hash(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hash of the bytes begin..begin+length."""
        with np.errstate(over="ignore"):
            return mix64((self.total[begin + length] - self.total[begin]) * _powers("down", len(self.total))[begin] + length.astype(np.uint64))
