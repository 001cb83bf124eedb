"""K-d trees over letter counts, searched by many boxes at once (helpers used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def letters(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row a word."""
    return np.array(words, dtype=f"U{length}").view(np.uint32).reshape(len(words), length)


def letter_counts(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """How often each letter of the sorted alphabet stands in each row; other letters aren't counted."""
    n, length = codes.shape
    at = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
    at = np.where(alphabet[at] == codes, at, len(alphabet)) + np.arange(n)[:, None] * (len(alphabet) + 1)
    counts = np.bincount(at.ravel(), minlength=n * (len(alphabet) + 1)).reshape(n, len(alphabet) + 1)[:, :-1]
    return counts.astype(np.int16 if length < 2**15 else np.int32)


class KdTree:
    """Halves vectors by one coordinate at a time until `leaf` of them or equal ones are left.

    `members` has the numbers of a leaf's vectors. With `tight` boxes a node's box is that of its vectors; without, it is
    the part of space that its cuts leave, so that vectors the tree has not seen have one leaf, too.
    """

    def __init__(self, vectors: np.ndarray, leaf: int, tight: bool = True):
        self.dims = vectors.shape[1]
        top = np.iinfo(vectors.dtype).max
        self.members: list[np.ndarray] = []
        self.cut_dim, self.cut_at, self.low, self.high, self.left, self.right = ([] for _ in range(6))
        open_ = [(np.arange(len(vectors)), np.zeros(self.dims, vectors.dtype), np.full(self.dims, top, vectors.dtype), -1, False)]
        while open_:
            rows, low, high, parent, is_right = open_.pop()
            part = vectors[rows]
            if tight and len(rows):
                low, high = part.min(0), part.max(0)
            node = len(self.left)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            for column, value in ((self.cut_dim, -1), (self.cut_at, 0), (self.low, low), (self.high, high), (self.left, -1), (self.right, -1), (self.members, rows)):
                column.append(value)
            cut = self._cut(part) if len(rows) > leaf else None
            if cut is None:
                continue
            dim, at = cut
            below = part[:, dim] <= at
            left_high, right_low = high.copy(), low.copy()
            left_high[dim], right_low[dim] = at, at + 1
            self.cut_dim[node], self.cut_at[node], self.members[node] = dim, at, rows[:0]
            open_ += [(rows[below], low, left_high, node, False), (rows[~below], right_low, high, node, True)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.cut_dim, self.cut_at, self.left, self.right = (np.array(c) for c in (self.cut_dim, self.cut_at, self.left, self.right))

    @staticmethod
    def _cut(part: np.ndarray) -> tuple[int, int] | None:
        """The coordinate and value that halve the vectors best; None if all are equal."""
        middle = np.median(part, axis=0).astype(np.int64)
        best = None
        for shift in (0, -1):
            share = (part <= middle + shift).mean(0)
            share = np.where(share < 1, share, 0)
            dim = int(np.argmax(np.minimum(share, 1 - share)))
            worth = min(share[dim], 1 - share[dim])
            if worth > 0 and (best is None or worth > best[0]):
                best = (worth, dim, int(middle[dim]) + shift)
        return best[1:] if best else None

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point falls into."""
        node = np.zeros(len(points), np.int64)
        while len(inner := np.flatnonzero(self.left[node] >= 0)):
            at = node[inner]
            below = points[inner, self.cut_dim[at]] <= self.cut_at[at]
            node[inner] = np.where(below, self.left[at], self.right[at])
        return node

    def reach(self, points: np.ndarray, more: int, fewer: int, step: int = 2000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(point, leaf) pairs of leaves whose box has a vector with at most `more` letters that the point lacks and `fewer` missing."""
        for begin in range(0, len(points), step):
            own = points[begin : begin + step]
            point, node = np.arange(len(own)), np.zeros(len(own), np.int64)
            while len(point):
                inside = (np.maximum(self.low[node] - own[point], 0).sum(1) <= more) & (np.maximum(own[point] - self.high[node], 0).sum(1) <= fewer)
                point, node = point[inside], node[inside]
                leaf = self.left[node] < 0
                yield point[leaf] + begin, node[leaf]
                point, node = np.repeat(point[~leaf], 2), node[~leaf]
                node = np.stack([self.left[node], self.right[node]], 1).ravel()
