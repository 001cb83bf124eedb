"""Vectorised word and n-gram hashing over Arrow text columns (helpers used inside tasks)."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))

#: Bytes of a word: letters, digits and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True
#: Bytes of a word: all but space and the controls 0x09 to 0x0D.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False

_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base (up) or of its inverse (down) modulo 2**64."""
    have = _POWERS[kind]
    if len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        step = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[kind] = np.multiply.accumulate(step)
    return have[:n]


def release() -> None:
    """Gives the memory that this Python worker has freed back to the system; the worker goes on to other tasks."""
    _POWERS.update({kind: p[:1].copy() for kind, p in _POWERS.items()})
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim:
        trim(0)


def batchwise(run: Callable) -> Callable:
    """A function over a task's batches that releases memory at the end."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def groupwise(run: Callable) -> Callable:
    """A function over a group that releases memory after it."""

    def wrapped(frame):
        out = run(frame)
        release()
        return out

    return wrapped


def pieces(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of equal keys."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return begin, np.append(begin[1:], len(keys))[: len(begin)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n+1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Zero-copy pieces of a batch whose texts have about `most` bytes; a longer text is a piece alone."""
    _, offsets = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a slice of texts: 64-bit hash, byte range and document of each, in order."""

    def __init__(self, column: pa.Array, is_word: np.ndarray = ALNUM, fold: bool = True):
        self.data, self.offsets = text_buffer(column)
        n = len(self.data)
        inside = is_word[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = self.offsets[:-1][self.offsets[:-1] < n]
        begins[edge] = inside[edge]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = self.offsets[1:][self.offsets[1:] > 0] - 1
        ends[last] = inside[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((_FOLDED if fold else _BYTE)[self.data] * _powers("up", n), out=total[1:])
            raw = (total[self.end] - total[self.start]) * _powers("down", n + 1)[self.start]
            self.hash = mix64(raw + (self.end - self.start).astype(np.uint64))
        #: First word of each document, and one past the last word of the last.
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)

    def docs(self) -> np.ndarray:
        """Document number of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def word(self, i: int) -> str:
        """The i-th word, A-Z lower-cased."""
        return bytes(self.data[self.start[i] : self.end[i]]).decode().translate(LOWER)


LOWER = {c: c + 32 for c in range(65, 91)}
_TURNS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each document, in order, and how many each document has.

    A document with fewer words but at least one has one shingle, its whole sequence.
    """
    counts, h = words.counts, words.hash
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    out_doc = np.repeat(np.arange(len(n)), n)
    if not len(out_doc):
        return np.zeros(0, np.uint64), n
    nth = np.arange(len(out_doc)) - np.repeat(np.cumsum(n) - n, n)
    at = words.first[:-1][out_doc] + nth
    length = np.minimum(counts[out_doc], k)
    value = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            there = length > j
            value[there] += mix64(h[at[there] + j] + _TURNS[j]) * _TURNS[j]
        return mix64(value + length.astype(np.uint64)), n
