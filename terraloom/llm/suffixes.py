"""Suffix arrays by two-stage sorting, and common prefixes of neighbours."""

from __future__ import annotations

import numpy as np


def two_stage_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a byte string in the order of their first `depth` bytes (ties in any order).

    A suffix is of type B if it is smaller than its successor. Those are sorted directly. The rest is induced:
    buckets are scanned by first byte, and each suffix found puts the one before it, if that is no B, at the end
    of what its own bucket has so far. The string's end counts as smaller than every byte.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(data[1:] != data[:-1])
    run = np.searchsorted(change, np.arange(n))  # the next place whose successor differs
    after = np.where(run < len(change), change[np.minimum(run, max(0, len(change) - 1))] + 1 if len(change) else n, n)
    smaller = np.zeros(n, bool)
    inside = after < n
    smaller[inside] = data[after[inside]] > data[inside]
    direct = np.flatnonzero(smaller)
    padded = np.append(data, np.zeros(depth, np.uint8))
    heads = np.lib.stride_tricks.sliding_window_view(padded, depth)
    direct = direct[np.argsort(np.ascontiguousarray(heads[direct]).view(f"S{depth}").ravel(), kind="stable")]
    edge = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[-1]].append(np.array([n - 1]))  # it follows the empty suffix, the least of all
    out = []
    for byte in range(256):
        induced = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        wave = induced
        while len(wave):  # runs of one byte: each induces the suffix before it in the same bucket
            wave = wave[wave > 0] - 1
            wave = wave[(data[wave] == byte) & ~smaller[wave]]
            if len(wave):
                induced = np.concatenate([induced, wave])
        bucket = np.concatenate([induced, direct[edge[byte] : edge[byte + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[data[before] > byte]
        if len(before):
            first = data[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cut = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for a, b in zip(cut, np.append(cut[1:], len(first)), strict=True):
                waiting[first[a]].append(before[a:b])
    return np.concatenate(out)


def neighbour_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix lengths, up to `depth`, of each suffix in the order and the next (full suffixes of `depth` bytes)."""
    heads = np.lib.stride_tricks.sliding_window_view(data, depth)
    out = np.zeros(max(0, len(order) - 1), np.int64)
    for lo in range(0, len(out), 8192):
        a, b = order[lo : lo + 8193][:-1], order[lo + 1 : lo + 8193]
        differ = heads[a[: len(b)]] != heads[b]
        out[lo : lo + len(b)] = np.where(differ.any(1), differ.argmax(1), depth)
    return out
