"""The most alike of many names by Ratcliff-Obershelp's ratio, found exactly: few of them are compared."""

from __future__ import annotations

import difflib

import numpy as np

#: Code points of a name that the tree knows and a query's word of bits holds; what comes after counts as in common.
HEAD = 64
#: Nodes that a walk holds at once, and names that it finds; more, and its queries are dealt to two walks.
FRONT = 200_000
#: Ratios within half of it may be equal in six decimals.
SLACK = 2e-6


class NameTree:
    """Different names as a tree over their code points, an array for each depth. Below a node of one name, the name's row goes on.

    The blocks that the ratio counts are a common subsequence, so a ratio is at most twice the longest one over both lengths. A
    walk keeps the longest common subsequence of each query with the node's prefix (a word of bits, by Hyyrö) and leaves a
    node once what could still follow doesn't reach the ratio asked for.
    """

    def __init__(self, names: list[str]):
        self.names = names = sorted(names)
        self.sizes = np.array([len(y) for y in names], np.int64)
        kept = np.minimum(self.sizes, HEAD)
        self.depth = int(kept.max(initial=0))
        flat = np.frombuffer("".join(y[:HEAD] for y in names).encode("utf-32-le"), np.uint32)
        code = np.zeros(0x110000, np.int32)
        code[flat] = 1
        self.alphabet = np.flatnonzero(code)
        code[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        code = code.astype(np.min_scalar_type(len(self.alphabet)))
        self.codes = np.zeros((len(names), self.depth + 1), code.dtype)  # 0: the name, or its head, has ended
        self.codes[np.arange(self.depth + 1) < kept[:, None]] = code[flat]
        apart = self.codes[1:] != self.codes[:-1]
        first = np.append(-1, np.where(apart.any(1), apart.argmax(1), self.depth + 1)) if names else np.empty(0, int)
        self.levels, parents, inside = [], np.zeros(1, np.int64), np.ones(len(names), bool)
        for d in range(self.depth + 1):
            rows = np.flatnonzero(first <= d)
            if not inside.any():
                break
            held = np.diff(np.append(rows, len(names)))
            many = (held > 1) & (self.codes[rows, d] > 0) & inside[rows]
            low, high = np.minimum.reduceat(self.sizes, rows), np.maximum.reduceat(self.sizes, rows)
            own = inside[rows]
            rows, held, low, high, open_ = rows[own], held[own], low[own], high[own], many[own]
            start = np.searchsorted(rows, parents)
            self.levels.append((start, np.diff(np.append(start, len(rows))), rows, held, low, high, np.where(open_, np.cumsum(open_) - 1, -1)))
            parents, ends = rows[open_], np.zeros(len(names) + 1, np.int64)
            ends[parents] += 1
            ends[parents + held[open_]] -= 1
            inside = np.cumsum(ends[:-1]) > 0

    def masks(self, queries: list[str]) -> np.ndarray:
        """For each query and code, the places of the query that have it."""
        place = {c: i + 1 for i, c in enumerate(self.alphabet.tolist())}
        out = np.zeros((len(queries), len(place) + 1), np.uint64)
        for q, x in enumerate(queries):
            for i, c in enumerate(x[:HEAD]):
                if ord(c) in place:
                    out[q, place[ord(c)]] |= np.uint64(1 << i)
        return out

    def reach(self, masks: np.ndarray, sizes: np.ndarray, floors: np.ndarray) -> list[tuple[np.ndarray, ...]] | None:
        """(query, row, bound) of all names whose bound is at least their query's floor; None if several queries need too many nodes."""
        if not self.names:
            return []
        found, none = [], np.empty(0, np.int64)
        above, node, so_far = np.arange(len(sizes)), np.zeros(len(sizes), np.int64), np.full(len(sizes), ~np.uint64(0))
        q, row, bits = none, none, np.empty(0, np.uint64)  # of nodes that hold one name
        for d in range(self.depth + 1):
            held, low, high, below = np.ones(len(row), np.int64), self.sizes[row], self.sizes[row], np.full(len(row), -1)
            if len(node):
                start, count, rows, helds, lows, highs, nodes = self.levels[d]
                n = count[node]
                if len(sizes) > 1 and n.sum() + len(row) > FRONT:
                    return None
                child = np.repeat(start[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
                q, row, bits = np.append(np.repeat(above, n), q), np.append(rows[child], row), np.append(np.repeat(so_far, n), bits)
                held, low, high, below = np.append(helds[child], held), np.append(lows[child], low), np.append(highs[child], high), np.append(nodes[child], below)
            code = self.codes[row, d]
            both = bits & masks[q, code]
            bits = (bits + both) | (bits - both)
            good = np.flatnonzero(self._bound(bits, sizes[q], low, high, d + (code > 0)) >= floors[q])
            ended = good[code[good] == 0]
            n = held[ended]
            if len(sizes) > 1 and n.sum() + sum(len(f[0]) for f in found) > FRONT:
                return None
            some, at = np.repeat(ended, n), np.repeat(row[ended] - np.cumsum(n) + n, n) + np.arange(n.sum())
            bound = self._bound(bits[some], sizes[q[some]], self.sizes[at], self.sizes[at], d)
            fits = np.flatnonzero(bound >= floors[q[some]])
            found.append((q[some[fits]], at[fits], bound[fits]))
            many, one = good[below[good] >= 0], good[(below[good] < 0) & (code[good] > 0)]
            above, node, so_far = q[many], below[many], bits[many]
            q, row, bits = q[one], row[one], bits[one]
            if not len(node) and not len(row):
                break
        return found

    @staticmethod
    def _bound(bits: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, used: np.ndarray | int) -> np.ndarray:
        """The largest ratio of a query with a name of low to high code points that goes on after `used` ones."""
        common = 64 - np.bitwise_count(bits).astype(np.int64) + np.maximum(size - HEAD, 0)
        other = np.clip(size - common + used, low, high)
        return np.where(size + other > 0, 2 * np.minimum(common + other - used, size) / np.maximum(size + other, 1), 1.0)

    def best(self, queries: list[str], least: float) -> list[tuple[str, str, float]]:
        """(query, name, ratio) of the best ratio of at least `least`, and of ratios that may equal it in six decimals; of equal ones the smallest name."""
        sizes, masks = np.array([len(x) for x in queries], np.int64), self.masks(queries)
        found: list[dict[float, str]] = [{} for _ in queries]
        tops, asked, before, live = np.full(len(queries), least), np.ones(len(queries)), np.full(len(queries), np.inf), np.arange(len(queries))
        while len(live):  # higher bounds first: a walk ends early where nothing below the best ratio is asked for
            asked[live] = np.maximum(asked[live], least)
            parts, met = [live], np.zeros(len(queries), np.int64)
            while parts:
                part = parts.pop()
                reached = self.reach(masks[part], sizes[part], asked[part] - SLACK)
                if reached is None:
                    parts += np.array_split(part, 2)
                elif reached:
                    q, row, bound = (np.concatenate(c) for c in zip(*reached, strict=True))
                    q = part[q]
                    met += np.bincount(q, minlength=len(queries))
                    new = np.flatnonzero(bound < before[q])
                    new = new[np.lexsort((row[new], -bound[new], q[new]))]
                    for some in np.split(new, np.flatnonzero(np.diff(q[new])) + 1):
                        if len(some):
                            at = q[some[0]]
                            tops[at] = self._compare(queries[at], row[some], bound[some], tops[at], found[at], least)
            before[live] = asked[live] - SLACK
            live = live[(tops[live] < asked[live]) & (asked[live] > least)]
            asked[live] = np.where(met[live] > len(self.names) // 8, least, asked[live] - 1 / np.clip(sizes[live], 1, HEAD))
        return [(x, y, r) for x, top, ratios in zip(queries, tops, found, strict=True) for r, y in ratios.items() if r >= top - SLACK / 2]

    def _compare(self, x: str, rows: np.ndarray, bounds: np.ndarray, top: float, found: dict[float, str], least: float) -> float:
        for i, bound in zip(rows.tolist(), bounds.tolist(), strict=True):
            if bound < top - SLACK / 2:
                break
            y = self.names[i]
            if bound <= top and top in found and found[top] < y:
                continue  # it can tie at most, and its name is larger
            ratio = difflib.SequenceMatcher(None, x, y).ratio()
            if ratio >= least and ratio >= top - SLACK / 2:
                top = max(top, ratio)
                found[ratio] = min(found.get(ratio, y), y)
        return top
