"""Benchmark decontamination: an FM-index per slice of the corpus, searched for all windows of the test items."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .fmindex import FMIndex
from .textkit import Words, batchwise, slices

WINDOW = 10
#: Bytes of item texts that one pass searches for; more items make more passes, each with bounded memory.
PASS_BYTES = 4 << 20
#: Bytes of texts under one index.
SHARD_BYTES = 1 << 20


class Windows:
    """The distinct windows of items: word numbers from 2 on, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        words = Words(pa.array([t for _, t in items], pa.string()))
        self.vocabulary, ids = np.unique(words.hash, return_inverse=True)
        self.symbols = len(self.vocabulary) + 2
        self.spelled = {int(ids[i]): words.word(i) for i in range(len(ids))}
        found: dict[tuple[int, ...], set[str]] = {}
        pairs = []
        for k, (name, _) in enumerate(items):
            seq = ids[words.first[k] : words.first[k + 1]]
            pairs.append(seq[:-1].astype(np.int64) * self.symbols + seq[1:])
            for i in range(max(1, len(seq) - size + 1) if len(seq) else 0):
                found.setdefault(tuple(seq[i : i + size].tolist()), set()).add(name)
        self.items = list(found.values())
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.shortest = int(self.lengths.min(initial=size))
        self.patterns = np.zeros((len(found), size), np.int64)
        for i, w in enumerate(found):
            self.patterns[i, : len(w)] = np.array(w) + 2
        #: Each word pair that a window has: no other pair can stand inside an occurrence.
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of all occurrences in a slice of texts.

        Only stretches of words that windows could cover are indexed: other words, word pairs that no window
        has and document edges end a stretch, and stretches shorter than every window are left out.
        """
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(words.hash) or not len(self.patterns):
            return empty
        at = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == words.hash
        joined = known[:-1] & known[1:]
        joined[words.first[1:-1][(words.first[1:-1] > 0) & (words.first[1:-1] < len(known))] - 1] = False
        on = np.flatnonzero(joined)
        pair = at[on] * self.symbols + at[on + 1]
        place = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
        joined[on] = self.pairs[place] == pair if len(self.pairs) else False
        begins = np.flatnonzero(known & ~np.concatenate([[False], joined]))
        ends = np.flatnonzero(known & ~np.concatenate([joined, [False]])) + 1
        long = ends - begins >= self.shortest
        begins, n = begins[long], (ends - begins)[long]
        if not len(begins):
            return empty
        # The stretches one after another, each followed by symbol 1, and the word that each place stands for.
        size = n + 1
        first = np.cumsum(size) - size
        word = np.repeat(begins - first, size) + np.arange(size.sum())
        seq = at[np.minimum(word, len(at) - 1)] + 2
        seq[first + n] = 1
        index = FMIndex(seq, self.symbols)
        low, high = index.search(self.patterns, self.lengths)
        many = np.maximum(high - low, 0)
        window = np.repeat(np.arange(len(many)), many)
        rows = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        start = word[index.locate(rows)]
        # Hashes stood for words so far; the words themselves decide.
        same = [all(words.word(s + j) == self.spelled[int(p) - 2] for j, p in enumerate(self.patterns[w][: self.lengths[w]])) for w, s in zip(window, start, strict=True)]
        same = np.array(same, bool)
        return window[same], start[same]

    def covered(self, words: Words) -> tuple[np.ndarray, list[set[str]]]:
        """Which words any occurrence covers, and each document's items."""
        window, start = self.hits(words)
        edge = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + self.lengths[window], -1)
        names: list[set[str]] = [set() for _ in words.counts]
        doc = np.searchsorted(words.first, start, "right") - 1
        for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
            names[d] |= self.items[w]
        return np.cumsum(edge)[:-1] > 0, names


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
_FOUND_DDL = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def find_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of docs with struct column `leaks`: n_words, merged hit spans (in words), sorted item ids.

    Items are read in blocks of about pass_bytes of text, and each block is one pass over docs, without a
    shuffle: only a block of items, never the corpus, is sent to the tasks. Null or empty texts have no words and
    no hits; null or empty items have no windows; items of one id count once, and a null id reads "null". No items
    give no hits. Other columns are kept; one named `leaks` is replaced.
    """
    return _found(docs, items, text_col, item_col, item_text, window, pass_bytes)


def _found(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES, then: Callable | None = None, schema: StructType | None = None) -> DataFrame:
    """The rows of find_leaks, or of `schema` if `then` turns its batches into such: in the last pass's own workers, as more would each hold memory."""
    known = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("name"), F.col(item_text).cast("string").alias("text")).where("length(text) > 0").distinct()
    n_bytes = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(n_bytes / pass_bytes))
    out = docs.drop("leaks").withColumn("leaks", F.lit(None).cast(f"struct<{_FOUND_DDL.replace(' long', ':long').replace(' array', ':array').replace(' ', '')}>"))
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block).collect()
        shipped = docs.sparkSession.sparkContext.broadcast([(r.name, r.text) for r in rows])
        run = _pass(shipped, text_col, window)
        if then and block == blocks - 1:
            out = out.mapInArrow(batchwise(lambda batches, run=run: then(run(batches))), schema)
        else:
            out = out.mapInArrow(batchwise(run), out.schema)
    return out


def _pass(shipped, text_col: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shipped.value, window)
        for batch in batches:
            for part in slices(batch, text_col, SHARD_BYTES):
                words = Words(part.column(text_col))
                hit, names = windows.covered(words)
                at = part.schema.get_field_index("leaks")
                rows = []
                for d, before in enumerate(part.column(at).to_pylist()):
                    own = hit[words.first[d] : words.first[d + 1]]
                    if before:
                        own = own.copy()
                        for s in before["spans"]:
                            own[s["start"] : s["end"]] = True
                        names[d] |= set(before["items"])
                    rows.append({"n_words": len(own), "spans": [{"start": a, "end": b} for a, b in _runs(own)] if own.any() else [], "items": sorted(names[d])})
                columns = [c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in part.columns]
                columns[at] = pa.array(rows, _FOUND)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return run


def leak_digest(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    found = find_leaks(docs.select(id_col, options.get("text_col", "text")), items, **options)
    n_hit = F.aggregate("leaks.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    found = found.select(id_col, "leaks.n_words", n_hit.alias("n_hit"), F.size("leaks.items").cast("long").alias("n_items"), F.sha2(F.array_join("leaks.items", ","), 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def remove_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with the hit spans cut out of the texts, from a span's first word to its last; clean rows unchanged.

    What stands before and after a span stays, joined by a space. Rows keep their order and columns.
    """
    own = {c: f"__own_{c}" for c in docs.columns if c == "leaks"}  # find_leaks replaces such a column
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaks = batch.column(batch.schema.get_field_index("leaks")).to_pylist()
            texts = batch.column(text_col).to_pylist()
            for i, x in enumerate(leaks):
                if x["spans"]:
                    words = Words(pa.array([texts[i]]))
                    raw, keep, at = texts[i].encode(), [], 0
                    for s in x["spans"]:
                        keep.append(raw[at : words.start[s["start"]]])
                        at = words.end[s["end"] - 1]
                    texts[i] = b" ".join(p.strip() for p in [*keep, raw[at:]] if p.strip()).decode()
            columns = [pa.array(texts, pa.string()) if f.name == text_col else batch.column(own.get(f.name, f.name)) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _found(docs.withColumnsRenamed(own), items, text_col=text_col, then=cut, schema=schema, **options)
