"""Periodic runs of words in whole texts, and texts with each run cut to its first period."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .squares import SquareCatchers
from .textkit import NONSPACE, Words, batchwise, mix64, slices

Run = tuple[int, int, int]
LEAST_POWER, LEAST_WORDS = 4, 6
#: Words appended at a time: what a level of catchers keeps of them is let go before the next ones come.
APPENDED = 1 << 20


def runs_of_texts(words: Words, power: int = LEAST_POWER, least: int = LEAST_WORDS) -> dict[int, list[Run]]:
    """(start, length, period) of the runs of each text that has some, by start, then period: one stream with a mark after each text."""
    counts = words.counts
    texts = len(counts)
    if not texts or counts.max() < max(power, least):
        return {}
    place = np.arange(len(words.hash)) + words.docs()
    stream = mix64(np.arange(len(words.hash) + texts, dtype=np.uint64) + np.uint64(1 << 40))  # marks differ from each other
    stream[place] = words.hash
    first = words.first[:-1] + np.arange(texts)
    catchers = SquareCatchers(power, int(counts.max()) // power)
    for at in range(0, len(stream), APPENDED):
        catchers.append(stream[at : at + APPENDED])
    out: dict[int, list[Run]] = {}
    for start, length, period in catchers.finish():
        if length >= least:
            of = int(np.searchsorted(first, start, "right")) - 1
            out.setdefault(of, []).append((start - int(first[of]), length, period))
    return out


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that stand in a run after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def _per_slice(docs: DataFrame, columns: list[str], text_col: str, power: int, least: int, rows: Callable, schema: StructType | str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                words = Words(part.column(text_col), NONSPACE, fold=False)
                yield rows(part, words, runs_of_texts(words, power, least))

    return docs.select(*(f"`{c}`" for c in columns)).mapInArrow(batchwise(run), schema)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", power: int = LEAST_POWER, least: int = LEAST_WORDS) -> DataFrame:
    """One row per run: the id, start (from word 0), length and smallest period, in words between spaces and controls 9 to 13.

    A run is a stretch of at least `power` periods and `least` words that no neighbouring word extends. Null, empty and
    short texts have none; equal rows have their runs each; null ids stay. Other columns are left out.
    """

    def rows(part: pa.RecordBatch, words: Words, runs: dict[int, list[Run]]) -> pa.RecordBatch:
        of = [i for i, own in runs.items() for _ in own]
        columns = np.array([r for own in runs.values() for r in own], np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array(of, pa.int64())), *(pa.array(c) for c in columns.T)], names=[id_col, "start", "length", "period"])

    schema = StructType([docs.schema[id_col]]).add("start", "long").add("length", "long").add("period", "long")
    return _per_slice(docs, [id_col, text_col], text_col, power, least, rows, schema)


def collapse_runs(docs: DataFrame, text_col: str = "text", power: int = LEAST_POWER, least: int = LEAST_WORDS) -> DataFrame:
    """docs, each run cut to its first period and the words of such a text joined by one space; other texts stay as they are, null too."""

    def rows(part: pa.RecordBatch, words: Words, runs: dict[int, list[Run]]) -> pa.RecordBatch:
        texts = part.column(text_col).to_pylist()
        for i, own in runs.items():
            texts[i] = b" ".join(kept_words(texts[i].encode().split(), own)).decode()
        at = part.schema.get_field_index(text_col)
        return part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return _per_slice(docs, docs.columns, text_col, power, least, rows, docs.schema)


def runs_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_runs, the run of greatest length / period (then smallest start, then period), hashes of all runs and of the kept words."""

    def rows(part: pa.RecordBatch, words: Words, runs: dict[int, list[Run]]) -> pa.RecordBatch:
        best, listed, collapsed = [], [], []
        none = hashlib.sha256(b"").hexdigest()
        for i in range(len(words.counts)):
            own = runs.get(i, [])
            texts = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes().split()
            collapsed.append(hashlib.sha256(b" ".join(kept_words(texts, own) if own else texts)).hexdigest())
            listed.append(hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in own).encode()).hexdigest() if own else none)
            best.append(min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if own else (None, None, None))
        longs = [pa.array(c, pa.int64()) for c in zip(*best, strict=True)] if best else [pa.array([], pa.int64())] * 3
        milli = pa.array([1000 * n // p if n else None for _, n, p in best], pa.int64())
        counts = pa.array([len(runs.get(i, ())) for i in range(len(best))], pa.int64())
        return pa.RecordBatch.from_arrays([part.column(id_col), counts, *longs, milli, pa.array(listed, pa.string()), pa.array(collapsed, pa.string())], names=schema.names)

    schema = StructType([docs.schema[id_col]])
    for name in ("n_runs", "start", "length", "period", "exponent_milli"):
        schema = schema.add(name, "long")
    schema = schema.add("runs_sha256", "string").add("collapsed_sha256", "string")
    return _per_slice(docs, [id_col, text_col], text_col, LEAST_POWER, LEAST_WORDS, rows, schema)
