"""Repeated passages: bytes covered by a string of SIZE bytes that starts anywhere else too.

Every window of SIZE bytes picks an anchor in itself by content, equal windows the same one, so equal windows meet
under the anchor's hash. Neighbouring windows with one anchor are a run, and runs of equal bytes repeat as a whole.
Only anchors with runs of different bytes need more: the bytes of such runs meet, their suffixes are put in order by
two-stage sorting, and a window whose neighbour has SIZE common bytes repeats. An anchor under which very many
different runs stand is split by the bytes that all windows of a narrow range of places share; where that could still
leave too much in one place, each window meets its equals by its own hash, in counts that Spark adds up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .anchors import Runs
from .shared import stored
from .suffixes import neighbour_prefixes, two_stage_order
from .textkit import batchwise, groupwise, pieces, slices, text_buffer

SIZE, GRAM = 200, 64
SLICE = 1 << 20
#: Runs in one group of the first meeting, and bytes of runs in one suffix array, about.
GROUP, ARRAY_BYTES = 1 << 18, 1 << 20
#: An anchor with more different runs than this is split by place.
MANY = 500
#: Windows of an anchor with more different runs than this meet one by one, not in suffix arrays.
HOT = 4000
#: Places of windows in an anchor's range that stay together when it is split.
RANGE = 24
FILTER_RATIO, FILTER_BITS = 16, 1 << 26
#: Texts whose hashes a task remembers, so as to enter each text once.
MOST_SEEN = 1 << 17
_SALTS = 64
_FIELDS = [("hash", np.int64), ("bytes", np.int64), ("text", np.int64), ("lo", np.int64), ("n", np.int32), ("multi", np.int8)]
_WIDTH = sum(np.dtype(t).itemsize for _, t in _FIELDS)


def _own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Runs, np.ndarray]]:
    """Runs of slices of texts, each text once in a task, and the texts' hashes."""
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            keys = part.column("key").to_pylist()
            if len(seen) > MOST_SEEN:
                seen.clear()
            new = []
            for i, k in enumerate(keys):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            if new:
                part = part.take(pa.array(new))
                yield Runs(*text_buffer(part.column("text")), SIZE, GRAM), part.column("key").to_numpy()


def _first_meeting(rows: DataFrame, parts: int, many: int, hot: int) -> DataFrame:
    """(kind, hash, bytes, text, lo, n): kind 0 are repeated runs, 1 runs to compare by bytes, 2 crowded and 3 hot anchors."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs, keys in _own_texts(batches):
            doc = np.searchsorted(runs.offsets, runs.lo, "right") - 1
            n = runs.hi - runs.lo + 1
            columns = [runs.hash.view(np.int64), runs.span_hash(runs.lo, n + SIZE - 1).view(np.int64), keys[doc], runs.lo - runs.offsets[doc], n.astype(np.int32)]
            order = np.lexsort((columns[1], columns[0]))
            columns = [c[order] for c in columns]
            first = np.ones(len(n), bool)
            first[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
            size = np.diff(np.append(np.flatnonzero(first), len(n)))
            multi = np.repeat(size > 1, size)
            # Runs of equal bytes in this slice are settled here; one of them goes on for the rest of the corpus.
            group = np.where(first, (columns[0].view(np.uint64) % np.uint64(parts)).astype(np.int64), 0)
            yield _packed([c[first] for c in columns], multi[first], group[first])
            yield _packed([c[multi] for c in columns], multi[multi], -1 - (columns[2][multi].view(np.uint64) % np.uint64(_SALTS)).astype(np.int64))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        got = _unpacked(frame["blob"])
        if frame["group"].iloc[0] < 0:
            return _result(0, got, np.ones(len(got["lo"]), bool))
        order = np.lexsort((got["lo"], got["text"], got["bytes"], got["hash"]))
        got = {k: v[order] for k, v in got.items()}
        h, b = got["hash"], got["bytes"]
        new_h = np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_b = new_h.copy()
        new_b[1:] |= b[1:] != b[:-1]
        new_place = new_b.copy()
        new_place[1:] |= (got["text"][1:] != got["text"][:-1]) | (got["lo"][1:] != got["lo"][:-1])
        of_b, of_h = np.cumsum(new_b) - 1, np.cumsum(new_h) - 1
        repeated = (np.bincount(of_b, new_place) > 1) | (np.bincount(of_b, got["multi"]) > 0)
        kinds = np.bincount(of_h, new_b)
        settled = repeated[of_b] & new_place
        open_ = ~repeated[of_b] & (kinds[of_h] > 1) & new_place
        crowd = np.where(kinds > hot, 3, 2)[of_h]
        on = new_h & (kinds[of_h] > min(many, hot))
        return pd.concat([_result(0, got, settled), _result(1, got, open_), *(_result(k, got, on & (crowd == k)) for k in (2, 3))])

    entered = rows.mapInArrow(batchwise(enter), "group int, blob binary")
    return entered.groupBy("group").applyInPandas(groupwise(meet), "kind int, hash long, bytes long, text long, lo long, n int")


def _packed(columns: list[np.ndarray], multi: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(group, kind="stable")
    group = group[order]
    columns = [c[order].astype(t) for c, (_, t) in zip([*columns, multi], _FIELDS, strict=True)]
    begin, end = pieces(group)
    blobs = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(begin, end, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(group[begin].astype(np.int32)), pa.array(blobs, pa.binary())], names=["group", "blob"])


def _unpacked(blobs: pd.Series) -> dict[str, np.ndarray]:
    out: dict[str, list[np.ndarray]] = {k: [] for k, _ in _FIELDS}
    for blob in blobs:
        n, at = len(blob) // _WIDTH, 0
        for k, t in _FIELDS:
            out[k].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return {k: np.concatenate(v) for k, v in out.items()}


def _result(kind: int, got: dict[str, np.ndarray], on: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.int32(kind), **{k: got[k][on] for k in ("hash", "bytes", "text", "lo", "n")}})


def _filter_of(hashes: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_RATIO bits a hash, FILTER_BITS at most, with the hashes' places set."""
    size = min(FILTER_BITS, max(1 << 15, 1 << (FILTER_RATIO * hashes.count()).bit_length()))
    bit = F.col("hash").bitwiseAND(F.lit(size - 1)) + 1
    found = hashes.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()  # FILTER_BITS at most
    bits = np.zeros(size // 8, np.uint8)
    for r in found:
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _second_meeting(rows: DataFrame, open_: DataFrame, crowded: DataFrame, hot: DataFrame) -> DataFrame:
    """(hash, bytes, first, last): windows, by place in their run, of open runs that another run or place has too; hot anchors' runs stay out."""
    spark = rows.sparkSession
    shipped = spark.sparkContext.broadcast((_filter_of(open_), _filter_of(crowded), _filter_of(hot)))
    parts = max(64, math.ceil(open_.count() * (SIZE + SIZE // 2) / ARRAY_BYTES))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, split, left_out = shipped.value
        for runs, _ in _own_texts(batches):
            on = np.flatnonzero(_in_filter(wanted, runs.hash) & ~_in_filter(left_out, runs.hash))
            h, lo, hi, at = runs.hash[on], runs.lo[on], runs.hi[on], runs.at[on]
            key = runs.span_hash(lo, hi - lo + SIZE)
            _, one = np.unique(np.stack([h, key]), axis=1, return_index=True) if len(h) else (None, np.zeros(0, np.int64))
            h, lo, hi, at, key = h[one], lo[one], hi[one], at[one], key[one]
            # A crowded anchor's run is cut at every RANGE-th place of its windows; all windows of a cut share its core.
            crowd = _in_filter(split, h)
            low_cut = np.where(crowd, (at - hi) // RANGE, 0)
            cuts = np.where(crowd, (at - lo) // RANGE - low_cut + 1, 1)
            row = np.repeat(np.arange(len(h)), cuts)
            cut = low_cut[row] + np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            begin = np.where(crowd[row], np.maximum(lo[row], at[row] - (cut + 1) * RANGE + 1), lo[row])
            end = np.where(crowd[row], np.minimum(hi[row], at[row] - cut * RANGE), hi[row])
            core = np.where(crowd[row], at[row] - cut * RANGE, at[row])
            length = np.where(crowd[row], SIZE - RANGE + 1, GRAM)
            meet = np.where(crowd[row], runs.span_hash(core, length), h[row])
            group = (meet >> np.uint64(20)) % np.uint64(parts)
            raw = runs.data
            yield pa.RecordBatch.from_arrays(
                [pa.array(group.astype(np.int32)), pa.array(h[row].view(np.int64)), pa.array(key[row].view(np.int64)), pa.array((begin - lo[row]).astype(np.int32)), pa.array([raw[a : b + SIZE].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary())],
                names=["group", "hash", "bytes", "first", "body"],
            )

    def order(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["hash", "bytes", "first"]).reset_index(drop=True)
        data = np.frombuffer(b"".join(x for b in frame["body"] for x in (b, b"\xff")), np.uint8)  # no text has 0xFF
        size = frame["body"].str.len().to_numpy()
        begin = np.cumsum(size + 1) - size - 1
        starts = size - SIZE + 1
        owner = np.repeat(np.arange(len(frame)), starts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
        whose = np.full(len(data), -1, np.int64)
        whose[begin[owner] + place] = np.arange(len(owner))
        ranked = two_stage_order(data, SIZE)
        ranked = ranked[whose[ranked] >= 0]
        same = neighbour_prefixes(data, ranked, SIZE) >= SIZE
        twice = np.zeros(len(owner), bool)
        twice[whose[ranked[1:][same]]] = twice[whose[ranked[:-1][same]]] = True
        begins = twice & ~np.concatenate([[False], twice[:-1] & (owner[1:] == owner[:-1])])
        ends = twice & ~np.concatenate([twice[1:] & (owner[1:] == owner[:-1]), [False]])
        a, b = np.flatnonzero(begins), np.flatnonzero(ends)
        f = frame["first"].to_numpy()[owner[a]]
        return pd.DataFrame({"hash": frame["hash"].to_numpy()[owner[a]], "bytes": frame["bytes"].to_numpy()[owner[a]], "first": f + place[a], "last": f + place[b]})

    fetched = rows.mapInArrow(batchwise(fetch), "group int, hash long, bytes long, first int, body binary")
    return fetched.groupBy("group").applyInPandas(groupwise(order), "hash long, bytes long, first long, last long")


def _hot_windows(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(hash, bytes, first, last): as of the second meeting, for runs of hot anchors, a row for each repeated window."""
    shipped = rows.sparkSession.sparkContext.broadcast(_filter_of(hot))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs, _ in _own_texts(batches):
            on = np.flatnonzero(_in_filter(shipped.value, runs.hash))
            lo, n = runs.lo[on], runs.hi[on] - runs.lo[on] + 1
            row = np.repeat(np.arange(len(on)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            columns = [runs.hash[on][row], runs.span_hash(lo, n + SIZE - 1)[row], runs.span_hash(lo[row] + place, np.full(len(row), SIZE))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(place)], names=["hash", "bytes", "window", "first"])

    windows = stored(rows.mapInArrow(batchwise(fetch), "hash long, bytes long, window long, first long"), "windows")
    where = F.xxhash64("hash", "bytes", "first")
    twice = windows.groupBy("window").agg(F.min(where).alias("one"), F.max(where).alias("other")).where("one <> other")
    return windows.join(twice, "window", "left_semi").select("hash", "bytes", "first", F.col("first").alias("last"))


def repeated_spans(docs: DataFrame, text_col: str = "text", many: int = MANY, hot: int = HOT) -> DataFrame:
    """(text, spans) for each distinct text (by hash) with repeated bytes, other than by whole copies: merged spans in bytes, in order."""
    rows = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= SIZE)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(64, math.ceil(total * 2 / (SIZE - GRAM) / GROUP))
    met = stored(_first_meeting(rows, parts, many, hot), "runs")
    open_ = met.where("kind = 1")
    cover = met.where("kind = 0").select("text", "lo", (F.col("lo") + F.col("n") - 1 + SIZE).alias("hi"))
    if not open_.isEmpty():
        hottest = met.where("kind = 3")
        found = _second_meeting(rows, open_, met.where("kind = 2"), hottest)
        if not hottest.isEmpty():
            found = found.unionByName(_hot_windows(rows, hottest))
        more = open_.join(found, ["hash", "bytes"])
        cover = cover.unionByName(more.select("text", (F.col("lo") + F.col("first")).alias("lo"), (F.col("lo") + F.col("last") + SIZE).alias("hi")))

    # Gaps and islands: a span starts where no earlier one reaches.
    by = W.partitionBy("text").orderBy("lo", "hi")
    reach = F.max("hi").over(by.rowsBetween(W.unboundedPreceding, -1))
    islands = cover.withColumn("fresh", (reach.isNull() | (F.col("lo") > reach)).cast("int")).withColumn("island", F.sum("fresh").over(by))
    merged = islands.groupBy("text", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many: int = MANY, hot: int = HOT) -> DataFrame:
    """Per row: id, n_bytes, sha256 of the text, spans (removed runs in bytes), kept (the remaining bytes; null where nothing is removed).

    Texts are UTF-8 bytes; null and empty ones have none and lose none, and no match crosses texts. Texts of SIZE
    bytes or more that stand in several rows are removed whole. Only a text that stands in one row and loses some
    bytes is shuffled with its spans. Repeated ids are rows of their own. Columns besides id and text aren't read.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    rows = docs.select("id", F.xxhash64("body").alias("key"), F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("sha256"))
    copies = stored(rows.where(F.col("n_bytes") >= SIZE).groupBy("key").count().where("count > 1").select("key"), "copies")
    spans = repeated_spans(docs, "body", many, hot).withColumnRenamed("text", "key")
    spans = stored(spans.join(copies, "key", "left_anti"), "spans")
    texts = docs.select(F.xxhash64("body").alias("key"), F.col("body")).join(spans, "key")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, cut in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ends = [0, *(s["hi"] for s in cut)]
                out.append(b"".join(body[a:b] for a, b in zip(ends, [*(s["lo"] for s in cut), len(body)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["key", "spans", "kept"])

    one = "array<struct<lo:long,hi:long>>"
    cut = texts.select("key", "body", "spans").mapInArrow(batchwise(keep), f"key long, spans {one}, kept binary")
    out = rows.join(copies.withColumn("copied", F.lit(True)), "key", "left").join(cut, "key", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")))
    copied = F.col("copied").isNotNull()
    return out.select(F.col("id").alias(id_col), "n_bytes", "sha256", F.when(copied, whole).otherwise(F.coalesce("spans", F.array().cast(one))).alias("spans"), F.when(copied, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))


def repeat_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many: int = MANY, hot: int = HOT) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and kept_sha256."""
    found = remove_repeats(docs, id_col, text_col, many, hot)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    kept = F.coalesce(F.sha2("kept", 256), F.col("sha256"))
    return found.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), kept.alias("kept_sha256"))
