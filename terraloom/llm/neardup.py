"""N-gram Jaccard join by parity sketches: all links at a threshold, how many each text has, and their components.

A text's set is its distinct shingles (hashes of five words). Texts with equal sets are one node. In each band of
sizes, a sketch is a row of chunks of 2**CHUNK_BITS bits, as many chunks as the band's largest set has shingles;
each shingle flips one bit. Sketches are kept as the places of their set bits. Their Hamming distance is at most the
symmetric difference of the sets, so sketches of linked sets of n shingles, the smaller, differ in d = n*(1-t)/t
chunks at most: of any d+1 chunks that aren't blank, one is equal in both. In one order of all (chunk, content) the
first d+1 of either set share one then, and texts meet on those. The order is by how many texts have a content: a
text with d+1 contents of its own meets nobody. A set that one of the next band could link with is entered there too.

Contents that share nodes make a bucket where that saves work. A bucket's nodes are compared in tiles of a bounded
size, by a short dense sketch first and the sets then; a tile gives a forest of its links, so rows never grow with
the square of a group. Links are counted in the same way, over the nodes of each component.
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

from .components import components
from .shared import batch_rows, discard, stored
from .textkit import NONSPACE, Words, batchwise, groupwise, mix64, pieces, shingles, slices

SHINGLE, PERCENT = 5, 75
#: Sets below this size are the first band, of so many chunks; bands above it each span a factor of 4.
SMALL, SMALL_CHUNKS = 64, 1 << 16
#: Bits of a chunk. All chunks of a band must have far more bits than all its sets have shingles, or strangers share contents.
CHUNK_BITS = 32
#: A content that so many texts of a slice have is sent on with its count; its texts wait for the sum.
OFTEN = 8
#: Contents with more nodes than this make buckets apart from the others.
LARGE = 16
#: Chunks that meet in one group, and bytes of sets in a block of a bucket and in a group of tiles, about.
GROUP, BLOCK_BYTES, TILES_BYTES = 1 << 20, 1 << 20, 4 << 20
#: Rows of tiles (some 60 bytes each) that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 200_000
#: Bits per node, and most bits, of the filter that picks rows whose sets are fetched; it bounds the broadcast, not the result.
FILTER_RATIO, FILTER_BITS = 16, 1 << 26
#: Bytes of texts in a slice, rows of an Arrow batch, nodes that a task remembers so as to enter each once.
SLICE, BATCH_ROWS, MOST_SEEN = 1 << 20, 2000, 1 << 17
#: Bits of the dense sketch that a pair is first compared by.
SKETCH_BITS = 2048


class Sets:
    """Shingle sets of a slice of texts: sorted within each text, and the node (hash of the set) of each."""

    def __init__(self, column: pa.Array, k: int):
        h, n = shingles(Words(column, NONSPACE), k)
        edge = np.concatenate([[0], np.cumsum(n)])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            h[a:b].sort()
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[1:] != h[:-1]
        fresh[edge[:-1][n > 0]] = True
        kept = np.concatenate([[0], np.cumsum(fresh)])
        self.edge = kept[edge]
        self.h, self.n = h[fresh], np.diff(self.edge)
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(self.h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
            self.node = mix64(total[self.edge[1:]] - total[self.edge[:-1]] + self.n.astype(np.uint64)).view(np.int64)


class Seen:
    """The nodes that a task has had, as far as it remembers."""

    def __init__(self):
        self.nodes: set[int] = set()

    def new(self, sets: Sets, among: np.ndarray) -> np.ndarray:
        """The first row of each node not had before, of the rows `among`."""
        out = []
        for i, node in zip(among.tolist(), sets.node[among].tolist(), strict=True):
            if node not in self.nodes:
                self.nodes.add(node)
                out.append(i)
        if len(self.nodes) > MOST_SEEN:
            self.nodes.clear()
        return np.array(out, np.int64)


def largest(percent: int):
    """For sizes: the largest symmetric difference of a link in which the set is the smaller one, and its largest partner."""

    def of(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        partner = n * 100 // percent
        return (n + partner) * (100 - percent) // (100 + percent), partner

    return of


def sketch_chunks(sets: Sets, chosen: np.ndarray, most) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sketches of the chosen sets, one in each band that a set is entered in: whose each is (its place in chosen),
    and (sketch, content) of every chunk that isn't blank, by sketch."""
    n = sets.n[chosen]
    band = np.where(n < SMALL, 0, np.floor(np.log2(np.maximum(n, 1) / SMALL) / 2 + 1e-12).astype(np.int64) + 1)
    next_too = most(n)[1] >= SMALL * 4**band
    owner = np.concatenate([np.arange(len(chosen)), np.flatnonzero(next_too)])
    band = np.concatenate([band, band[next_too] + 1])
    chunks = np.where(band == 0, SMALL_CHUNKS, SMALL * 4**band).astype(np.uint64)
    size = n[owner]
    sketch = np.repeat(np.arange(len(owner)), size)
    h = sets.h[np.repeat(sets.edge[chosen[owner]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    # The upper half of a hash names the chunk, in rising order as the set is sorted; the lower half names the bit.
    chunk = ((h >> np.uint64(32)) * chunks[sketch]) >> np.uint64(32)
    first = np.ones(len(h), bool)
    first[1:] = (sketch[1:] != sketch[:-1]) | (chunk[1:] != chunk[:-1])
    at = np.flatnonzero(first)
    place = h & np.uint64((1 << CHUNK_BITS) - 1)
    word = np.bitwise_xor.reduceat(mix64(place + np.uint64(1)), at) if len(at) else place  # a bit flipped twice is gone
    sketch, chunk = sketch[at], chunk[at]
    full = word != 0
    sketch, chunk, word = sketch[full], chunk[full], word[full]
    with np.errstate(over="ignore"):
        content = mix64(mix64(chunk + (band[sketch].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) ^ word)
    return owner, sketch, content


def _pack(head: list[int], *columns: np.ndarray) -> bytes:
    return np.array(head, np.int64).tobytes() + b"".join(c.tobytes() for c in columns)


def _shared_contents(rows: DataFrame, shingle: int, percent: int, parts: int) -> DataFrame:
    """(content, node, n): the contents of the first d+1 chunks of each node's sketches that another text has too.

    Chunks meet by content in `parts` groups, as numbers of their slice and sketch; those that several texts have go
    back, with their count, to the groups of their slices, where each sketch's d+1 first are chosen. A content that
    OFTEN texts of a slice have goes as one row of the slice.
    """
    most, many = largest(percent), np.uint16(0xFFFF)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                s = Sets(part.column("text"), shingle)
                chosen = seen.new(s, np.flatnonzero(s.n))
                for lo in range(0, len(chosen), 20_000):  # numbers of sketches have 16 bits
                    yield from slice_rows(s, chosen[lo : lo + 20_000])

    def slice_rows(s: Sets, chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
        owner, sketch, content = sketch_chunks(s, chosen, most)
        node, n = s.node[chosen][owner], s.n[chosen][owner].astype(np.int32)
        with np.errstate(over="ignore"):
            slice_ = int(mix64(np.add.reduce(mix64(node.view(np.uint64) + np.arange(len(node), dtype=np.uint64)), keepdims=True)).view(np.int64)[0])
        group = ((content >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        content = (group << np.uint64(32)) | (content & np.uint64(0xFFFFFFFF))
        order = np.argsort(content)
        sketch, content, group = sketch[order].astype(np.uint16), content[order], group[order]
        run = np.flatnonzero(np.concatenate([[True], content[1:] != content[:-1]])) if len(content) else np.zeros(0, np.int64)
        size = np.diff(np.append(run, len(content)))
        often = size >= OFTEN
        wait = np.repeat(often, size)
        full = np.bincount(sketch, minlength=len(owner)).astype(np.int32)
        own = _pack([slice_, len(owner), int(often.sum()), int(wait.sum())], node, n, full, content[run[often]], size[often].astype(np.int64), sketch[wait])
        # What stands once for a slice: the content and its count. Else the sketch.
        keep = ~wait
        keep[run[often]] = True
        number = np.where(wait, many, sketch)[keep]
        count = np.repeat(np.where(often, size, 1), size)[keep].astype(np.uint32)
        content, group = content[keep], group[keep].astype(np.int64)
        begin, end = pieces(group)
        blobs = [_pack([slice_, b - a], content[a:b].astype(np.uint32), number[a:b], count[a:b][number[a:b] == many]) for a, b in zip(begin, end, strict=True)]
        keys = np.append(group[begin], -1 - slice_ % parts).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([*blobs, own], pa.binary())], names=["group", "blob"])

    def count_(frame: pd.DataFrame) -> pd.DataFrame:
        group = int(frame["group"].iloc[0])
        if group < 0:
            return pd.DataFrame({"home": -1 - group, "own": True, "blob": frame["blob"]})
        owner, rest, number, count = [], [], [], []
        for blob in frame["blob"]:
            slice_, k = np.frombuffer(blob, np.int64, 2)
            owner.append(np.full(k, slice_))
            rest.append(np.frombuffer(blob, np.uint32, k, 16))
            number.append(np.frombuffer(blob, np.uint16, k, 16 + 4 * k))
            each = np.ones(k, np.int64)
            each[number[-1] == many] = np.frombuffer(blob, np.uint32, -1, 16 + 6 * k)
            count.append(each)
        owner, rest, number, count = map(np.concatenate, (owner, rest, number, count))
        order = np.argsort(rest, kind="stable")
        owner, rest, number, count = owner[order], rest[order], number[order], count[order]
        run = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
        texts = np.add.reduceat(count, run)
        texts = np.repeat(texts, np.diff(np.append(run, len(rest))))
        on = np.flatnonzero(texts > 1)
        home = owner[on] % parts
        on = on[np.argsort(home, kind="stable")]
        home = owner[on] % parts
        begin, end = pieces(home)
        texts = np.minimum(texts, 0xFFFF).astype(np.uint16)
        blobs = [_pack([group, b - a], owner[on[a:b]], rest[on[a:b]], number[on[a:b]], texts[on[a:b]]) for a, b in zip(begin, end, strict=True)]
        return pd.DataFrame({"home": home[begin].astype(np.int32), "own": False, "blob": blobs})

    def first_chunks(frame: pd.DataFrame) -> pd.DataFrame:
        back: list[list[np.ndarray]] = [[], [], [], []]
        for blob in frame["blob"][~frame["own"]]:
            group, k = np.frombuffer(blob, np.int64, 2)
            back[0].append(np.frombuffer(blob, np.int64, k, 16))
            back[1].append((np.uint64(group) << np.uint64(32)) | np.frombuffer(blob, np.uint32, k, 16 + 8 * k))
            back[2].append(np.frombuffer(blob, np.uint16, k, 16 + 12 * k))
            back[3].append(np.frombuffer(blob, np.uint16, k, 16 + 14 * k))
        empty = pd.DataFrame({"content": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "n": np.zeros(0, np.int32)})
        if not back[0]:
            return empty
        owner, content, number, texts = map(np.concatenate, back)
        order = np.argsort(owner, kind="stable")
        owner, content, number, texts = owner[order], content[order], number[order], texts[order]
        out = [empty]
        for blob in {bytes(b[:8]): b for b in frame["blob"][frame["own"]]}.values():
            slice_, e, hot, waiting = np.frombuffer(blob, np.int64, 4).tolist()
            at = 32
            fields = []
            for t, k in ((np.int64, e), (np.int32, e), (np.int32, e), (np.uint64, hot), (np.int64, hot), (np.uint16, waiting)):
                fields.append(np.frombuffer(blob, t, k, at))
                at += k * np.dtype(t).itemsize
            node, n, full, of_hot, per_hot, who = fields
            lo, hi = np.searchsorted(owner, slice_), np.searchsorted(owner, slice_, "right")
            c, x, f = content[lo:hi], number[lo:hi], texts[lo:hi]
            # A row that stands for a slice becomes the rows of its sketches.
            alone = x != many
            c2, f2 = c[~alone], f[~alone]
            place = np.searchsorted(of_hot, c2)
            size = per_hot[place] if len(place) else np.zeros(0, np.int64)
            start = (np.cumsum(per_hot) - per_hot)[place] if len(place) else size
            who = who[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            x = np.concatenate([x[alone], who]).astype(np.int64)
            c, f = np.concatenate([c[alone], np.repeat(c2, size)]), np.concatenate([f[alone], np.repeat(f2, size)])
            need = most(n.astype(np.int64))[0] + 1 - (full - np.bincount(x, minlength=e))
            on = need[x] > 0
            x, c, f = x[on], c[on], f[on]
            order = np.lexsort((mix64(c), f, x))
            x, c = x[order], c[order]
            on = np.arange(len(x)) - np.searchsorted(x, x) < need[x]
            out.append(pd.DataFrame({"content": c[on].view(np.int64), "node": node[x[on]], "n": n[x[on]]}))
        return pd.concat(out)

    met = rows.select("text").mapInArrow(batchwise(enter), "group int, blob binary").groupBy("group").applyInPandas(groupwise(count_), "home int, own boolean, blob binary")
    return met.groupBy("home").applyInPandas(groupwise(first_chunks), "content long, node long, n int")


def _buckets(shared: DataFrame) -> DataFrame:
    """(bucket, node, n): nodes to compare with each other. Two nodes of a content share a bucket.

    Contents with equal nodes are one. Those that share nodes, directly or by others, make one bucket if its pairs
    aren't more than theirs together; else each is its own. Large contents don't tie small ones together.
    """
    per = shared.groupBy("content").agg(F.count("*").alias("m"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")).where("m > 1")
    kept = per.groupBy("m", "x", "y").agg(F.min("content").alias("content"))
    rows = stored(shared.join(kept.select("content", "m"), "content"), "contents")
    first = rows.groupBy("node", (F.col("m") > LARGE).alias("large")).agg(F.min("content").alias("first"))
    ties = rows.withColumn("large", F.col("m") > LARGE).join(first, ["node", "large"]).select(F.col("content").alias("a"), F.col("first").alias("b"))
    label = components(ties)
    rows = rows.join(label.select(F.col("node").alias("content"), "label"), "content", "left").withColumn("label", F.coalesce("label", "content"))
    rows = stored(rows, "labelled")
    together = rows.select("label", "node").distinct().groupBy("label").agg(F.count("*").alias("nodes"))
    apart = rows.groupBy("label").agg(F.sum(F.col("m").cast("double")).alias("pairs"))  # each content of m nodes has m rows: the sum of m * m
    better = together.join(apart, "label").select("label", (F.col("nodes").cast("double") * F.col("nodes") <= F.col("pairs")).alias("as_one"))
    rows = rows.join(better, "label").select(F.when(F.col("as_one"), F.col("label")).otherwise(F.col("content")).alias("bucket"), "node", "n")
    return rows.distinct()


def _filter_size(n: int) -> int:
    return min(FILTER_BITS, max(1 << 15, 1 << (FILTER_RATIO * n).bit_length()))


def _with_sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(id, n, node, items) per row: size and hash of its set, and its sorted shingles as bytes in one row of each task that has a wanted node.

    node is null for an empty set. Wanted nodes are told by a filter of bounded size, so a few others have items too.
    """
    size = _filter_size(wanted.count())
    bit = F.col("node").bitwiseAND(F.lit(size - 1)) + 1
    found = wanted.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()  # FILTER_BITS at most
    bits = np.zeros(size // 8, np.uint8)
    for r in found:
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    shipped = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                s = Sets(part.column("text"), shingle)
                at = s.node.view(np.uint64) & np.uint64(size - 1)
                on = np.flatnonzero((s.n > 0) & ((shipped.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1))
                items: list[bytes | None] = [None] * part.num_rows
                for i in seen.new(s, on).tolist():
                    items[i] = s.h[s.edge[i] : s.edge[i + 1]].tobytes()
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(s.n), pa.array(s.node, mask=s.n == 0), pa.array(items, pa.binary())], names=["id", "n", "node", "items"])

    return rows.mapInArrow(batchwise(run), f"id {rows.schema['id'].dataType.simpleString()}, n long, node long, items binary")


def parity_sketch(items: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A row of SKETCH_BITS bits (as 64-bit words) for each of n owners: each bit the parity of the items that hash to it."""
    bits = np.bincount(owner * SKETCH_BITS + (mix64(items) >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=n * SKETCH_BITS)
    return np.packbits((bits & 1).astype(np.uint8).reshape(n, -1), axis=1).view(np.uint64)


class Tile:
    """Some nodes with their sets, compared each with all later ones of the other block, or of the same one if there is no other."""

    def __init__(self, sets: list[bytes], percent: int):
        flat = np.frombuffer(b"".join(sets), np.uint64)
        self.n = np.array([len(s) // 8 for s in sets], np.int64)
        self.edge = np.concatenate([[0], np.cumsum(self.n)])
        self.percent = percent
        _, self.item = np.unique(flat, return_inverse=True)
        self.mark = np.zeros(int(self.item.max(initial=-1)) + 1, np.int64)
        self.sketch = np.concatenate([parity_sketch(flat[self.edge[a] : self.edge[min(a + 256, len(sets))]], np.repeat(np.arange(len(self.n[a : a + 256])), self.n[a : a + 256]), len(self.n[a : a + 256])) for a in range(0, len(sets), 256)])

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that link with i."""
        n, t = self.n, self.percent
        others = others[100 * np.minimum(n[i], n[others]) >= t * np.maximum(n[i], n[others])]
        far = np.bitwise_count(self.sketch[others] ^ self.sketch[i]).sum(1, dtype=np.int64)
        others = others[far * (100 + t) <= (n[i] + n[others]) * (100 - t)]
        if not len(others):
            return others
        own = self.item[self.edge[i] : self.edge[i + 1]]
        self.mark[own] = 1
        size = n[others]
        at = np.repeat(self.edge[others] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        common = np.add.reduceat(self.mark[self.item[at]], np.cumsum(size) - size)
        self.mark[own] = 0
        return others[100 * common >= t * (n[i] + size - common)]


def _tiles(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """(group, bucket, i, j, other, node, ..., items): every node of a bucket in each tile of its block with another, or with itself (i = j).

    Tiles are dealt before the sets join them, so a set is shuffled once (not at all while the tiles' rows are few
    enough to be broadcast) and then once for each of its tiles.
    """
    blocks = buckets.groupBy("bucket").agg(F.ceil(F.sum("n") * 8 / BLOCK_BYTES).cast("int").alias("blocks"), F.sum("n").alias("sum"), F.count("*").alias("__m")).where("__m > 1")
    blocks = stored(blocks, "blocks")
    total, n_rows = blocks.agg(F.sum(F.col("sum") * F.col("blocks")), F.sum(F.col("__m") * F.col("blocks"))).first()
    groups = max(1, math.ceil(8 * (total or 0) / TILES_BYTES))
    rows = buckets.drop("n").join(blocks.select("bucket", "blocks"), "bucket")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with")).withColumn("other", F.col("own") > F.col("with"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(groups))).drop("blocks", "own", "with")
    return sets.join(F.broadcast(rows) if (n_rows or 0) <= MOST_BROADCAST else rows, "node")


def _compared(frame: pd.DataFrame, percent: int) -> Iterator[tuple[pd.DataFrame, Iterator[tuple[int, np.ndarray]]]]:
    """Each tile of a group: its rows, and (row, rows that link with it) for each."""
    for _, rows in frame.groupby(["bucket", "i", "j"], sort=False):
        rows = rows.drop_duplicates("node").sort_values("other", kind="stable").reset_index(drop=True)
        tile, cut = Tile(rows["items"].tolist(), percent), int((~rows["other"]).sum())
        same = rows["i"].iloc[0] == rows["j"].iloc[0]
        yield rows, ((i, tile.linked(i, np.arange(i + 1 if same else cut, len(rows)))) for i in range(cut))


def _forest(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of nodes that share a bucket: of each tile's links, a forest that connects as much."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), np.int64)]
        for rows, found in _compared(frame, percent):
            node, root = rows["node"].to_numpy(), np.arange(len(rows))
            for i, others in found:
                _, one = np.unique(root[others], return_index=True)
                one = others[one][root[others[one]] != root[i]]
                out.append(np.stack([np.full(len(one), node[i]), node[one]], 1))
                root[np.isin(root, root[one])] = root[i]
        edges = np.concatenate(out)
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    return _tiles(buckets, sets).groupBy("group").applyInPandas(groupwise(run), "a long, b long")


def _counted(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, links): for each node of members (bucket, node, copies), the copies of the nodes of its bucket that it links with."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})]
        for rows, found in _compared(frame, percent):
            copies, links = rows["copies"].to_numpy(), np.zeros(len(rows), np.int64)
            for i, others in found:
                links[i] += copies[others].sum()
                links[others] += copies[i]
            out.append(pd.DataFrame({"node": rows["node"], "links": links}))
        return pd.concat(out)

    return _tiles(members, sets).groupBy("group").applyInPandas(groupwise(run), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links reach, its own included), n_rows of the component, n_links of the row.

    Two rows link if 100 * |common shingles| >= percent * |all their shingles|; no link between different sets is
    lost (shingles are told apart by 64-bit hashes; below a percent of about 62, a sketch can have fewer chunks than
    the difference allowed, and a link is lost if by chance every chunk of a set is shared with shingles of the other).
    Null and empty texts have empty sets and link with nothing. Repeated rows link with each other. A null id is never
    a component's smallest unless all are null. Columns besides id and text aren't read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    with batch_rows(spark, BATCH_ROWS):
        shared = stored(_shared_contents(rows, shingle, percent, max(64, math.ceil(total / 8 / GROUP))).distinct(), "shared")
        buckets = stored(_buckets(shared), "buckets")
        found = stored(_with_sets(rows, buckets.select("node").distinct(), shingle), "sets")
        sets = stored(found.where("items is not null").groupBy("node").agg(F.min("items").alias("items")), "sets")
        links = stored(_forest(buckets, sets, percent), "links")
        labels = components(links)
        copies = found.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.min("n").alias("n"))
        copies = copies.join(labels, "node", "left").where("label is not null or copies > 1")
        copies = stored(copies.withColumn("bucket", F.coalesce("label", "node")).drop("label"), "members")
        counted = _counted(copies.drop("least"), sets, percent)
        whole = copies.groupBy("bucket").agg(F.min("least").alias("least"), F.sum("copies").alias("n_rows"))
        members = copies.drop("least", "n").join(whole, "bucket").join(counted, "node", "left")
        members = stored(members.select("node", "least", "n_rows", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "members")
        nodes = stored(found.select("id", "n", "node"), "nodes")
    discard(shared, buckets, found, sets, links, labels, copies)
    out = nodes.join(members, "node", "left")
    alone = F.col("n_rows").isNull()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("least")).alias("component_id"), F.coalesce("n_rows", F.lit(1)).alias("n_rows"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """docs but for the rows of the ids in gone (__id).

    A filter of FILTER_BITS at most tells rows that surely stay, which aren't shuffled; the rest is joined with the ids.
    """
    size = _filter_size(gone.count())
    place = lambda key: F.xxhash64(key).bitwiseAND(F.lit(size - 1)) + 1
    bits = gone.groupBy(F.bitmap_bucket_number(place("__id")).alias("__k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place("__id"))).alias("__bits"))
    at = F.bitmap_bit_position(place(id_col))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    marked = docs.join(F.broadcast(bits), F.bitmap_bucket_number(place(id_col)) == F.col("__k"), "left").withColumn("__maybe", maybe).drop("__k", "__bits")
    rest = marked.where("__maybe").join(gone, F.col(id_col) == F.col("__id"), "left_anti")
    return marked.where("not __maybe").unionByName(rest).drop("__maybe")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each component, the one of the smallest id; all columns are kept.

    Texts without words are in no component and stay. Rows of one id are one document: if it stays, its first row
    by text hash does. Rows without an id can't be told apart and stay. An empty table stays empty.
    """
    found = jaccard_components(docs, id_col, text_col, **options).where(F.col(id_col).isNotNull())
    stays = F.count_if(F.col(id_col) == F.col("component_id"))
    ids = stored(found.groupBy(F.col(id_col).alias("__id")).agg(stays.alias("__stays")), "ids")
    gone = ids.where("__stays = 0").select("__id")
    out = _without(docs, id_col, gone)
    if ids.where("__stays > 1").isEmpty():
        return out
    nth = F.row_number().over(W.partitionBy(id_col, F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())).orderBy(F.xxhash64(text_col)))
    return out.withColumn("__nth", nth).where("__nth = 1").drop("__nth")
