"""Token-ID output: sorted shards of raw ids, each with a minimal perfect hash from document keys to offsets.

A shard file is: ids (uint16, or uint32 for a large vocabulary), then the index arrays, then a JSON footer with
their places, its length (8 bytes) and a magic of 8 bytes. The index has, per slot of the perfect hash, a 32-bit
fingerprint of the key and its first record, and per record its first id. Records stand in ascending key order.
Files are written through pyarrow's file systems into the shared folder under names of their own, so a repeated
or speculative task never touches the file of another attempt; the manifest names those that count.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .mph import PerfectHash
from .shared import batch_rows, new_path, stored
from .textkit import batchwise, groupwise

MAGIC = b"TLTOKEN1"
#: Bytes of text that go to one shard, about.
SHARD_BYTES = 32 << 20
#: Bytes of text that a task encodes at once, about.
GROUP_BYTES = 3 << 20
#: Bytes of pieces and their ids that a task keeps from one group to the next: a piece that is there isn't encoded again.
MET_BYTES = 12 << 20

_TURN = re.compile(r"(?<=\S)(?= )")
#: A class of all white space.
_BLANK = "[" + "".join(rf"\x{{{i:x}}}" for i in range(0x3001) if chr(i).isspace()) + "]"
#: A piece that ends with a letter before a sign or digit, and what follows.
_CUT = r"(?s)^(?P<head>.*?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])(?P<tail>[\x00-\x40\x5B-\x60\x7B-\x7F].*)$"

#: Rows of an Arrow batch while shards are written.
BATCH_ROWS = 2000
#: How a byte-level vocabulary shows a space.
SPACE = "\u0120"


class Encoder:
    """A byte-level BPE of the tokenizers library that encodes each different piece of many texts once, as far as it keeps them.

    The vocabulary's pattern never joins a non-space with a space after it, nor a letter with a sign or digit of
    ASCII after it, nor looks behind. So a text may be cut before each space that follows a non-space, and a piece
    after its first letter before a sign or digit, unless it has one of the vocabulary's added tokens (they have no
    spaces): the ids of all parts, concatenated, are the text's ids. Pieces are kept without the space that leads them.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.leads = np.zeros(self.size, bool)  # ids that begin with a space
        self.leads[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(SPACE)]] = True
        self._forget()

    def _forget(self) -> None:
        self.met, self.met_ids = pa.array([], pa.string()), _lists(np.zeros(0, self.dtype), np.zeros(0, np.int64))

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        each = [np.array(e.ids, self.dtype) for lo in range(0, len(texts), 200) for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 200], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, self.dtype), *each]), np.array([len(e) for e in each], np.int64)

    def _alone(self, texts: pa.Array) -> pa.Array:
        """A list of ids for each text, as it stands."""
        return _lists(*self._encoded(texts.to_pylist()))

    def _spaced(self, words: pa.Array) -> pa.Array:
        """A list of ids for each different word with a space before it.

        Words that have no space and end with none are encoded many at a time as one text: only a word's first
        id has the space. Others are texts of their own.
        """
        odd = pc.match_substring_regex(words, f" |{_BLANK}$|^$")
        plain = words.filter(pc.invert(odd)).to_pylist()
        ids = self._encoded([" " + " ".join(plain[lo : lo + 100]) for lo in range(0, len(plain), 100)])[0]
        begin = np.flatnonzero(self.leads[ids])
        if len(begin) != len(plain):
            raise ValueError("the vocabulary cuts words otherwise than by spaces")
        found = _lists(ids, np.diff(np.append(begin, len(ids))))
        return _in_place(found, self._alone(pc.binary_join_element_wise("", words.filter(odd), " ")), odd)

    def _led(self, pieces: pa.Array) -> pa.Array:
        """A list of ids for each different piece with a space before it."""
        whole = pc.utf8_is_alpha(pieces)
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(pieces, token))
        rest = pieces.filter(pc.invert(whole))
        cut = pc.extract_regex(rest, _CUT)
        heads = pc.coalesce(pc.struct_field(cut, "head"), rest)
        tails = pc.fill_null(pc.struct_field(cut, "tail"), "").dictionary_encode()
        words = _in_place(pieces.filter(whole), heads, pc.invert(whole)).dictionary_encode()
        tail = np.full(len(pieces), -1)
        tail[~whole.to_numpy(zero_copy_only=False)] = tails.indices.to_numpy()
        ids = pa.concat_arrays([self._spaced(words.dictionary), self._alone(tails.dictionary), _lists(np.zeros(0, self.dtype), [0])])
        both = np.stack([words.indices.to_numpy(), np.where(tail < 0, len(ids) - 1, tail + len(words.dictionary))], 1)
        parts = ids.take(pa.array(both.ravel()))
        return pa.ListArray.from_arrays(pa.array(_edges(parts)[::2]), parts.flatten())

    def _once(self, pieces: pa.Array) -> pa.Array:
        """What _led gives, which is asked only for pieces that aren't kept from texts before."""
        at = pc.index_in(pieces, self.met)
        new = pc.is_null(at)
        fresh = pieces.filter(new)
        ids = self._led(fresh)
        out = _in_place(self.met_ids.take(at.drop_null()), ids, new)
        self.met, self.met_ids = pa.concat_arrays([self.met, fresh]), pa.concat_arrays([self.met_ids, ids])
        if self.met.nbytes + self.met_ids.nbytes > MET_BYTES:
            self._forget()
        return out

    def encode(self, texts: list[str] | pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has; end_id is appended to each."""
        pieces = _pieces(pa.array(texts, pa.string()))
        edge = _edges(pieces)
        first = np.zeros(edge[-1], bool)  # no space was cut off before a text's first piece
        first[edge[:-1]] = True
        bare = pieces.flatten().filter(pa.array(first)).dictionary_encode()
        led = pieces.flatten().filter(pa.array(~first)).dictionary_encode()
        del pieces
        number = np.empty(edge[-1], np.int32)
        number[first], number[~first] = bare.indices.to_numpy(), led.indices.to_numpy() + len(bare.dictionary)
        found = pa.concat_arrays([self._alone(bare.dictionary), self._once(led.dictionary)]).take(pa.array(number))
        ids, total = found.flatten().to_numpy(), _edges(found)[edge].astype(np.int64)
        lengths = np.diff(total)
        if end_id is not None:
            ids = np.insert(ids, total[1:], end_id)
            lengths = lengths + 1
        return ids, lengths


def _pieces(texts: pa.Array) -> pa.Array:
    """Each text's pieces, cut before every space that follows a non-space; all but the first without that space."""
    run = pc.match_substring_regex(texts, _BLANK + " ")
    pieces = pc.split_pattern(texts.filter(pc.invert(run)), " ")
    parts = [_TURN.split(t) for t in texts.filter(run).to_pylist()]
    return _in_place(pieces, pa.array([[p[0], *(x[1:] for x in p[1:])] for p in parts], pieces.type), run)


def _in_place(plain: pa.Array, marked: pa.Array, mark: pa.Array) -> pa.Array:
    """One array of both: a marked place gets the next of the marked ones, another the next plain one."""
    if not len(marked):
        return plain
    mark = mark.to_numpy(zero_copy_only=False)
    return pa.concat_arrays([plain, marked]).take(pa.array(np.where(mark, len(plain) + np.cumsum(mark) - 1, np.cumsum(~mark) - 1)))


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(values))


def _edges(lists: pa.Array) -> np.ndarray:
    """Where each list begins among the values of all, and the last one ends."""
    at = lists.offsets.to_numpy()
    return at - at[0] if at[0] else at


def in_groups(batches: Iterable[pa.RecordBatch], size: int = GROUP_BYTES) -> Iterator[tuple[list, pa.Array]]:
    """Keys and texts of rows next to each other, about `size` bytes of them."""
    held: list = []
    n = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 250):
            held.append(batch.slice(lo, 250))
            n += held[-1].nbytes
            if n >= size:
                yield _of_all(held)
                n = 0
    if held:
        yield _of_all(held)


def _of_all(held: list[pa.RecordBatch]) -> tuple[list, pa.Array]:
    """Keys and texts of the batches, which are held no longer."""
    keys = [k for b in held for k in b.column(0).to_pylist()]
    texts = pa.concat_arrays([b.column(1).cast(pa.string()) for b in held])
    held.clear()
    return keys, texts


def key_bytes(key) -> bytes:
    """A document key as bytes: integers as 8 bytes little-endian, null as none, the rest as UTF-8."""
    if key is None or key is pd.NA:
        return b""
    return int(key).to_bytes(8, "little", signed=True) if isinstance(key, (int, np.integer)) else b"s" + str(key).encode()


def key_hashes(keys: Iterable) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes for the perfect hash, and 32-bit fingerprints that don't depend on them."""
    both = [xxhash.xxh3_128_intdigest(key_bytes(k)) for k in keys]
    return np.array([x & (2**64 - 1) for x in both], np.uint64), np.array([x >> 96 for x in both], np.uint32)


def write_shard(folder: str, batches: Iterable[tuple[list, np.ndarray, np.ndarray]], dtype: np.dtype) -> dict:
    """One shard file from (keys, ids, ids per key) in ascending key order; equal keys stand together."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    name = f"shard-{uuid.uuid4().hex}.ids"
    keys: list = []
    lengths = [np.zeros(0, np.int64)]
    with fs.open_output_stream(f"{base}/{name}") as out:
        for some, ids, n in batches:
            out.write(ids.astype(dtype, copy=False).tobytes())
            keys += some
            lengths.append(n)
        n = np.concatenate(lengths)
        distinct = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        hashes, prints = key_hashes(keys[i] for i in distinct)
        found = PerfectHash.build(hashes)
        slot = found.slots(hashes)
        record, fingerprint = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.uint32)
        record[slot], fingerprint[slot] = distinct, prints
        copies = np.zeros(len(distinct), np.int64)
        copies[slot] = np.diff([*distinct, len(keys)])
        arrays = {"starts": np.concatenate([[0], np.cumsum(n)]).astype(np.int64), "bits": found.bits, "sizes": found.sizes, "record": record, "copies": copies, "fingerprint": fingerprint}
        if whole := all(k is None or isinstance(k, int) for k in keys):
            arrays |= {"keys": np.array([k or 0 for k in keys], np.int64), "null": np.array([k is None for k in keys], bool)}
        else:
            arrays |= {"keys": np.frombuffer(json.dumps(keys).encode(), np.uint8)}
        places, at = {}, int(n.sum()) * dtype.itemsize
        for what, a in arrays.items():
            out.write(a.tobytes())
            places[what] = [at, len(a), a.dtype.str]
            at += a.nbytes
        foot = json.dumps({"ids": dtype.str, "n_ids": int(n.sum()), "whole": whole, "arrays": places}).encode()
        out.write(foot + len(foot).to_bytes(8, "little") + MAGIC)
    return {"file": name, "n_docs": len(keys), "n_ids": int(n.sum())}


class Shard:
    """Reads a shard file: only its footer and index at first, ids when asked for."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        n = int.from_bytes(tail[:8], "little")
        self.foot = json.loads(self.file.read_at(n, size - 16 - n))
        self.dtype = np.dtype(self.foot["ids"])
        a = {k: np.frombuffer(self.file.read_at(n * np.dtype(t).itemsize, at), t) for k, (at, n, t) in self.foot["arrays"].items()}
        self.starts, self.record, self.copies, self.fingerprint = a["starts"], a["record"], a["copies"], a["fingerprint"]
        self.hash = PerfectHash(a["bits"], a["sizes"])
        if self.foot["whole"]:
            self.keys = [None if no else k for k, no in zip(a["keys"].tolist(), a["null"].tolist(), strict=True)]
        else:
            self.keys = json.loads(a["keys"].tobytes())

    def find(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """First record (or -1) and number of records of each key, in constant time each."""
        hashes, prints = key_hashes(keys)
        slot = self.hash.slots(hashes)
        there = slot >= 0
        there[there] = self.fingerprint[slot[there]] == prints[there]
        return np.where(there, self.record[np.where(there, slot, 0)], -1) if len(self.record) else slot, np.where(there, self.copies[np.where(there, slot, 0)], 0) if len(self.record) else slot * 0

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of the records first..last-1."""
        lo, hi = int(self.starts[first]), int(self.starts[last])
        return np.frombuffer(self.file.read_at((hi - lo) * self.dtype.itemsize, lo * self.dtype.itemsize), self.dtype)


def write_token_shards(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, shard_bytes: int = SHARD_BYTES, folder: str | None = None) -> DataFrame:
    """Encodes whole texts and writes them in ascending key order; returns the manifest.

    The manifest has a row per shard: shard, folder, file, n_docs, n_ids, start (ids before it), first_key and
    last_key (as strings). A null text is empty and has the end id alone. Repeated keys are records of their own
    next to each other, ordered by text hash; a null key sorts first. Of columns, only key and text are read.
    An empty table gives no shards.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("nth", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards = max(1, -(-total // shard_bytes))
    rows = rows.repartitionByRange(shards, "key", "nth").sortWithinPartitions("key", "nth")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = Encoder(tokenizer)
        ends: list = []

        def encoded():
            for keys, texts in in_groups(batches):
                ends[:] = [ends[0] if ends else keys[0], keys[-1]]
                yield keys, *coder.encode(texts, end_id)

        done = write_shard(folder, encoded(), coder.dtype)
        if done["n_docs"]:
            row = {"shard": TaskContext.get().partitionId(), "folder": folder, **done, "first_key": ends[0], "last_key": ends[1]}
            yield pa.RecordBatch.from_pylist([row | {k: None if row[k] is None else str(row[k]) for k in ("first_key", "last_key")}], schema=_MANIFEST)

    manifest = rows.drop("nth").mapInArrow(batchwise(write), "shard int, folder string, file string, n_docs long, n_ids long, first_key string, last_key string")
    with batch_rows(spark, BATCH_ROWS):
        manifest = stored(manifest, "manifest")
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("start", before)


_MANIFEST = pa.schema([("shard", pa.int32()), ("folder", pa.string()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.string()), ("last_key", pa.string())])


def read_token_shards(manifest: DataFrame, key_type: str = "long") -> DataFrame:
    """Digest of every record: key, shard, record, start, n_tokens, ids_crc32 (of 32-bit ids), read by its key.

    Each key of a file is looked up by the file's perfect hash and fingerprint, and its ids are read at the
    offset found there. A manifest without rows gives none.
    """
    n = max(1, manifest.count())

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                shard = Shard(f"{row.folder}/{row.file}")
                distinct = [k for i, k in enumerate(shard.keys) if i == 0 or k != shard.keys[i - 1]]
                for lo in range(0, len(distinct), 1000):
                    some = distinct[lo : lo + 1000]
                    out = []
                    for key, first, copies in zip(some, *shard.find(some), strict=True):
                        if first < 0:
                            raise ValueError(f"key {key!r} is not in its shard")
                        for r in range(first, first + copies):
                            ids = shard.ids(r, r + 1)
                            out.append((key, row.shard, r, row.start + int(shard.starts[r]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    frame = pd.DataFrame(out, columns=["key", "shard", "record", "start", "n_tokens", "ids_crc32"])
                    yield frame.astype({"key": "Int64"}) if key_type == "long" else frame

    return manifest.repartition(n).mapInPandas(batchwise(read), f"key {key_type}, shard int, record long, start long, n_tokens long, ids_crc32 long")


def lookup_tokens(manifest: DataFrame, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Keyed access: for each integer key its records' start, n_tokens, ids_crc32 and ids; absent keys give no row.

    Keys meet the shards whose key range covers them (a shard's first and last key are in the manifest), and each
    shard answers by its perfect hash and fingerprint. Repeated keys among `keys` are asked for once.
    """
    wanted = keys.select(F.col(id_col).cast("long").alias("key")).distinct()
    bounds = [(r.shard, r.folder, r.file, r.start, r.first_key, r.last_key) for r in manifest.orderBy("shard").collect()]
    low = np.array([-(2**63) if b[4] is None else int(b[4]) for b in bounds], np.int64)
    high = np.array([-(2**63) if b[5] is None else int(b[5]) for b in bounds], np.int64)

    def shard_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            k = part["key"].astype("Int64")
            plain = k.fillna(-(2**63)).to_numpy(np.int64)
            first, last = np.searchsorted(high, plain, "left"), np.searchsorted(low, plain, "right")
            n = np.maximum(last - first, 0)
            at = np.repeat(np.arange(len(plain)), n)
            yield pd.DataFrame({"key": k.iloc[at].to_numpy(), "at": np.repeat(first, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)})

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        number, folder, file, start, _, _ = bounds[int(part["at"].iloc[0])]
        shard = Shard(f"{folder}/{file}")
        asked = [None if pd.isna(k) else int(k) for k in part["key"]]
        out = []
        for k, first, n in zip(asked, *shard.find(asked), strict=True):
            for r in range(first, first + n):
                ids = shard.ids(r, r + 1).astype("<u4")
                out.append((k, number, r, start + int(shard.starts[r]), len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        return pd.DataFrame(out, columns=["key", "shard", "record", "start", "n_tokens", "ids_crc32", "ids"]).astype({"key": "Int64"})

    routed = wanted.mapInPandas(batchwise(shard_of), "key long, at int")
    return routed.groupBy("at").applyInPandas(groupwise(answer), "key long, shard int, record long, start long, n_tokens long, ids_crc32 long, ids array<long>")
