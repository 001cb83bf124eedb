"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds.

A vector, less the mean, is padded with zeros to PAD times its dimension, turned by a random rotation and kept as
the signs of its components, packed, with its length and the cosine between it and its code. From these an inner
product with a query is estimated without bias, with an error that stays within EPSILON standard deviations (which
fall with the root of the number of bits). In a tile of queries and candidates, a query's best estimates are reranked
by exact double-precision products, and then all others whose upper bound reaches the k-th best exact one. Every
candidate meets every query in some tile; tiles are bounded in size, and their results merge by score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored
from .textkit import batchwise

EPSILON = 2.0
PAD = 4
#: Candidates per query whose estimates are best that are reranked at first, as a multiple of k.
AT_FIRST = 2
#: Least and most candidates and queries of a tile.
CANDIDATES, QUERIES = (2048, 32768), (256, 8192)
#: Products estimated at once in a task.
AT_ONCE = 1 << 22


def rotation(dim: int, seed: int = 1) -> np.ndarray:
    """The columns of a random rotation that meet the components of a vector of `dim`; the padding's aren't needed."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((PAD * dim, dim)))
    return q * np.sign(np.diag(r))


def lengths(x: np.ndarray) -> np.ndarray:
    """Lengths of rows of any finite size."""
    most = np.maximum(np.abs(x).max(1, initial=0), 1e-300)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def encode(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, length from the mean, and cosine with the code, of each vector."""
    off = vectors - mean
    length = lengths(off)
    turned = (off / np.maximum(length, 1e-300)[:, None]) @ turn.T
    return np.packbits(turned > 0, axis=1), length, np.maximum(np.abs(turned).sum(1) / np.sqrt(len(turn)), 1e-9)


def estimates(queries: np.ndarray, codes: np.ndarray, length: np.ndarray, cosine: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries with coded vectors, and the standard deviations of their errors.

    Both are for queries of length 1, so that they keep their order whatever the lengths; only products of unit
    vectors are of single precision.
    """
    dim = len(turn)
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    unit = queries / lengths(queries)[:, None]
    est = ((unit @ turn.T).astype(np.float32) @ signs.T).astype(np.float64)
    est *= length / (cosine * np.sqrt(dim))
    est += (unit @ mean)[:, None]
    spread = length * np.sqrt(np.maximum(1 - cosine**2, 0)) / cosine / np.sqrt(max(1, dim - 1))
    return est, spread


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 1) -> tuple[DataFrame, dict]:
    """Every usable vector with its code (id, vector bytes, code, length, cosine), and what codes are read with.

    Vectors that are null, zero, hold a null or non-finite component, have no id, or aren't of the commonest
    dimension take no part. Rows of one id count once (the smallest vector). Mean and count cover all of them.
    """
    parts = F.col(vec_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & parts.isNotNull() & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(parts, lambda x: x != 0)
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), parts.alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    rows = stored(rows, "vectors")
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim, n = (sizes[0]["dim"], sizes[0]["count"]) if sizes else (1, 0)
    rows = rows.where(F.size("v") == dim)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim)
        for b in batches:
            total += b.column(0).flatten().to_numpy().reshape(-1, dim).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(total)], names=["i", "s"])

    mean = np.zeros(dim)
    for r in rows.select("v").mapInArrow(batchwise(sums), "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # a row per dimension
        mean[r["i"]] = float(f"{r['s']:.9e}")  # alike in whatever order the tasks' sums come
    how = {"mean": mean / max(1, n), "turn": rotation(dim, seed), "dim": dim, "n": n}
    shipped = vectors.sparkSession.sparkContext.broadcast(how)  # one vector and one rotation

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten().to_numpy().reshape(-1, dim)
            codes, length, cosine = encode(v, shipped.value["mean"], shipped.value["turn"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v]), pa.array([x.tobytes() for x in codes]), pa.array(length), pa.array(cosine)], names=["id", "v", "code", "length", "cosine"])

    return stored(rows.mapInArrow(batchwise(code), "id long, v binary, code binary, length double, cosine double"), "codes"), how


def _floats(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def _products(q: np.ndarray, c: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs, each summed alike wherever it stands."""
    return np.concatenate([(q[row[a : a + 65536]] * c[col[a : a + 65536]]).sum(1) for a in range(0, len(row), 65536)] or [np.zeros(0)])


def search_tile(queries: pd.DataFrame, found: pd.DataFrame, how: dict, k: int, epsilon: float) -> pd.DataFrame:
    """The k best candidates of each query in a tile, by exact score, then id; a query's own id is left out."""
    dim = how["dim"]
    found = found.sort_values("id")
    # Of equal vectors only the k+1 smallest ids can be among the k best (one of them may be the query).
    found = found[found.groupby("v").cumcount() <= k]
    c, ids = _floats(found["v"], dim), found["id"].to_numpy()
    codes = np.frombuffer(b"".join(found["code"]), np.uint8).reshape(len(found), -1)
    length, cosine = found["length"].to_numpy(), found["cosine"].to_numpy()
    out = []
    q_all, q_ids = _floats(queries["v"], dim), queries["id"].to_numpy()
    step = max(1, AT_ONCE // max(1, len(found)))
    for lo in range(0, len(q_all), step):
        q, own = q_all[lo : lo + step], q_ids[lo : lo + step]
        est, spread = estimates(q, codes, length, cosine, how["mean"], how["turn"])
        self_at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        mine = ids[self_at] == own
        est[np.flatnonzero(mine), self_at[mine]] = -np.inf
        first = min(AT_FIRST * k, len(ids) - 1)
        if first >= k:
            row = np.repeat(np.arange(len(q)), first)
            col = np.argpartition(est, len(ids) - first, axis=1)[:, len(ids) - first :].ravel()
            score = _products(q, c, row, col).reshape(len(q), first)
            floor = np.partition(score, first - k, axis=1)[:, first - k] / lengths(q)
            slack = 1e-5 * (length + lengths(how["mean"][None, :]))  # of single precision
            est += epsilon * spread + slack
            row, col = np.nonzero((est >= floor[:, None]) & (est > -np.inf))
        else:
            row, col = np.nonzero(est > -np.inf)
        score = _products(q, c, row, col)
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        best = nth < k
        out.append(pd.DataFrame({"query_id": own[row[best]], "vec_id": ids[col[best]], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def _block(n: int, share: int, bounds: tuple[int, int]) -> int:
    """Blocks for n rows: about `share` of them, each within bounds."""
    return max(1, -(-n // min(max(n // share, bounds[0]), bounds[1])))


def search(index: DataFrame, how: dict, is_query: Column, k: int = 20, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other vectors for each indexed vector that is_query (of `id`) holds for.

    Equal scores rank by smaller vec_id. With fewer than k other vectors all are given; an empty index gives no rows.
    """
    n_query = index.where(is_query).count()
    across, down = _block(how["n"], 6, CANDIDATES), _block(n_query, 6, QUERIES)
    shipped = index.sparkSession.sparkContext.broadcast(how)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    queries = index.where(is_query).select("id", "v", block(down).alias("down"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("across"))
    found = index.select("id", "v", "code", "length", "cosine", block(across).alias("across"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("down"))

    def tile(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_tile(q, c, shipped.value, k, epsilon)

    best = queries.groupBy("down", "across").cogroup(found.groupBy("down", "across")).applyInPandas(tile, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
