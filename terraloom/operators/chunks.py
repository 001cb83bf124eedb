"""Chunking with a fold, balanced JSON and name similarity: what built-in functions can't express."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import alike


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings; null if either is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


#: Names in a tile of each side: what one task row holds at most, about. Code points in a tile at most, about.
TILES, TILE_SIZE = (2000, 200_000), 8_000_000
#: Names that walk down a tree together.
TOGETHER = 256


def most_similar(a: DataFrame, b: DataFrame, least: float, tiles: tuple[int, int] = TILES) -> DataFrame:
    """(a, b, ratio): for each name the most similar of all others at a Ratcliff-Obershelp ratio of `least` or more.

    Every tile of a meets every tile of b, whose names are a tree that bounds a ratio for all names of a prefix at once
    (see `alike.NameTree`); names whose bound is below the best ratio found aren't met. So work is far below the product
    of both where names share prefixes, and a part of it where they don't. Ties in six decimals go to the smaller b.
    Nulls match nothing; repeated names count once.
    """
    workers = a.sparkSession.sparkContext.defaultParallelism

    def tiled(df: DataFrame, most: int, name: str, wanted: int) -> tuple[DataFrame, int]:
        names = df.select(F.col(df.columns[0]).alias("name")).where("name is not null").distinct()
        count, size = names.agg(F.count("*"), F.coalesce(F.sum(F.length("name")), F.lit(0))).first()
        n = max(1, -(-count // most), -(-size // TILE_SIZE), min(wanted, count // TOGETHER))
        return names.groupBy(F.pmod(F.xxhash64("name"), F.lit(n)).alias("tile")).agg(F.collect_list("name").alias(name)).drop("tile"), n

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, others = (batch.column(c)[i].values.to_pylist() for c in ("own", "others"))
                tree = alike.NameTree(others)
                for at in range(0, len(own), TOGETHER):
                    yield pa.RecordBatch.from_pylist([{"a": x, "b": y, "ratio": r} for x, y, r in tree.best(own[at : at + TOGETHER], least)], schema=found_schema)

    found_schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("ratio", pa.float64())])
    (own, n), (others, m) = tiled(a, tiles[0], "own", 2 * workers), tiled(b, tiles[1], "others", 1)
    pairs = own.crossJoin(others).repartition(min(n * m, 10_000))  # a tree at a time, mostly
    found = pairs.mapInArrow(compare, "a string, b string, ratio double").withColumn("ratio", F.round("ratio", 6))
    best = F.min(F.struct((-F.col("ratio")).alias("less"), "b")).alias("best")
    return found.groupBy("a").agg(best).select("a", "best.b", (-F.col("best.less")).alias("ratio"))


@F.pandas_udf(T.StringType())
def last_json_object(text: pd.Series) -> pd.Series:
    """The last balanced {...} of a text, braces in quoted strings aside; null if there is none."""

    def last(s: str | None) -> str | None:
        best, depth, start, quoted, skip = None, 0, 0, False, False
        for i, c in enumerate(s or ""):
            if skip:
                skip = False
            elif quoted:
                quoted, skip = c != '"', c == "\\"
            elif c == '"' and depth:
                quoted = True
            elif c == "{":
                start = i if not depth else start
                depth += 1
            elif c == "}" and depth:
                depth -= 1
                if not depth:
                    best = s[start : i + 1]
        return best

    return text.map(last)


def chunked(blocks: DataFrame, keys: list[str], order: str, heading: str, text: str, most: int, least: int) -> DataFrame:
    """Blocks of each key, in order, joined until the heading changes or `most` characters are passed; short chunks are dropped."""
    one = F.struct(F.col(order).alias("o"), F.col(heading).alias("heading"), F.col(text).alias("text"))
    return chunked_blocks(blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("blocks")), keys, "blocks", most, least)


def chunked_blocks(rows: DataFrame, keys: list[str], blocks: str, most: int, least: int) -> DataFrame:
    """The same where a row has all blocks (heading, text) of its keys, in order: texts stay where they are. Null blocks make no chunk."""

    def fold(headings: list[str | None], texts: list[str]) -> list[dict]:
        out, now, size, head = [], [], 0, None
        for h, t in zip(headings, texts, strict=True):
            if now and (h != head or size + len(t) > most):
                out.append((head, "\n".join(now)))
                now, size = [], 0
            head = h
            now.append(t)
            size += len(t)
        if now:
            out.append((head, "\n".join(now)))
        kept = [x for x in out if len(x[1]) >= least]
        return [{"chunk_no": i, "heading": h, "chunk": t} for i, (h, t) in enumerate(kept)]

    @F.pandas_udf("array<struct<chunk_no: int, heading: string, chunk: string>>")
    def folded(headings: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[] if h is None else fold(h, t) for h, t in zip(headings, texts, strict=True)])

    found = rows.select(*keys, F.explode(folded(F.col(f"{blocks}.heading"), F.col(f"{blocks}.text"))).alias("c"))
    return found.select(*keys, "c.chunk_no", "c.heading", "c.chunk")
