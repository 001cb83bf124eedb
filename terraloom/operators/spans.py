"""Interval merging and carry-forward over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_spans(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Spans of each key that touch, or are within `gap`, become one; n_merged counts them."""
    by = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    marked = marked.withColumn("__island", F.sum("__new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("__island")


def keyword_windows(df: DataFrame, keys: list[str], text: str, words: list[str], before: int, after: int) -> DataFrame:
    """Merged windows of text around each occurrence of the words (lower-cased), with their text."""
    low = F.lower(F.col(text))
    hits = F.flatten(F.array(*[_places(low, w) for w in words]))
    rows = df.select(*keys, F.length(text).alias("__n"), F.explode(hits).alias("__at"))
    rows = rows.select(*keys, F.greatest(F.lit(0), F.col("__at") - before).alias("start"), F.least(F.col("__n"), F.col("__at") + after).alias("end"))
    return merge_spans(rows, keys, "start", "end")


def _places(text: Column, word: str) -> Column:
    """Places (from 0) of a fixed word, without overlaps, from the lengths of what lies between."""
    pieces = F.split(text, F.lit(word))
    lengths = F.transform(pieces, lambda p: F.length(p))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    found = F.aggregate(F.slice(lengths, 1, F.greatest(F.size(lengths) - 1, F.lit(0))), start, lambda a, n: F.struct((a["at"] + n + len(word)).alias("at"), F.concat(a["out"], F.array(a["at"] + n)).alias("out")))
    return found["out"]


def carry_forward(df: DataFrame, keys: list[str], value: str, *order: Column) -> DataFrame:
    """The last value that isn't null at or before each row."""
    return df.withColumn(value, F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
