"""Mixing sources to target weights: repetition rates per source, floor(rate) copies and one Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored

#: A source table of at most this many rows is broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Per source: its size, target and rate. `sized` has columns source and size.

    Sources in code point order, null last, take the weights in turn. Together the targets equal the size of
    everything. A target stops at `cap` times its source's size, and what it can't take goes to the others by
    weight. Sources by ascending cap/weight are capped as long as the level that is left reaches their cap, so
    one running sum over the sources (not over documents) finds the level. A source without words gets rate 0.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    each = each.withColumn("most", F.col("source_size") * cap).withColumn("reach", F.col("most") / F.col("weight"))
    order = W.orderBy("reach", F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    everything = W.partitionBy()
    each = each.withColumn("total", F.sum("source_size").over(everything))
    each = each.withColumn("capped", F.col("reach") <= (F.col("total") - before) / after)
    held = F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0)).over(everything)
    free = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("weight") * ((F.col("total") - held) / free))
    each = each.withColumn("target", F.round(target, 6))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    return each.select("source", "source_size", "target", rate.alias("rate"))


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: int = 17) -> DataFrame:
    """The rows of docs with struct column `mix` (size, source_size, target, rate, copies).

    Null or empty texts have size 0, null sources form one source, and an empty table gives an empty plan.
    Repeated rows are rows of their own; those that agree in id and size get the same draw, so reruns agree.
    Other columns are kept; one named `mix` is replaced.
    """
    sized = docs.select(F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"))
    targets = stored(source_targets(sized, weights, cap), "mix")
    per = targets.select(F.struct(*targets.columns).alias("__mix_source"))
    if targets.count() <= MOST_BROADCAST:
        per = F.broadcast(per)
    rows = docs.drop("mix").withColumn("__mix_size", size_of(F.col(text_col)))
    rows = rows.join(per, rows[source_col].cast("string").eqNullSafe(F.col("__mix_source.source")), "left")
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("__mix_size").cast("string"))
    draw = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / float(2**48)
    whole = F.floor("__mix_source.rate")
    copies = (whole + F.when(draw < F.col("__mix_source.rate") - whole, 1).otherwise(0)).cast("int")
    mix = F.struct(F.col("__mix_size").alias("size"), "__mix_source.source_size", "__mix_source.target", "__mix_source.rate", copies.alias("copies"))
    return rows.withColumn("mix", mix).drop("__mix_size", "__mix_source")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row as often as its plan says, with the columns of docs. A column `mix` is dropped."""
    planned = mixing_plan(docs, **options).where("mix.copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("mix.copies")))
    return planned.withColumn("__mix_copy", copies).drop("__mix_copy", "mix")
