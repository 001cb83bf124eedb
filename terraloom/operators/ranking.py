"""Ranks, percentiles, ordered choices and dedup with every tie decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order given; the order must decide ties."""
    return df.withColumn("__nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")


def top_per_key(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def _in_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with __range: sorted ranges of (keys, order), as many as shuffle partitions, however many rows a key has.

    The rows are written, since a range must stay the same for all that is counted in it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(parts, *keys, *order).withColumn("__range", F.spark_partition_id()))


def _offsets(ranged: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """keys, __range, __before (of the ranges before) and __total: a row a range and key, so a key's window has as many rows as ranges."""
    sums = ranged.groupBy(*keys, "__range").agg(F.sum(size).alias("__size"))
    by = W.partitionBy(*keys)
    before = F.coalesce(F.sum("__size").over(by.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sums.select(*keys, "__range", before.alias("__before"), F.sum("__size").over(by).alias("__total"))


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, below, equal, total of each value that isn't null: how many rows of its key are smaller, equal, and in all.

    Equal values are counted first. Then ranges of values are summed up, so that no task sorts a whole key.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("equal"))
    ranged = _in_ranges(counts, keys, [value])
    inside = F.coalesce(F.sum("equal").over(W.partitionBy(*keys, "__range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = ranged.withColumn("below", inside).join(_offsets(ranged, keys, F.col("equal")), [*keys, "__range"])
    return out.select(*keys, value, (F.col("below") + F.col("__before")).alias("below"), "equal", F.col("__total").alias("total"))


def ranks_among(queries: DataFrame, df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """queries with below, equal and total: where their value stands among the values of df with the same keys.

    Queries take part in the ranges as rows that count nothing, so no distribution is held in one place. Queries without a
    value or whose keys df lacks have nulls.
    """
    asked = queries.select(*keys, value).where(F.col(value).isNotNull()).distinct().select(*keys, value, F.lit(0).cast("long").alias("equal"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("equal"))
    both = counts.unionByName(asked).groupBy(*keys, value).agg(F.sum("equal").alias("equal"))
    ranged = _in_ranges(both, keys, [value])
    inside = F.coalesce(F.sum("equal").over(W.partitionBy(*keys, "__range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = ranged.withColumn("below", inside).join(_offsets(ranged, keys, F.col("equal")), [*keys, "__range"]).where(F.col("__total") > 0)
    ranks = out.select(*keys, value, (F.col("below") + F.col("__before")).alias("below"), "equal", F.col("__total").alias("total"))
    return queries.join(ranks, [*keys, value], "left")


def positions(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with `position` (from 0) and `total` in its key by the order, which must decide ties; keys and order without nulls."""
    ranged = _in_ranges(df, keys, order)
    inside = F.row_number().over(W.partitionBy(*keys, "__range").orderBy(*order)) - 1
    out = ranged.withColumn("position", inside).join(_offsets(ranged, keys, F.lit(1)), [*keys, "__range"])
    return out.withColumn("position", F.col("position") + F.col("__before")).withColumn("total", F.col("__total")).drop("__range", "__before", "__total")


def midrank_percentile(df: DataFrame, keys: list[str], value: str, out: str = "percentile") -> DataFrame:
    """100 * (below + half of the equal ones) / n within the keys; rows without a value are left out."""
    pct = 100 * (F.col("below") + F.col("equal") / 2) / F.col("total")
    return df.join(value_ranks(df, keys, value).select(*keys, value, pct.alias(out)), [*keys, value])


def inclusive_percentile(df: DataFrame, keys: list[str], value: str, out: str = "percentile") -> DataFrame:
    """100 * (below and equal ones) / n within the keys; rows without a value are left out."""
    pct = 100 * (F.col("below") + F.col("equal")) / F.col("total")
    return df.join(value_ranks(df, keys, value).select(*keys, value, pct.alias(out)), [*keys, value])


def with_average_rank(df: DataFrame, keys: list[str], value: str, out: str, of: str | None = None) -> DataFrame:
    """Rank where equal values share the mean of their places, and the key's number of rows as `of`; rows without a value are left out."""
    rank = F.col("below") + (F.col("equal") + 1) / 2
    return df.join(value_ranks(df, keys, value).select(*keys, value, rank.alias(out), *([F.col("total").alias(of)] if of else [])), [*keys, value])


def _both_ranks(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return with_average_rank(with_average_rank(both, keys, a, "__a", "__n"), keys, b, "__b")


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation per key with n; null below 3 rows or without variance."""
    out = _both_ranks(df, keys, a, b).groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop("__a", "__b").alias("__c"), F.stddev_pop("__a").alias("__sa"), F.stddev_pop("__b").alias("__sb"))
    return out.select(*keys, "n", F.when(F.col("n") >= 3, F.try_divide(F.col("__c"), F.col("__sa") * F.col("__sb"))).alias("rho"))


def percentile_error(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Mean absolute difference of percentile ranks per key."""
    gap = F.abs(F.col("__a") / F.col("__n") - F.col("__b") / F.col("__n"))
    return _both_ranks(df, keys, a, b).groupBy(*keys).agg(F.avg(gap).alias("mae"))


def medians_without_own(df: DataFrame, key: str, name: str, value: str, unique: str, owners: DataFrame) -> DataFrame:
    """owners (key, name and other columns) with n_others, n_valued and middle: rows of their key with another name, those with a value, and their median.

    Values are numbered in order. An owner's rows are taken out of that numbering, which moves the middle by a place for
    each of them below it; so an owner meets its own rows and two values, never all rows of its key. Null values count in
    n_others alone. `name` and `key` of df and owners aren't null; an owner without others has 0 and null.
    """
    ordered = checkpointed(positions(df.where(F.col(value).isNotNull()).select(key, name, value, unique), [key], [value, unique]))
    own = ordered.groupBy(key, name).agg(F.array_sort(F.collect_list("position")).alias("__own"))  # rows of one name
    rows = df.groupBy(key, name).agg(F.count("*").alias("__mine"))
    sizes = rows.groupBy(key).agg(F.sum("__mine").alias("__all"))
    valued = ordered.groupBy(key).agg(F.count("*").alias("__valued"))
    out = owners.join(rows, [key, name], "left").join(own, [key, name], "left").join(sizes, key, "left").join(valued, key, "left")
    out = out.withColumn("__own", F.coalesce("__own", F.array().cast("array<long>"))).withColumn("n_others", F.coalesce(F.col("__all") - F.coalesce("__mine", F.lit(0)), F.lit(0)))
    left = F.coalesce(F.col("__valued"), F.lit(0)) - F.size("__own")
    moved = lambda at: F.when(left > 0, F.aggregate("__own", at.cast("long"), lambda p, q: F.when(q <= p, p + 1).otherwise(p)))
    out = out.withColumn("__low", moved(F.floor((left - 1) / 2))).withColumn("__high", moved(F.floor(left / 2)))
    at = lambda n: ordered.select(key, F.col("position").alias(n), F.col(value).alias(n + "_value"))
    out = out.join(at("__low"), [key, "__low"], "left").join(at("__high"), [key, "__high"], "left")
    return out.withColumn("n_valued", left).withColumn("middle", (F.col("__low_value") + F.col("__high_value")) / 2).drop("__own", "__mine", "__all", "__valued", "__low", "__high", "__low_value", "__high_value")


def prefix_within(df: DataFrame, keys: list[str], size: str, budget: float, *order: Column) -> DataFrame:
    """Rows before the first that overflows the budget."""
    total = F.sum(size).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumn("__total", total).where(F.col("__total") <= budget).drop("__total")


def budgeted(df: DataFrame, keys: list[str], size: str, budget: int, order: list[Column], enough: float = 0.9) -> DataFrame:
    """Greedy choice in an order: a row that doesn't fit is skipped, and the choice ends once `enough` is used.

    The rows of a key are folded over a sorted array, so a key must be a bounded thing such as a document's blocks.
    `order` are columns that sort ascending; all columns come back, with `chosen`.
    """
    one = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(size).cast("long").alias("size"), F.struct(*df.columns).alias("row"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("taken"))

    def step(acc, x):
        fits = (acc["used"] < enough * budget) & (acc["used"] + x["size"] <= budget)
        return F.struct((acc["used"] + F.when(fits, x["size"]).otherwise(0)).alias("used"), F.concat(acc["taken"], F.array(fits)).alias("taken"))

    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("rows"))
    rows = rows.withColumn("taken", F.aggregate("rows", start, step)["taken"])
    return rows.select(F.explode(F.arrays_zip("rows", "taken")).alias("x")).select("x.rows.row.*", F.col("x.taken").alias("chosen"))
