"""Keyed writes as pure table transformations: the result is the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key (null keys equal each other)."""
    both = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__nth", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("__batch")))).where("__nth = 1").drop("__nth", "__batch")


def upsert_coalescing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """As upsert, but a new null leaves the old value."""
    rest = [c for c in old.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in rest])
    return old.join(renamed, keys, "full").select(*keys, *[F.coalesce(f"__new_{c}", c).alias(c) for c in rest])


def insert_ignoring(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only new rows of unknown keys are added; `inserted` says which rows those are."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.withColumn("inserted", F.lit(False)).unionByName(fresh.withColumn("inserted", F.lit(True)))


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """All old rows of a scope that new rows have are deleted, then the new rows are added."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new)
