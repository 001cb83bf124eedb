"""Connected components by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the same within a component only.

    In each round every node takes the least of itself and its neighbours as its parent, edges move to the
    parents, and those within one parent vanish. Rounds grow with the logarithm of the longest chain of copies.
    """
    left = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not left.isEmpty():
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = stored(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent")), "parents")
        if labels is None:
            named = parents.select("node", F.col("parent").alias("label"))
        else:
            up = parents.select(F.col("node").alias("label"), "parent")
            named = labels.join(up, "label", "left").select("node", F.coalesce("parent", "label").alias("label"))
        named = stored(named, "labels")
        moved = left.join(parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a").join(parents.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        moved = stored(moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        discard(left, parents, *([labels] if labels is not None else []))
        left, labels = moved, named
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("label"))
