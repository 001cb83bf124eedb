"""Sparse TF-IDF similarity, centroids by fixed-iteration Lloyd steps, and nearest assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def term_weights(docs: DataFrame, key: str, tokens: Column, times: Column | None = None) -> DataFrame:
    """key, term, w: unit TF-IDF weights with smoothed idf ln((1+n)/(1+df))+1; a document stands for `times` equal ones."""
    docs = docs.select(key, tokens.alias("tokens"), (F.lit(1) if times is None else times).alias("times"))
    terms = docs.select(key, "times", F.explode("tokens").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("times").alias("times"))
    n = docs.agg(F.sum("times").alias("n"))  # one row
    df = terms.groupBy("term").agg(F.sum("times").alias("df"))
    raw = terms.join(df, "term").join(F.broadcast(n)).withColumn("raw", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("w"))


def best_cosine(left: DataFrame, right: DataFrame, left_key: str, right_key: str, floor: float) -> DataFrame:
    """The right key of the largest cosine, if it reaches the floor, for each left key; terms are the join key."""
    sims = left.join(right.withColumnRenamed("w", "w2"), "term").groupBy(left_key, right_key).agg(F.sum(F.col("w") * F.col("w2")).alias("cosine")).where(F.col("cosine") >= floor)
    nth = F.row_number().over(W.partitionBy(left_key).orderBy(F.desc(F.round("cosine", 9)), right_key))
    return sims.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


#: Centres that are sent along at once; more go in parts, of which each point keeps its nearest.
MOST_CENTRES = 10_000


def nearest(points: DataFrame, key: str, vector: str, centres: DataFrame) -> DataFrame:
    """centre and distance of each point, the smaller centre of equal ones (to 9 places)."""
    parts = -(-centres.count() // MOST_CENTRES)
    best = F.min_by(F.struct("centre", "distance"), F.struct(F.round("distance", 9), "centre")).alias("b")
    found = None
    for i in range(max(1, parts)):
        some = centres if parts <= 1 else centres.where(F.pmod(F.xxhash64("centre"), F.lit(parts)) == i)
        rows = points.join(F.broadcast(some)).select(key, "centre", squared_distance(F.col(vector), F.col("c")).alias("distance"))
        rows = rows.groupBy(key).agg(best).select(key, "b.centre", "b.distance")
        found = rows if found is None else found.unionByName(rows)
    return found if parts <= 1 else found.groupBy(key).agg(best).select(key, "b.centre", "b.distance")


def lloyd_step(points: DataFrame, key: str, vector: str, centres: DataFrame, dim: int) -> DataFrame:
    """New centres: means of the points nearest to each; partial sums are made before the shuffle."""
    of = points.join(nearest(points, key, vector, centres), key)
    means = of.groupBy("centre").agg(*[F.avg(F.col(vector)[i]).alias(f"m{i}") for i in range(dim)])
    return means.select("centre", F.array(*[F.col(f"m{i}") for i in range(dim)]).alias("c"))


def trained_head(points: DataFrame, key: str, vector: str, label: str, held_out: Column, low: float = 0.4, high: float = 0.6) -> DataFrame:
    """key, held_out, p and answer (yes, no, or abstain between low and high) of a logistic head over vectors.

    It learns from labelled rows that aren't held out; rows without a label are answered, too. Vectors have one length.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = points.select(key, F.coalesce(held_out, F.lit(False)).alias("held_out"), array_to_vector(vector).alias("features"), F.col(label).cast("double").alias("label"))
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(rows.where("not held_out and label is not null"))
    p = vector_to_array("probability")[1]
    return model.transform(rows).select(key, "held_out", p.alias("p"), F.when(p >= high, "yes").when(p <= low, "no").otherwise("abstain").alias("answer"))
