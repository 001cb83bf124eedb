"""How well scores agree with the truth: one report over slices of the scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import with_average_rank

# Weights of the pillars in the total.
TOTAL = {"E": 0.40, "S": 0.35, "G": 0.25}
LEAST = 3


def with_totals(rows: DataFrame) -> DataFrame:
    """rows (company, pillar, predicted, truth, ...) and a row of pillar Total for each company.

    Its prediction weighs the three and needs them all; its truth is the mean of those there are. Other columns are null,
    but n_claims, which is the companies' sum.
    """
    one = lambda p, c: F.max(F.when(F.col("pillar") == p, F.col(c)))
    predicted = sum((one(p, "predicted") * w for p, w in TOTAL.items()), F.lit(0.0))
    totals = rows.groupBy("company").agg(F.lit("Total").alias("pillar"), predicted.alias("predicted"), F.avg("truth").alias("truth"), F.sum("n_claims").alias("n_claims"))
    return rows.unionByName(totals, allowMissingColumns=True)


def slices() -> Column:
    """The slices that a row belongs to, by its n_claims, mode, label, verdict, spread and range."""
    some = [
        F.lit("overall"),
        F.when(F.col("n_claims") > 0, "evidence_only"),
        F.when(F.col("mode").isNotNull(), F.concat(F.lit("gated_"), "mode")),
        F.when(F.col("label").isNotNull(), F.concat(F.lit("confidence_"), "label")),
        F.when(F.col("verdict").isNotNull(), F.when(F.col("mode") == "range", "verify_flagged").otherwise("verify_unflagged")),
        F.when(F.col("spread").isNotNull(), "spread"),
        F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), "coverage"),
    ]
    return F.array_compact(F.array(*some))


def report(rows: DataFrame) -> DataFrame:
    """slice, pillar, n_rows, n and what the n rows with prediction and truth say: a row a slice and pillar.

    spearman, pct_error (mean difference of percentile ranks), mean and median absolute error, mean_rank_error (null below
    LEAST rows); of spreads their mean, median and rank correlation with the rank error; of ranges the share that holds the
    truth, mean and median width. Ranks are within the slice and pillar, equal values share theirs.
    """
    cut = rows.select("*", F.explode(slices()).alias("slice"))
    keys = ["slice", "pillar"]
    counts = cut.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    paired = cut.where(F.col("predicted").isNotNull() & F.col("truth").isNotNull()).select(*keys, "predicted", "truth", "spread", "low", "high")
    ranked = with_average_rank(with_average_rank(paired, keys, "predicted", "__a", "__n"), keys, "truth", "__b")
    ranked = ranked.withColumn("__error", F.abs(F.col("predicted") - F.col("truth"))).withColumn("__gap", F.abs(F.col("__a") - F.col("__b")))
    rho = F.try_divide(F.covar_pop("__a", "__b"), F.stddev_pop("__a") * F.stddev_pop("__b"))
    enough = lambda c: F.when(F.count("*") >= LEAST, c)
    inside = F.col("truth").between(F.col("low"), F.col("high")).cast("int")
    of = lambda name, c: F.when(F.col("slice") == name, c)
    width = F.col("high") - F.col("low")
    told = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), enough(rho).alias("spearman"), F.avg(F.abs(F.col("__a") - F.col("__b")) / F.col("__n")).alias("pct_error"),
        enough(F.avg("__error")).alias("mean_error"), enough(F.median("__error")).alias("median_error"), enough(F.avg("__gap")).alias("mean_rank_error"),
        F.avg(of("spread", F.col("spread"))).alias("mean_spread"), F.median(of("spread", F.col("spread"))).alias("median_spread"),
        F.avg(of("coverage", inside)).alias("coverage"), F.avg(of("coverage", width)).alias("mean_width"), F.median(of("coverage", width)).alias("median_width"),
    )
    spread = ranked.where("slice = 'spread'").select(*keys, "spread", "__gap")
    spread = with_average_rank(with_average_rank(spread, keys, "spread", "__s"), keys, "__gap", "__g")
    both = spread.groupBy(*keys).agg(F.when(F.count("*") >= LEAST, F.try_divide(F.covar_pop("__s", "__g"), F.stddev_pop("__s") * F.stddev_pop("__g"))).alias("spread_to_error"))
    return counts.join(told, keys, "left").join(both, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rises(told: DataFrame) -> DataFrame:
    """pillar, monotonic: whether the mean error rises from high over medium to low confidence; null with fewer than two."""
    one = lambda label: F.max(F.when(F.col("slice") == f"confidence_{label}", F.col("mean_error")))
    high, medium, low = one("high"), one("medium"), one("low")
    given = F.size(F.array_compact(F.array(high, medium, low)))
    fine = F.coalesce(high <= medium, F.lit(True)) & F.coalesce(medium <= low, F.lit(True)) & F.coalesce(high <= low, F.lit(True))
    return told.groupBy("pillar").agg(F.when(given >= 2, fine).alias("monotonic"))
