"""Scores that companies work out about themselves from a few disclosed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring

# Crude kg CO2e per 1000 dollars of revenue, most points of renewable energy, share of them by tier.
CRUDE_KG, RENEWABLE_POINTS, TIERS = 50.0, 15.0, {"none": 0.0, "some": 0.5, "mostly": 1.0}
# Public emission factors, kg CO2e a litre.
DIESEL_KG, PETROL_KG = 2.51279, 2.0844
# Points per power of ten beyond the worst edge of a band.
OVERFLOW_POINTS = 4.0


def counted(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("int")


def result(points: Column, most: Column, supplied: Column, possible: int, baseline: Column) -> Column:
    """score, low, high in whole numbers and coverage: the baseline (50 without one) moved by the share of points reached."""
    coverage = F.round(supplied / possible, 3)
    score = scoring.clamp(F.coalesce(baseline, F.lit(50.0)) + 50.0 * (points / most), 0.0, 100.0)
    widest = F.when(baseline.isNull(), 50.0).otherwise(20.0)
    half = widest - (widest - 5.0) * coverage
    whole = lambda c: F.bround(c, 0)
    return F.struct(whole(score).alias("score"), whole(F.greatest(F.lit(0.0), score - half)).alias("low"), whole(F.least(F.lit(100.0), score + half)).alias("high"), coverage.alias("coverage"))


def environment(diesel: Column, petrol: Column, kwh: Column, grid: Column, revenue: Column, tier: Column, industry: Column, baseline: Column) -> Column:
    """Emissions per revenue against a crude benchmark, and the renewable tier by the room its industry leaves."""
    fuel = diesel.isNotNull() | petrol.isNotNull()
    kilos = F.coalesce(diesel * DIESEL_KG, F.lit(0.0)) + F.coalesce(petrol * PETROL_KG, F.lit(0.0)) + F.coalesce(kwh * grid, F.lit(0.0))
    emitted = F.when((fuel | kwh.isNotNull()) & (revenue != 0), 40.0 * scoring.clamp((CRUDE_KG - kilos / (revenue / 1000.0)) / CRUDE_KG, -1.0, 1.0))
    room = F.when(industry.isNull(), RENEWABLE_POINTS).otherwise(RENEWABLE_POINTS * F.greatest(F.lit(0.15), (100.0 - industry) / 100.0))
    points = F.coalesce(emitted, F.lit(0.0)) + F.coalesce(scoring.by_key(tier, TIERS, None) * room, F.lit(0.0))
    return result(points, 40.0 + room, counted(fuel) + counted(kwh.isNotNull()) + counted(tier.isNotNull()), 3, baseline)


def social(staff: Column, women: Column, fined: Column, missed: Column, baseline: Column) -> Column:
    known = (staff > 0) & women.isNotNull()
    points = F.when(known, F.least(F.lit(1.0), 100.0 * women / staff / 50.0) * 20.0).otherwise(0.0)
    points = points + F.when(fined, -25.0).when(~fined, 10.0).otherwise(0.0) + F.when(missed, -15.0).when(~missed, 5.0).otherwise(0.0)
    return result(points, F.lit(60.0), counted(known) + counted(fined.isNotNull()) + counted(missed.isNotNull()), 3, baseline)


def governance(*claimed: Column, baseline: Column) -> Column:
    """20 points for each policy that is in place; one that isn't counts as not supplied."""
    held = sum(map(counted, claimed))
    return result(20.0 * held, F.lit(20.0 * len(claimed)), held, len(claimed), baseline)


def overflow(value: Column, worst: Column, lower_is_better: Column, confidence: Column) -> Column:
    """Points off for a value beyond the worst edge of a band where less is better, four per power of ten."""
    beyond = lower_is_better & (worst > 0) & (value > worst)
    return F.when(beyond, F.log10(value / worst) * OVERFLOW_POINTS * confidence).otherwise(0.0)


def certainty(country: Column, industry: Column, n_claims: Column, mean_confidence: Column, score: Column) -> tuple[Column, Column, Column]:
    """Label, low and high of a score by what real sources and how many confident claims stand behind it."""
    sourced = country.isNotNull() | industry.isNotNull()
    strong = (n_claims >= 2) & F.coalesce(mean_confidence >= 0.6, F.lit(False))
    label = F.when(sourced, "high").when(strong, "medium").otherwise("low")
    half = F.when(~sourced & (n_claims == 0), 50.0).when(country.isNotNull() & industry.isNotNull(), 5.0).when(sourced & strong, 5.0).when(sourced, 8.0).otherwise(15.0)
    return label, F.greatest(F.lit(0.0), score - half), F.least(F.lit(100.0), score + half)


# Most times that few disclosed factors are scaled up, least penalty that counts, points of a badge, the pillar that has badges.
MOST_RESCALE, LEAST_PENALTY, BADGE_POINTS, BADGE_PILLAR = 4.0, 0.01, 3.0, "G"


def blended_baseline(country: Column, industry: Column) -> Column:
    """The mean of both baselines, or the one there is, or 50."""
    return F.coalesce((country + industry) / 2, industry, country, F.lit(50.0))


def rescaled(score: Column, points: Column, supplied: Column, registered: Column) -> Column:
    """The score as if all registered factors had been disclosed as the supplied ones were, at most MOST_RESCALE times.

    What is added fades out towards 0 and 100. Without supplied weight, or with all of it, nothing changes.
    """
    times = F.least(F.lit(MOST_RESCALE), registered / supplied)
    extra = points * (times - 1)
    up, down = F.greatest(100.0 - score, F.lit(1e-6)), F.greatest(score, F.lit(1e-6))
    moved = F.when(extra > 0, score + (100.0 - score) * F.tanh(extra / up)).when(extra < 0, score - score * F.tanh(-extra / down)).otherwise(score)
    return F.when((supplied > 0) & (times > 1), moved).otherwise(score)


def badge_points(*flags: Column) -> Column:
    """Points for each badge held, as many off for each that is denied; none for what isn't said."""
    return sum((F.when(f, BADGE_POINTS).when(~f, -BADGE_POINTS).otherwise(0.0) for f in flags), F.lit(0.0))


def assessed(contributions: DataFrame, pillars: DataFrame, badges: Column) -> DataFrame:
    """pillars (company, pillar, country_baseline, industry_baseline, registered, ...) with score, low, high, label, penalty and n_claims.

    In this order: baseline and points; the industry's half of the baseline; the rescale for factors not disclosed; points off
    for values far beyond the worst edge (contributions' `beyond`, those of LEAST_PENALTY or less aside); badges, for their
    pillar. The score stays within 0 and 100 after each. Contributions have company, pillar, weight, confidence, points, beyond.
    """
    big = F.when(F.col("beyond") > LEAST_PENALTY, F.col("beyond")).otherwise(0.0)
    sums = contributions.groupBy("company", "pillar").agg(F.sum("points").alias("__points"), F.sum("weight").alias("__supplied"), F.sum(big).alias("__penalty"), F.count("*").alias("__n"), F.avg("confidence").alias("__sure"))
    out = pillars.join(sums, ["company", "pillar"], "left").fillna(0.0, ["__points", "__supplied", "__penalty"]).fillna(0, ["__n"])
    within = lambda c: scoring.clamp(c, 0.0, 100.0)
    country = F.coalesce("country_baseline", F.lit(50.0))
    base = blended_baseline(F.col("country_baseline"), F.col("industry_baseline"))
    out = out.withColumn("score", within(country + F.col("__points")))
    out = out.withColumn("score", F.when(F.col("industry_baseline").isNotNull(), within(F.col("score") + base - country)).otherwise(F.col("score")))
    out = out.withColumn("score", rescaled(F.col("score"), F.col("__points"), F.col("__supplied"), F.col("registered")))
    out = out.withColumn("score", within(F.col("score") - F.col("__penalty")))
    out = out.withColumn("score", F.when(F.col("pillar") == BADGE_PILLAR, within(F.col("score") + badges)).otherwise(F.col("score")))
    label, low, high = certainty(F.col("country_baseline"), F.col("industry_baseline"), F.col("__n"), F.col("__sure"), F.col("score"))
    out = out.withColumn("label", label).withColumn("low", low).withColumn("high", high)
    return out.withColumn("penalty", F.col("__penalty")).withColumn("n_claims", F.col("__n")).drop("__points", "__supplied", "__penalty", "__n", "__sure")
