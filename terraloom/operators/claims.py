"""Claims to pillar scores: validation, best claims, evidence, votes, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from .ranking import first_per_key

# Order in which equally confident claims are preferred by how they were made.
METHOD_RANK = {"dataset_lookup": 3, "extracted": 2, "peer_ratio_fallback": 1, "coarse_bucket": 0}


def coerce(polarity: Column, strength: Column, confidence: Column) -> tuple[Column, Column, Column]:
    """Polarity to -1, 0 or 1, strength and confidence into 0..1 with defaults."""
    clean = lambda c, d: scoring.clamp(F.coalesce(c, F.lit(d)), 0.0, 1.0)
    return F.when(polarity.isin(-1, 0, 1), polarity).otherwise(0), clean(strength, 0.5), clean(confidence, 0.4)


def validated(claims: DataFrame, text_length: str, percent: Column) -> DataFrame:
    """Confidence after the rules, in their order: bounds of the value, polarity against the value, short text, one source.

    A value that is negative, not finite, or over 100 for a percentage becomes null. A neutral claim with full
    strength is halved. Text shorter than 200 caps confidence over .7 at .5; missing text passes. Negative claims
    of a company and factor that all come from one source are cut to .7.
    """
    bad = (F.col("value") < 0) | F.isnan("value") | (percent & (F.col("value") > 100))
    out = claims.withColumn("value", F.when(~bad, F.col("value")))
    out = out.withColumn("confidence", F.when((F.col("polarity") == 0) & (F.col("strength") >= 1), F.col("confidence") * 0.5).otherwise(F.col("confidence")))
    out = out.withColumn("confidence", F.when((F.col(text_length) < 200) & (F.col("confidence") > 0.7), 0.5).otherwise(F.col("confidence")))
    negative = out.where("polarity = -1").groupBy("company", "factor").agg((F.count_distinct("source_tag") == 1).alias("__alone"))
    out = out.join(negative, ["company", "factor"], "left")
    return out.withColumn("confidence", F.when((F.col("polarity") == -1) & F.col("__alone"), F.col("confidence") * 0.7).otherwise(F.col("confidence"))).drop("__alone")


def best_claims(claims: DataFrame, keys: list[str]) -> DataFrame:
    """The claim of the highest confidence, then method rank, then the earliest, of each key."""
    rank = scoring.by_key(F.col("method"), METHOD_RANK, 0)
    return first_per_key(claims, keys, F.desc("confidence"), rank.desc(), F.col("seq"))


def pillar_reduction(contributions: DataFrame, weight_sums: DataFrame, baseline: float = 50.0) -> DataFrame:
    """company, pillar: mass, gate_fired, delta, coverage, term, score of contributions (weight, confidence, method, delta)."""
    adjusted = F.col("weight") * F.col("confidence") * scoring.trust(F.col("method"))
    out = contributions.groupBy("company", "pillar").agg(F.sum(adjusted).alias("mass"), F.sum(adjusted * F.col("delta")).alias("num"), F.sum("weight").alias("den"), F.count("*").alias("n_claims"))
    out = out.join(weight_sums, "pillar", "left").withColumn("gate_fired", F.col("mass") < scoring.MASS_GATE)
    delta = F.when(F.col("gate_fired") | (F.col("den") <= 0), 0.0).otherwise(scoring.clamp(F.col("num") / F.col("den"), -1.0, 1.0))
    coverage = F.when(F.col("gate_fired") | ~(F.col("weight_sum") > 0), 0.0).otherwise(scoring.clamp(F.col("den") / F.col("weight_sum"), 0.0, 1.0))
    out = out.withColumn("delta", delta).withColumn("coverage", coverage)
    out = out.withColumn("term", scoring.evidence_term(F.col("pillar"), F.col("delta"), F.col("coverage")))
    return out.withColumn("score", scoring.tiebroken(F.col("term"), F.lit(baseline))).drop("num", "den", "weight_sum")


def saturated(contributions: DataFrame, scored: DataFrame, weight_sums: DataFrame) -> DataFrame:
    """scored (company, pillar, baseline) with mass, gate_fired, delta, coverage, n_claims, anchored and score.

    The peer anchor counts in the swing alone: not in the mass that opens the gate, nor in coverage, nor as a claim; the
    industry's vote counts as a claim. Behind a closed gate only the anchor moves the score. Keys without contributions have
    the baseline's small share.
    """
    anchor = F.col("factor") == scoring.PEER_ANCHOR
    adjusted = F.col("weight") * F.col("confidence") * scoring.trust(F.col("method"))
    part = lambda value, of: F.coalesce(F.sum(F.when(of, value)), F.lit(0.0))
    sums = contributions.groupBy("company", "pillar").agg(
        part(adjusted, ~anchor).alias("mass"), part(adjusted * F.col("delta"), ~anchor).alias("num"), part(F.col("weight"), ~anchor).alias("den"), F.count_if(~anchor).alias("n_given"),
        part(adjusted * F.col("delta"), anchor).alias("anchor_num"), part(F.col("weight"), anchor).alias("anchor_den"), (F.count_if(anchor) > 0).alias("anchored"),
    )
    out = scored.join(sums, ["company", "pillar"], "left").join(weight_sums, "pillar", "left").fillna(0.0, ["mass", "num", "den", "anchor_num", "anchor_den"]).fillna(0, ["n_given"]).fillna(False, ["anchored"])
    out = out.withColumn("gate_fired", F.col("mass") < scoring.MASS_GATE)
    open_ = lambda c: F.when(F.col("gate_fired"), 0.0).otherwise(F.col(c))
    num, den = open_("num") + F.col("anchor_num"), open_("den") + F.col("anchor_den")
    out = out.withColumn("delta", F.when(den > 0, scoring.clamp(num / den, -1.0, 1.0)).otherwise(0.0))
    out = out.withColumn("coverage", F.when(F.col("weight_sum") > 0, scoring.clamp(open_("den") / F.col("weight_sum"), 0.0, 1.0)).otherwise(0.0))
    out = out.withColumn("n_claims", F.when(F.col("gate_fired"), 0).otherwise(F.col("n_given")))
    term = scoring.evidence_term(F.col("pillar"), F.col("delta"), F.col("coverage"))
    return out.withColumn("score", scoring.tiebroken(term, F.col("baseline"))).drop("num", "den", "anchor_num", "anchor_den", "n_given", "weight_sum")


def reconciled(votes: DataFrame) -> DataFrame:
    """Two optional votes (formula with its trust mass, holistic) of a pillar to score, spread, range and label."""
    first = scoring.by_key(F.col("pillar"), {k: v[0] for k, v in scoring.VOTE_WEIGHTS.items()}, 0.5) * F.least(F.lit(1.0), 0.4 + 0.04 * F.col("mass"))
    second = scoring.by_key(F.col("pillar"), {k: v[1] for k, v in scoring.VOTE_WEIGHTS.items()}, 0.5) * scoring.HOLISTIC_CONFIDENCE
    a, b = F.col("formula"), F.col("holistic")
    n = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    both = (first * a + second * b) / (first + second)
    score = F.when(n == 2, scoring.clamp(both, 0.0, 100.0)).otherwise(F.coalesce(a, b, F.lit(50.0)))
    out = votes.withColumn("n_votes", n).withColumn("score", score).withColumn("spread", F.when(n == 2, F.abs(a - b)))
    half = scoring.half_width(F.col("spread"))
    out = out.withColumn("low", F.greatest(F.lit(0.0), F.col("score") - half)).withColumn("high", F.least(F.lit(100.0), F.col("score") + half))
    return out.withColumn("label", scoring.confidence_label(F.col("n_votes"), F.col("spread")))


def gated(scores: DataFrame) -> DataFrame:
    """A range that needs review where confidence is low or evidence thin, else a point."""
    thin = F.coalesce(F.col("gate_fired") | (F.col("n_claims") == 0), F.lit(False))
    review = (F.col("label") == "low") | thin
    return scores.withColumn("mode", F.when(review, "range").otherwise("point")).withColumn("needs_review", review)


def majority(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """refuted at two refutations, inconclusive below two answers, else pass; and the factor that two or more flag first."""
    base = verdicts.groupBy(*keys).agg(F.count_if(F.col("verdict") == "refute").alias("n_refute"), F.count_if(F.col("verdict") != "abstain").alias("n_answer"))
    flagged = verdicts.where("verdict = 'refute' and flagged is not null").groupBy(*keys, "flagged").agg(F.count("*").alias("n"), F.min("seq").alias("seq")).where("n >= 2")
    flagged = first_per_key(flagged, keys, F.col("seq")).select(*keys, F.col("flagged").alias("converged"))
    outcome = F.when(F.col("n_answer") < 2, "inconclusive").when(F.col("n_refute") >= 2, "refuted").otherwise("pass")
    return base.withColumn("outcome", outcome).join(flagged, keys, "left")


def normalised_indicators(values: DataFrame, entity: str, indicator: str, value: str, falling: list[str]) -> DataFrame:
    """Min-max of each indicator over all entities to 0..100, flipped where less is better; 50 for all if it is constant."""
    by = W.partitionBy(indicator)
    low, high = F.min(value).over(by), F.max(value).over(by)
    share = F.when(low == high, 50.0).otherwise(100 * (F.col(value) - low) / (high - low))
    return values.withColumn("norm", F.when(F.col(indicator).isin(falling) & (low != high), 100 - share).otherwise(share))


def contributions(best: DataFrame) -> DataFrame:
    """delta, confidence and points of the best claim of each factor.

    Needs weight, full_value, none_value, banded, per_revenue, tracked, revenue, country_total and fresh beside the claim.
    A banded factor is placed between full_value and none_value, per unit of revenue where that is asked for. Without
    revenue a tracked factor from a dataset is placed by its share of country_total, and any other claim falls back on
    polarity times strength at half the confidence. Without a value, and for other factors, polarity times strength
    counts. Only extracted claims of factors without a band lose confidence with age, and those of reports never do.
    """
    said, value = F.col("polarity") * F.col("strength"), F.col("value")
    has_revenue = F.coalesce(F.col("revenue") > 0, F.lit(False))
    missing = F.col("banded") & F.col("per_revenue") & ~has_revenue & value.isNotNull()
    shared = missing & F.col("tracked") & (F.col("method") == "dataset_lookup") & F.coalesce(F.col("country_total") > 0, F.lit(False))
    placed = F.when(F.col("per_revenue"), value / F.col("revenue")).otherwise(value)
    delta = F.when(shared, 1 - 2 * scoring.clamp(value / F.col("country_total"), 0.0, 1.0)).when(missing | ~F.col("banded") | value.isNull(), said)
    delta = delta.otherwise(scoring.band_delta(placed, F.col("full_value"), F.col("none_value")))
    aged = ~F.col("banded") & (F.col("method") == "extracted") & ~F.coalesce(F.col("source_tag").startswith("report_pdf"), F.lit(False))
    confidence = F.col("confidence") * F.when(missing & ~shared, 0.5).otherwise(1.0) * F.when(aged, F.col("fresh")).otherwise(1.0)
    out = best.withColumn("delta", delta).withColumn("confidence", confidence)
    return out.withColumn("points", F.col("weight") * F.col("confidence") * F.col("delta"))
