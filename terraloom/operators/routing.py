"""Pillars without evidence of their own: the ladder of priors, the route, and corrections that are merged at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring

# The rungs of each pillar, the best first.
RUNGS = {"E": ["industry_median", "exio_structural", "peer_upright", "country"], "S": ["industry_median", "peer_upright", "country"], "G": ["peer_upright", "country"]}


def climbed(rows: DataFrame) -> DataFrame:
    """rows with rung and prior: the first rung of the pillar that has a value, from a column a rung; 'none' and null without one."""
    rung = prior = None
    for pillar, order in RUNGS.items():
        first = F.coalesce(*(F.when(F.col(r).isNotNull(), F.lit(r)) for r in order))
        value = F.coalesce(*(F.col(r) for r in order))
        here = F.col("pillar") == pillar
        rung = F.when(here, first) if rung is None else rung.when(here, first)
        prior = F.when(here, value) if prior is None else prior.when(here, value)
    return rows.withColumn("rung", F.coalesce(rung, F.lit("none"))).withColumn("prior", prior)


def severities(contributions: DataFrame, factors: list[str]) -> DataFrame:
    """company, pillar, severity of confirmed bad news: weight times confidence times the fall, of the factors given."""
    bad = F.col("factor").isin(factors) & (F.col("delta") < 0)
    return contributions.groupBy("company", "pillar").agg(F.coalesce(F.sum(F.when(bad, F.col("weight") * F.col("confidence") * -F.col("delta"))), F.lit(0.0)).alias("severity"))


def routed(scored: DataFrame, claims: DataFrame, priors: DataFrame, bad_news: DataFrame) -> DataFrame:
    """scored (company, pillar, score, ...) with route, rung, overlay and the score after them.

    A pillar without any claim is thin: its score is the prior of its ladder alone, with the parameters that all pillars
    share, or 50 without one. Confirmed bad news takes points off on both routes. priors has a column a rung.
    """
    given = claims.select("company", "pillar").distinct().withColumn("__has", F.lit(True))
    out = scored.join(given, ["company", "pillar"], "left").join(climbed(priors).select("company", "pillar", "rung", "prior"), ["company", "pillar"], "left").join(bad_news, ["company", "pillar"], "left")
    thin = F.col("__has").isNull()
    alone = scoring.blended(F.lit(0.0), F.lit(0.0), F.col("prior"))
    overlay = scoring.overlay(F.coalesce("severity", F.lit(0.0)))
    out = out.withColumn("route", F.when(thin, "thin").otherwise("rich")).withColumn("overlay", overlay)
    score = F.when(F.col("route") == "thin", alone).otherwise(F.col("score"))
    out = out.withColumn("score", F.when(F.col("overlay") != 0, scoring.clamp(score + F.col("overlay"), 0.0, 100.0)).otherwise(score))
    rung = F.when((F.col("route") == "thin") & F.col("prior").isNotNull(), F.col("rung"))
    return out.withColumn("rung", rung).drop("__has", "prior", "severity")


def second_opinion(route: Column, holistic: Column) -> Column:
    """The second vote of a pillar; a thin one gets none."""
    return F.when(route == "rich", holistic)


def uplifted(verified: DataFrame, uplift: DataFrame, keys: list[str]) -> DataFrame:
    """verified with applied corrections (applied, corrected, reasoning) on top: a point that needs no review, and a verdict that says so.

    verdict may be null (nothing was verified): 'uplifted' then. Other rows stay as they are.
    """
    rows = verified.join(uplift.where("applied").select(*keys, F.col("corrected").alias("__new"), F.col("reasoning").alias("__why")), keys, "left")
    hit = F.col("__new").isNotNull()
    note = F.format_string("public-company uplift: %.1f -> %.1f (%s)", F.col("score"), F.col("__new"), F.col("__why"))
    changed = {
        "verdict": F.when(F.col("verdict").isNull(), "uplifted").otherwise(F.concat("verdict", F.lit("+uplifted"))), "mode": F.lit("point"), "low": F.col("__new"), "high": F.col("__new"), "needs_review": F.lit(False), "reason": note, "score": F.col("__new"),
    }
    for name, value in changed.items():
        rows = rows.withColumn(name, F.when(hit, value).otherwise(F.col(name)))
    return rows.drop("__new", "__why")
