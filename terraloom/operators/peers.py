"""Votes of a company's peers, from the nearest group of peers that is large enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import first_per_key, medians_without_own, ranks_among

# Tiers in the order they are tried, with the least peers and the confidence of each; tiers that a pillar leaves out.
TIERS = {"sector_country": (5, 0.5), "sector_only": (8, 0.3), "fuzzy_country": (8, 0.3), "fuzzy_global": (8, 0.3)}
OVERALL_CONFIDENCE = 0.25
LEFT_OUT = {"E": ["sector_only"], "S": ["sector_only"], "G": []}
#: The pillar that has no proxy of its own in the second pool, and takes its overall percentile.
OVERALL = "G"

_BETWEEN = "\u001f"


def _key(*parts) -> object:
    """Parts as one key; null if one of them is."""
    return F.concat(*(x for p in parts for x in (p, F.lit(_BETWEEN))))


def peer_votes(companies: DataFrame, peers: DataFrame, pool: DataFrame, tiers: list[str] | None = None) -> DataFrame:
    """company, pillar, tier, percentile, confidence, n_peers for the three pillars of each company.

    companies: company, name, country, sectors (array, the first tried first), label (its sector in the second pool's terms).
    peers: id, name, sector, country, E, S, G. pool: id, name, sector, country, overall (percentile), E and S (proxies).
    A group is a sector of one country, then of all (which E and S leave out); the median of the others is placed among all
    peers' values, with equal ones half below. Then the label's group of the second pool by country, then of all: E and S
    take the mean of proxies (none: no vote), G the median of overall percentiles. Names are compared as given, and a
    company's own rows never count. Only the given tiers are tried (all, if none are given). Without a group: tier 'abstain', no percentile, confidence 0. Null sectors, labels,
    countries and names match nothing.
    """
    pillars = list(LEFT_OUT)
    own = companies.select("company", F.coalesce("name", F.lit("")).alias("name"), "country", "sectors", "label")
    named = lambda df: df.withColumn("name", F.coalesce("name", F.lit("")))

    # Every peer stands in its sector's group of its country and in that of all countries, for each pillar.
    where = lambda sector: F.array_compact(F.array(_key(sector, F.col("country")), _key(sector, F.lit("*"))))
    values = named(peers).select("id", "name", F.explode(where(F.col("sector"))).alias("group"), F.explode(F.create_map(*(x for p in pillars for x in (F.lit(p), F.col(p).cast("double"))))).alias("pillar", "value"))
    values = values.withColumn("key", _key("pillar", "group"))
    asked = own.select("company", "name", "country", F.posexplode("sectors").alias("nth", "sector"))
    asked = asked.select("company", "name", "nth", F.inline(F.array(*(F.struct(F.lit(t).alias("tier"), _key(F.col("sector"), c).alias("group")) for t, c in (("sector_country", F.col("country")), ("sector_only", F.lit("*")))))))
    asked = asked.select("*", F.explode(F.array(*map(F.lit, pillars))).alias("pillar")).withColumn("key", _key("pillar", "group")).where("key is not null")
    first = medians_without_own(values.where("key is not null"), "key", "name", "value", "id", asked)
    spread = peers.select(F.explode(F.create_map(*(x for p in pillars for x in (F.lit(p), F.col(p).cast("double"))))).alias("pillar", "middle"))
    first = ranks_among(first, spread, ["pillar"], "middle")
    first = first.select("company", "pillar", "tier", "nth", F.col("n_valued").alias("n"), (100 * (F.col("below") + F.col("equal") / 2) / F.col("total")).alias("percentile"))

    grouped = named(pool).select("id", "name", F.explode(where(F.col("sector"))).alias("key"), F.col("overall").cast("double").alias("overall"), "E", "S")
    labelled = own.select("company", "name", F.inline(F.array(*(F.struct(F.lit(t).alias("tier"), _key(F.col("label"), c).alias("key")) for t, c in (("fuzzy_country", F.col("country")), ("fuzzy_global", F.lit("*"))))))).where("key is not null")
    second = medians_without_own(grouped, "key", "name", "overall", "id", labelled)
    proxies = [c for p in pillars if p != OVERALL for c in (F.sum(p).alias(f"sum_{p}"), F.count(p).alias(f"n_{p}"))]
    all_, mine = grouped.groupBy("key").agg(*proxies), grouped.groupBy("key", "name").agg(*proxies)
    mine = mine.select("key", "name", *(F.col(f"{a}_{p}").alias(f"own_{a}_{p}") for p in pillars if p != OVERALL for a in ("sum", "n")))
    second = second.join(all_, "key", "left").join(mine, ["key", "name"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    mean = lambda p: F.when(zero(f"n_{p}") > zero(f"own_n_{p}"), (F.col(f"sum_{p}") - zero(f"own_sum_{p}")) / (F.col(f"n_{p}") - zero(f"own_n_{p}")))
    votes = F.inline(F.array(*(F.struct(F.lit(p).alias("pillar"), (F.col("middle") if p == OVERALL else mean(p)).alias("percentile")) for p in pillars)))
    second = second.select("company", "tier", F.lit(0).alias("nth"), F.col("n_valued").alias("n"), votes).select("company", "pillar", "tier", "nth", "n", "percentile")

    tried = first.unionByName(second).where(F.col("tier").isin(list(TIERS) if tiers is None else tiers))
    floor, order = (F.create_map(*(x for i, (t, v) in enumerate(TIERS.items()) for x in (F.lit(t), F.lit(i if what else v[0])))) for what in (0, 1))
    out_of = F.create_map(*(x for p, tiers in LEFT_OUT.items() for x in (F.lit(p), F.array(*map(F.lit, tiers)).cast("array<string>"))))
    enough = tried.where((F.col("n") >= F.element_at(floor, F.col("tier"))) & ~F.array_contains(F.element_at(out_of, F.col("pillar")), F.col("tier")))
    best = first_per_key(enough, ["company", "pillar"], F.element_at(order, F.col("tier")), F.col("nth")).where("percentile is not null")
    sure = F.element_at(F.create_map(*(x for t, v in TIERS.items() for x in (F.lit(t), F.lit(v[1])))), F.col("tier"))
    sure = F.when(F.col("tier").startswith("fuzzy") & (F.col("pillar") == OVERALL), OVERALL_CONFIDENCE).otherwise(sure)
    dense = own.select("company", F.explode(F.array(*map(F.lit, pillars))).alias("pillar"))
    out = dense.join(best.select("company", "pillar", "tier", "percentile", sure.alias("confidence"), F.col("n").alias("n_peers")), ["company", "pillar"], "left")
    return out.select("company", "pillar", F.coalesce("tier", F.lit("abstain")).alias("tier"), "percentile", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n_peers", F.lit(0)).alias("n_peers"))
