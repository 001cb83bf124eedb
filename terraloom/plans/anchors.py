"""Peer votes and the formula score with all its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import calculators
from ..operators import claims as C
from ..operators import peers as P
from ..operators import routing
from ..session import checkpointed
from .base import query
from .rules import _SHARES, _placed
from .scores import _TRUST, r6

# A company's own sector as it is written, the coarse one tried next, and its label in the second pool.
_SECTORS = """SELECT company, lower(replace(name, 'Supplier', 'Customer')) AS name, CASE WHEN market_id % 4 = 3 THEN NULL ELSE country END AS country,
  CASE CAST(market_id % 7 AS int) WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'AUTOMOBILE' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'heavy machinery' WHEN 4 THEN 'household goods' WHEN 5 THEN 'fishing' END AS sector,
  CASE CAST(market_id % 7 AS int) WHEN 3 THEN 'MACHINERY' WHEN 1 THEN 'MACHINERY' END AS bucket,
  CASE CAST(market_id % 7 AS int) WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'AUTOMOBILE' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'MACHINERY' WHEN 4 THEN 'HOUSEHOLD' END AS label FROM companies"""

_VOTES = f"""sect AS ({_SECTORS}),
vals AS (SELECT peer_id, lower(name) AS name, sector, country, unnest(['E', 'S', 'G']) AS pillar, unnest([score, workers, community]) AS v FROM peers),
cands AS (SELECT company, name, country, 0 AS nth, sector AS s FROM sect WHERE sector IS NOT NULL UNION ALL SELECT company, name, country, 1, bucket FROM sect WHERE bucket IS NOT NULL),
near AS (SELECT company, pillar, nth, 0 AS ord, 'sector_country' AS tier, 5 AS least, count(v) AS n, median(v) AS m FROM cands c JOIN vals p ON p.sector = c.s AND p.country = c.country AND p.name <> c.name GROUP BY ALL
  UNION ALL SELECT company, pillar, nth, 1, 'sector_only', 8, count(v), median(v) FROM cands c JOIN vals p ON p.sector = c.s AND p.name <> c.name WHERE pillar = 'G' GROUP BY ALL),
placed AS (SELECT n.*, percentile FROM near n JOIN (SELECT x.pillar, m, 100 * (count(*) FILTER (v < m) + count(*) FILTER (v = m) / 2) / count(v) AS percentile FROM (SELECT DISTINCT pillar, m FROM near WHERE m IS NOT NULL) x JOIN vals USING (pillar) GROUP BY x.pillar, m) USING (pillar, m)),
pooled AS (SELECT company, unnest(['E', 'S', 'G']) AS pillar, 0 AS nth, ord, tier, 8 AS least, n, NULL AS m, unnest([e, s, g]) AS percentile FROM (
  SELECT company, 2 AS ord, 'fuzzy_country' AS tier, count(customers) AS n, avg(p.workers / 200) AS e, avg(p.community / 200) AS s, median(customers) AS g FROM sect c JOIN peers p ON p.sector = c.label AND p.country = c.country AND lower(p.name) <> c.name GROUP BY company
  UNION ALL SELECT company, 3, 'fuzzy_global', count(customers), avg(p.workers / 200), avg(p.community / 200), median(customers) FROM sect c JOIN peers p ON p.sector = c.label AND lower(p.name) <> c.name GROUP BY company)),
chosen AS (SELECT * FROM (SELECT * EXCLUDE (m) FROM placed UNION ALL BY NAME SELECT * EXCLUDE (m) FROM pooled) WHERE n >= least QUALIFY row_number() OVER (PARTITION BY company, pillar ORDER BY ord, nth) = 1),
votes AS (SELECT company, d.pillar, coalesce(tier, 'abstain') AS tier, percentile, CASE WHEN tier IS NULL THEN 0 WHEN tier = 'sector_country' THEN 0.5 WHEN pillar = 'G' AND starts_with(tier, 'fuzzy') THEN 0.25 ELSE 0.3 END::DOUBLE AS confidence, coalesce(n, 0) AS n_peers
  FROM (SELECT company, unnest(['E', 'S', 'G']) AS pillar FROM sect) d LEFT JOIN (SELECT * FROM chosen WHERE percentile IS NOT NULL) USING (company, pillar))"""


def _votes(t, tiers=None):
    t.companies.createOrReplaceTempView("companies")
    own = t.spark.sql(_SECTORS).select("company", "name", "country", F.array_compact(F.array("sector", "bucket")).alias("sectors"), "label")
    base = t.peers.select(F.col("peer_id").alias("id"), F.lower("name").alias("name"), "sector", "country", "score", "workers", "community", "customers")
    first = base.select("id", "name", "sector", "country", F.col("score").alias("E"), F.col("workers").alias("S"), F.col("community").alias("G"))
    pool = base.select("id", "name", "sector", "country", F.col("customers").alias("overall"), (F.col("workers") / 200).alias("E"), (F.col("community") / 200).alias("S"))
    return P.peer_votes(own, first, pool, tiers)


@query("c04_peer_votes", f"WITH {_VOTES} SELECT company, pillar, tier, round(percentile, 6) AS percentile, confidence, n_peers FROM votes")
def _(t):
    return _votes(t).select("company", "pillar", "tier", r6("percentile").alias("percentile"), "confidence", "n_peers")


# The industry's own vote: where a sector's average peer stands.
_INDUSTRY = "SELECT sector, 100 * (avg(score) + 1000) / 11000 AS percentile FROM peers WHERE sector <> 'FURNITURE' GROUP BY sector"
_BASE = "SELECT country, greatest(0, least(100, avg(score) / 100)) AS baseline FROM peers GROUP BY country HAVING count(score) > 10"


_FULL = f"""{_SHARES}, {_VOTES}, methods AS (SELECT company, factor, method FROM best),
industry AS ({_INDUSTRY}), based AS ({_BASE}),
parts AS (SELECT p.company, p.pillar, p.factor, p.weight, conf AS confidence, delta, method FROM placed_claims p JOIN methods USING (company, factor)
  UNION ALL SELECT company, pillar, '_peer_anchor', 10, confidence, 2 * (percentile / 100) - 1, 'peer_anchor' FROM votes WHERE percentile IS NOT NULL
  UNION ALL SELECT company, pillar, '_industry_median', CASE pillar WHEN 'E' THEN 10 ELSE 6 END, 0.2::DOUBLE, 2 * (i.percentile / 100) - 1, 'exio_structural' FROM sect JOIN industry i ON i.sector = label, (VALUES ('E'), ('S'), ('G')) p(pillar)),
sums AS (SELECT company, pillar, coalesce(sum(weight * confidence * {_TRUST}) FILTER (factor <> '_peer_anchor'), 0) AS mass, coalesce(sum(weight * confidence * {_TRUST} * delta) FILTER (factor <> '_peer_anchor'), 0) AS num, coalesce(sum(weight) FILTER (factor <> '_peer_anchor'), 0) AS den, count(*) FILTER (factor <> '_peer_anchor') AS n,
  coalesce(sum(weight * confidence * {_TRUST} * delta) FILTER (factor = '_peer_anchor'), 0) AS anum, coalesce(sum(weight) FILTER (factor = '_peer_anchor'), 0) AS aden FROM parts GROUP BY company, pillar),
dense AS (SELECT c.company, pillar, coalesce(baseline, 50) AS baseline FROM companies c LEFT JOIN based USING (country), (VALUES ('E'), ('S'), ('G')) p(pillar)),
gate AS (SELECT d.*, coalesce(mass, 0) AS mass, coalesce(mass, 0) < 2.5 AS fired, coalesce(num, 0) AS num, coalesce(den, 0) AS den, coalesce(n, 0) AS n, coalesce(anum, 0) AS anum, coalesce(aden, 0) AS aden FROM dense d LEFT JOIN sums USING (company, pillar)),
swing AS (SELECT *, CASE WHEN CASE WHEN fired THEN 0 ELSE den END + aden > 0 THEN greatest(-1, least(1, (CASE WHEN fired THEN 0 ELSE num END + anum) / (CASE WHEN fired THEN 0 ELSE den END + aden))) ELSE 0 END AS delta, CASE WHEN fired THEN 0 ELSE least(1, den / (SELECT sum(weight) FROM factors)) END AS coverage FROM gate),
termed AS (SELECT *, (CASE WHEN pillar = 'S' THEN 200.0::DOUBLE WHEN pillar = 'G' AND delta < 0 THEN 160.0::DOUBLE ELSE 40.0::DOUBLE END) * ((exp(delta) - exp(-delta)) / (exp(delta) + exp(-delta))) * (0.6::DOUBLE + 0.4::DOUBLE * coverage) AS term FROM swing),
full_scores AS (SELECT company, pillar, mass, fired, n, aden, delta, coverage, greatest(0, least(100, CASE WHEN term <> 0 THEN 50 + term ELSE 50 + 0.02 * (baseline - 50) END)) AS score FROM termed)""".replace("placed AS (SELECT company, pillar, factor, weight, seq", "placed_claims AS (SELECT company, pillar, factor, weight, seq", 1)


@query("c02_full_scores", _FULL + " SELECT company, pillar, round(mass, 6) AS mass, fired AS gate_fired, CASE WHEN fired THEN 0 ELSE n END AS n_claims, aden > 0 AS anchored, round(delta, 6) AS delta, round(coverage, 6) AS coverage, round(score, 6) AS score FROM full_scores")
def _(t):
    out = full_scores(t)[1]
    return out.select("company", "pillar", r6("mass").alias("mass"), "gate_fired", "n_claims", "anchored", r6("delta").alias("delta"), r6("coverage").alias("coverage"), r6("score").alias("score"))


def full_scores(t):
    """All contributions, and the scores they make."""
    votes = _votes(t)
    t.peers.createOrReplaceTempView("peers")
    t.companies.createOrReplaceTempView("companies")
    swing = lambda c: 2 * (F.col(c) / 100) - 1
    anchors = votes.where("percentile is not null").select("company", "pillar", F.lit(scoring.PEER_ANCHOR).alias("factor"), F.lit(scoring.ANCHOR_WEIGHT).alias("weight"), "confidence", swing("percentile").alias("delta"), F.lit("peer_anchor").alias("method"))
    weights = F.explode(F.create_map(*(F.lit(x) for kv in scoring.INDUSTRY_WEIGHTS.items() for x in kv))).alias("pillar", "weight")
    industry = t.spark.sql(_SECTORS).join(t.spark.sql(_INDUSTRY).withColumnRenamed("sector", "label"), "label")
    industry = industry.select("company", weights, F.lit(scoring.INDUSTRY_VOTE).alias("factor"), F.lit(0.2).alias("confidence"), swing("percentile").alias("delta"), F.lit("exio_structural").alias("method"))
    parts = _placed(t).select("company", "pillar", "factor", "weight", "confidence", "delta", "method").unionByName(anchors).unionByName(industry)
    parts = checkpointed(parts)  # a row a company and factor, used for scores and for severities
    sums = t.factors.agg(F.sum("weight").alias("weight_sum")).select(F.explode(F.array(*map(F.lit, "ESG"))).alias("pillar"), "weight_sum")
    dense = t.companies.select("company", "country", F.explode(F.array(*map(F.lit, "ESG"))).alias("pillar")).join(t.spark.sql(_BASE), "country", "left").select("company", "pillar", F.coalesce("baseline", F.lit(50.0)).alias("baseline"))
    return parts, C.saturated(parts, dense, sums)


# Rungs of the ladder: medians of some industries, the industry's own vote, fuzzy peers, the country.
_MEDIANS = "SELECT sector AS label, 50 + median(workers) / 200 AS industry_median FROM peers WHERE sector IN ('BUILDING', 'HOUSEHOLD') GROUP BY sector"
_BAD = ["f1", "f4", "f7", "f10"]
_ROUTES = f""", strong AS (SELECT DISTINCT company, pillar, true AS given FROM claims WHERE confidence >= 0.99 AND strength > 0.98),
fuzzy AS (SELECT company, pillar, percentile FROM pooled WHERE n >= least QUALIFY row_number() OVER (PARTITION BY company, pillar ORDER BY ord) = 1),
rungs AS (SELECT s.company, p.pillar, CASE WHEN p.pillar <> 'G' THEN industry_median END AS r1, CASE WHEN p.pillar = 'E' THEN i.percentile END AS r2, f.percentile AS r3, b.baseline AS r4 FROM sect s, (VALUES ('E'), ('S'), ('G')) p(pillar)
  LEFT JOIN ({_MEDIANS}) m ON m.label = s.label LEFT JOIN industry i ON i.sector = s.label LEFT JOIN fuzzy f ON f.company = s.company AND f.pillar = p.pillar LEFT JOIN based b ON b.country = s.country),
bad_news AS (SELECT company, pillar, coalesce(sum(weight * confidence * -delta) FILTER (factor IN ('f1', 'f4', 'f7', 'f10') AND delta < 0), 0)::DOUBLE AS s FROM parts GROUP BY company, pillar),
routes AS (SELECT f.*, CASE WHEN given THEN 'rich' ELSE 'thin' END AS route, coalesce(r1, r2, r3, r4) AS prior, CASE WHEN r1 IS NOT NULL THEN 'industry_median' WHEN r2 IS NOT NULL THEN 'exio_structural' WHEN r3 IS NOT NULL THEN 'peer_upright' WHEN r4 IS NOT NULL THEN 'country' END AS rung,
  CASE WHEN s > 0 THEN -20 * ((exp(1.2 * s / 20) - exp(-1.2 * s / 20)) / (exp(1.2 * s / 20) + exp(-1.2 * s / 20))) ELSE 0 END AS overlay FROM full_scores f LEFT JOIN strong USING (company, pillar) LEFT JOIN rungs USING (company, pillar) LEFT JOIN bad_news USING (company, pillar)),
scored2 AS (SELECT *, greatest(0, least(100, CASE WHEN route = 'rich' THEN score WHEN prior IS NULL THEN 50 ELSE greatest(0, least(100, 50 + 15 * (prior - 50) / 50)) END + overlay)) AS formula FROM routes),
voted AS (SELECT s.*, CASE WHEN route = 'rich' THEN holistic END AS h, (CASE WHEN pillar = 'S' THEN 0.1::DOUBLE ELSE 0.7::DOUBLE END) * least(1, 0.4::DOUBLE + 0.04::DOUBLE * mass) AS a, (CASE WHEN pillar = 'S' THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END) * 0.5 AS b FROM scored2 s LEFT JOIN (SELECT company, holistic FROM predictions) USING (company)),
met2 AS (SELECT *, CASE WHEN h IS NULL THEN formula ELSE greatest(0, least(100, (a * formula + b * h) / (a + b))) END AS final, abs(formula - h) AS spread FROM voted),
wide2 AS (SELECT *, CASE WHEN spread IS NULL THEN 5.0::DOUBLE ELSE greatest(1, least(5, spread / 2 + 1)) END AS half, CASE WHEN spread IS NULL OR spread > 25 THEN 'low' WHEN spread <= 10 THEN 'high' ELSE 'medium' END AS label FROM met2)"""


@query("c09_routed_scores", _FULL + _ROUTES + """ SELECT company, pillar, route, CASE WHEN route = 'thin' THEN rung END AS rung, round(overlay, 6) AS overlay, round(formula, 6) AS formula, round(final, 6) AS score, label, CASE WHEN label = 'low' OR fired OR n = 0 THEN 'range' ELSE 'point' END AS mode FROM wide2""")
def _(t):
    parts, full = full_scores(t)
    own = t.spark.sql(_SECTORS).select("company", "country", "label", F.explode(F.array(*map(F.lit, "ESG"))).alias("pillar"))
    fuzzy = _votes(t, ["fuzzy_country", "fuzzy_global"]).select("company", "pillar", F.col("percentile").alias("peer_upright"))
    rungs = own.join(t.spark.sql(_MEDIANS), "label", "left").join(t.spark.sql(_INDUSTRY).withColumnsRenamed({"sector": "label", "percentile": "exio_structural"}), "label", "left").join(fuzzy, ["company", "pillar"], "left")
    rungs = rungs.join(t.spark.sql(_BASE).withColumnRenamed("baseline", "__base"), "country", "left").drop("country").withColumnRenamed("__base", "country")
    routes = routing.routed(full, t.claims.where("confidence >= 0.99 and strength > 0.98"), rungs, routing.severities(parts, _BAD))
    votes = routes.withColumnRenamed("score", "formula").join(t.predictions.select("company", "holistic"), "company", "left")
    out = C.gated(C.reconciled(votes.withColumn("holistic", routing.second_opinion(F.col("route"), F.col("holistic")))))
    return out.select("company", "pillar", "route", "rung", r6("overlay").alias("overlay"), r6("formula").alias("formula"), r6("score").alias("score"), "label", "mode")


# The second calculator: a factor of every fourth has a worst edge of 30, and companies have three badges.
_BADGES = "SELECT company, CASE WHEN market_id % 3 = 0 THEN NULL ELSE market_id % 3 = 1 END AS bribery, revenue > 0 AS certified, CASE WHEN revenue > 2000 THEN revenue > 6000 END AS whistle FROM companies"


@query("c23_assessed_scores", f"""{_SHARES}, sect AS ({_SECTORS}), industry AS ({_INDUSTRY}), based AS ({_BASE}), badges AS ({_BADGES}),
parts AS (SELECT p.company, p.pillar, p.weight, conf, weight * conf * delta AS points, CASE WHEN CAST(substr(p.factor, 2) AS int) % 4 = 3 AND b.value > 30 THEN log10(b.value / 30) * 4 * conf ELSE 0 END AS beyond FROM placed_claims p JOIN (SELECT company, factor, value FROM best) b USING (company, factor)),
sums AS (SELECT company, pillar, sum(points) AS points, sum(weight) AS supplied, coalesce(sum(beyond) FILTER (beyond > 0.01), 0) AS penalty, count(*) AS n, avg(conf) AS sure FROM parts GROUP BY company, pillar),
start AS (SELECT s.company, p.pillar, baseline AS cb, percentile AS ib, coalesce(points, 0) AS points, coalesce(supplied, 0) AS supplied, coalesce(penalty, 0) AS penalty, coalesce(n, 0) AS n, sure, (SELECT sum(weight) FROM factors) AS registered FROM sect s, (VALUES ('E'), ('S'), ('G')) p(pillar) LEFT JOIN based b ON b.country = s.country LEFT JOIN industry i ON i.sector = s.label LEFT JOIN sums x ON x.company = s.company AND x.pillar = p.pillar),
s1 AS (SELECT *, greatest(0, least(100, coalesce(cb, 50) + points)) AS a FROM start),
s2 AS (SELECT *, CASE WHEN ib IS NULL THEN a ELSE greatest(0, least(100, a + coalesce((cb + ib) / 2, ib) - coalesce(cb, 50))) END AS b FROM s1),
s3 AS (SELECT *, CASE WHEN supplied > 0 THEN points * (least(4, registered / supplied) - 1) ELSE 0 END AS extra FROM s2),
s4 AS (SELECT *, CASE WHEN supplied > 0 AND registered > supplied AND extra > 0 THEN b + (100 - b) * tanh(extra / greatest(100 - b, 0.000001)) WHEN supplied > 0 AND registered > supplied AND extra < 0 THEN b - b * tanh(-extra / greatest(b, 0.000001)) ELSE b END AS c FROM s3),
s5 AS (SELECT s4.*, greatest(0, least(100, c - penalty)) AS d, CASE WHEN bribery THEN 3 WHEN NOT bribery THEN -3 ELSE 0 END + CASE WHEN certified THEN 3 WHEN NOT certified THEN -3 ELSE 0 END + CASE WHEN whistle THEN 3 WHEN NOT whistle THEN -3 ELSE 0 END AS badge FROM s4 JOIN badges USING (company)),
s6 AS (SELECT *, CASE WHEN pillar = 'G' THEN greatest(0, least(100, d + badge)) ELSE d END AS score, CASE WHEN cb IS NULL AND ib IS NULL AND n = 0 THEN 50 WHEN cb IS NOT NULL AND ib IS NOT NULL THEN 5 WHEN (cb IS NOT NULL OR ib IS NOT NULL) AND n >= 2 AND sure >= 0.6 THEN 5 WHEN cb IS NOT NULL OR ib IS NOT NULL THEN 8 ELSE 15 END AS half FROM s5)
SELECT company, pillar, round(score, 6) AS score, round(greatest(0, score - half), 6) AS low, round(least(100, score + half), 6) AS high, CASE WHEN cb IS NOT NULL OR ib IS NOT NULL THEN 'high' WHEN n >= 2 AND sure >= 0.6 THEN 'medium' ELSE 'low' END AS label, round(penalty, 6) AS penalty, n AS n_claims FROM s6""".replace("placed AS (SELECT company, pillar, factor, weight, seq", "placed_claims AS (SELECT company, pillar, factor, weight, seq", 1))
def _(t):
    t.peers.createOrReplaceTempView("peers")
    t.companies.createOrReplaceTempView("companies")
    lower = F.expr("CAST(substr(factor, 2) AS int) % 4 = 3")
    parts = _placed(t).withColumn("beyond", F.coalesce(calculators.overflow(F.col("value"), F.lit(30.0), lower, F.col("confidence")), F.lit(0.0)))
    total = t.factors.agg(F.sum("weight").alias("registered"))  # one row
    rows = t.spark.sql(_SECTORS).select("company", "country", "label", F.explode(F.array(*map(F.lit, "ESG"))).alias("pillar")).join(t.spark.sql(_BASE).withColumnRenamed("baseline", "country_baseline"), "country", "left")
    rows = rows.join(t.spark.sql(_INDUSTRY).withColumnsRenamed({"sector": "label", "percentile": "industry_baseline"}), "label", "left").drop("label").join(t.spark.sql(_BADGES), "company").join(F.broadcast(total))
    out = calculators.assessed(parts, rows, calculators.badge_points(F.col("bribery"), F.col("certified"), F.col("whistle")))
    return out.select("company", "pillar", *(r6(c).alias(c) for c in ("score", "low", "high")), "label", r6("penalty").alias("penalty"), "n_claims")
