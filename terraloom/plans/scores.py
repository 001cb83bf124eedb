"""Claims, peers, baselines, votes, reports and calibration."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import claims as C
from ..operators import ranking
from .base import query

r6 = lambda c: F.round(c, 6)

_TRUST = "CASE method WHEN 'dataset_lookup' THEN 1.0::DOUBLE WHEN 'extracted' THEN 0.9::DOUBLE WHEN 'peer_ratio_fallback' THEN 0.7::DOUBLE WHEN 'coarse_bucket' THEN 0.5::DOUBLE WHEN 'peer_anchor' THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END"
_RANK = "CASE method WHEN 'dataset_lookup' THEN 3 WHEN 'extracted' THEN 2 WHEN 'peer_ratio_fallback' THEN 1 ELSE 0 END"
_REDUCE = f"""
mass AS (SELECT company, pillar, sum(weight * confidence * {_TRUST}) AS mass, sum(weight * confidence * {_TRUST} * delta) AS num, sum(weight) AS den, count(*) AS n_claims FROM contributions GROUP BY company, pillar),
state AS (SELECT m.*, mass < 2.5 AS gate_fired, CASE WHEN mass < 2.5 OR den <= 0 THEN 0.0::DOUBLE ELSE greatest(-1, least(1, num / den)) END AS delta,
  CASE WHEN mass < 2.5 THEN 0.0::DOUBLE ELSE greatest(0, least(1, den / weight_sum)) END AS coverage FROM mass m LEFT JOIN sums USING (pillar)),
termed AS (SELECT *, (CASE WHEN pillar = 'S' THEN 200.0::DOUBLE WHEN pillar = 'G' AND delta < 0 THEN 160.0::DOUBLE ELSE 40.0::DOUBLE END) * ((exp(delta) - exp(-delta)) / (exp(delta) + exp(-delta))) * (0.6::DOUBLE + 0.4::DOUBLE * coverage) AS term FROM state)
"""


def _event_contributions(t):
    """Latest best claim of each user and event type."""
    pillar = F.when(F.col("event_type").isin("click", "view"), "E").when(F.col("event_type").isin("signup", "purchase"), "S").otherwise("G")
    rows = t.events.select(
        F.col("user_id").alias("company"), pillar.alias("pillar"), F.col("event_type").alias("factor"), F.col("event_id").alias("seq"), F.lit("extracted").alias("method"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"), F.least(F.col("value") / 500, F.lit(1.0)).alias("strength"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("polarity"), F.lit(8.0).alias("weight"),
    )
    return C.best_claims(rows, ["company", "factor"]).withColumn("delta", F.col("polarity") * F.col("strength"))


_EVENTS = """WITH raw AS (SELECT user_id AS company, CASE WHEN event_type IN ('click', 'view') THEN 'E' WHEN event_type IN ('signup', 'purchase') THEN 'S' ELSE 'G' END AS pillar,
  event_type AS factor, event_id AS seq, 'extracted' AS method, (props->>'$.k')::DOUBLE / 100 AS confidence, least(value / 500, 1.0::DOUBLE) AS strength, CASE event_type WHEN 'error' THEN -1 ELSE 1 END AS polarity FROM events),
contributions AS (SELECT company, pillar, factor, method, confidence, 8.0::DOUBLE AS weight, polarity * strength AS delta FROM raw QUALIFY row_number() OVER (PARTITION BY company, factor ORDER BY confidence DESC, seq) = 1),
sums AS (SELECT * FROM (VALUES ('E', 16.0::DOUBLE), ('S', 16.0::DOUBLE), ('G', 8.0::DOUBLE)) v(pillar, weight_sum)),""" + _REDUCE


@query("pillar_scores", _EVENTS + "SELECT company, pillar, round(mass, 6) AS mass, gate_fired, round(CASE WHEN term <> 0 THEN greatest(0, least(100, 50 + term)) ELSE 50 END, 6) AS score FROM termed")
def _(t):
    sums = t.events.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pillar"), F.lit(w).alias("weight_sum")) for p, w in (("E", 16.0), ("S", 16.0), ("G", 8.0))])).alias("x")).select("x.*").distinct()
    return C.pillar_reduction(_event_contributions(t), sums).select("company", "pillar", r6("mass").alias("mass"), "gate_fired", r6("score").alias("score"))


@query("a19_best_claim", f"SELECT company, factor, seq, confidence, method FROM claims QUALIFY row_number() OVER (PARTITION BY company, factor ORDER BY confidence DESC, {_RANK} DESC, seq) = 1")
def _(t):
    return C.best_claims(t.claims, ["company", "factor"]).select("company", "factor", "seq", "confidence", "method")


_SCORED = f"""WITH best AS (SELECT c.*, weight, full_value, none_value FROM claims c JOIN factors USING (factor) QUALIFY row_number() OVER (PARTITION BY company, pillar, c.factor ORDER BY confidence DESC, {_RANK} DESC, seq) = 1),
contributions AS (SELECT company, pillar, factor, method, confidence, weight, CASE WHEN seq % 2 = 0 THEN 2 * greatest(0, least(1, (value - none_value) / (full_value - none_value))) - 1 ELSE polarity * strength END AS delta FROM best),
sums AS (SELECT 'E' AS pillar, sum(weight) AS weight_sum FROM factors UNION ALL SELECT 'S', sum(weight) FROM factors UNION ALL SELECT 'G', sum(weight) FROM factors),""" + _REDUCE


def _contributions(t, claims=None):
    best = C.best_claims((claims or t.claims).join(t.factors, "factor"), ["company", "pillar", "factor"])
    band = scoring.band_delta(F.col("value"), F.col("full_value"), F.col("none_value"))
    return best.withColumn("delta", F.when(F.col("seq") % 2 == 0, band).otherwise(F.col("polarity") * F.col("strength")))


def _reduced(t, claims=None, contributions=None):
    sums = t.factors.agg(F.sum("weight").alias("weight_sum")).select(F.explode(F.array(*map(F.lit, "ESG"))).alias("pillar"), "weight_sum")
    return C.pillar_reduction(_contributions(t, claims) if contributions is None else contributions, sums)


@query("c02_formula_scores", _SCORED + "SELECT company, pillar, n_claims, gate_fired, round(mass, 6) AS mass, round(delta, 6) AS delta, round(coverage, 6) AS coverage, round(CASE WHEN term <> 0 THEN greatest(0, least(100, 50 + term)) ELSE 50 END, 6) AS score FROM termed")
def _(t):
    return _reduced(t).select("company", "pillar", "n_claims", "gate_fired", r6("mass").alias("mass"), r6("delta").alias("delta"), r6("coverage").alias("coverage"), r6("score").alias("score"))


@query("a24_controversy_overlay", _SCORED + "SELECT company, pillar, round(s, 6) AS severity, round(CASE WHEN s > 0 THEN -20 * ((exp(1.2 * s / 20) - exp(-1.2 * s / 20)) / (exp(1.2 * s / 20) + exp(-1.2 * s / 20))) ELSE 0 END, 6) AS points FROM (SELECT company, pillar, CAST(coalesce(sum(weight * confidence * -delta) FILTER (factor IN ('f1', 'f4', 'f7', 'f10') AND delta < 0), 0) AS double) AS s FROM contributions GROUP BY company, pillar)")
def _(t):
    severity = F.when(F.col("factor").isin("f1", "f4", "f7", "f10") & (F.col("delta") < 0), F.col("weight") * F.col("confidence") * -F.col("delta")).otherwise(0.0)
    out = _contributions(t).groupBy("company", "pillar").agg(F.sum(severity).alias("s"))
    return out.select("company", "pillar", r6("s").alias("severity"), r6(scoring.overlay(F.col("s"))).alias("points"))


@query("c07_ladder_blend", _SCORED + "SELECT company, pillar, round(greatest(0, least(100, 50 + w * term + (1 - w) * coalesce(15 * (prior - 50) / 50, 0))), 6) AS score, rung FROM (SELECT t.company, t.pillar, term, i.p AS i, c.p AS c, coalesce(i.p, c.p) AS prior, CASE WHEN coalesce(i.p, c.p) IS NULL THEN 1 ELSE mass / (mass + 2.5) END AS w, CASE WHEN i.p IS NOT NULL THEN 'industry' WHEN c.p IS NOT NULL THEN 'country' ELSE 'none' END AS rung FROM termed t JOIN companies k USING (company) LEFT JOIN (SELECT market_id, 50 + avg(revenue) / 1000 AS p FROM companies GROUP BY market_id HAVING avg(revenue) > 4500) i USING (market_id) LEFT JOIN (SELECT country, avg(score) / 100 AS p FROM peers WHERE sector = 'BUILDING' GROUP BY country) c ON c.country = k.country)")
def _(t):
    industry = t.companies.groupBy("market_id").agg(F.avg("revenue").alias("mean")).where("mean > 4500").select("market_id", (50 + F.col("mean") / 1000).alias("i"))
    country = t.peers.where("sector = 'BUILDING'").groupBy("country").agg((F.avg("score") / 100).alias("c"))
    rows = _reduced(t).withColumnRenamed("score", "own").join(t.companies, "company").join(industry, "market_id", "left").join(country, "country", "left")
    rung = F.when(F.col("i").isNotNull(), "industry").when(F.col("c").isNotNull(), "country").otherwise("none")
    return rows.select("company", "pillar", r6(scoring.blended(F.col("term"), F.col("mass"), F.coalesce("i", "c"))).alias("score"), rung.alias("rung"))


@query("c01_validated_claims", """WITH texts AS (SELECT company, source_tag, max(length(text)) AS n FROM signals WHERE source_tag <> 's3' GROUP BY company, source_tag),
a AS (SELECT c.*, CASE WHEN c.value < 0 OR (factor IN ('f2', 'f3') AND c.value > 100) THEN NULL ELSE c.value END AS v, CASE WHEN polarity = 0 AND strength >= 1 THEN confidence * 0.5 ELSE confidence END AS c1, n FROM claims c LEFT JOIN texts USING (company, source_tag)),
b AS (SELECT *, CASE WHEN n < 200 AND c1 > 0.7 THEN 0.5 ELSE c1 END AS c2 FROM a),
alone AS (SELECT company, factor, count(DISTINCT source_tag) = 1 AS one FROM claims WHERE polarity = -1 GROUP BY company, factor)
SELECT seq, v AS value, round(CASE WHEN polarity = -1 AND one THEN c2 * 0.7 ELSE c2 END, 6) AS confidence FROM b LEFT JOIN alone USING (company, factor)""")
def _(t):
    texts = t.signals.where("source_tag <> 's3'").groupBy("company", "source_tag").agg(F.max(F.length("text")).alias("n"))
    rows = t.claims.join(texts, ["company", "source_tag"], "left")
    return C.validated(rows, "n", F.col("factor").isin("f2", "f3")).select("seq", "value", r6("confidence").alias("confidence"))


@query("a26_corroboration", "SELECT company, factor, count(DISTINCT source_tag) AS n_sources, count(*) AS n FROM claims WHERE polarity = -1 GROUP BY company, factor HAVING count(DISTINCT source_tag) = 1")
def _(t):
    return t.claims.where("polarity = -1").groupBy("company", "factor").agg(F.count_distinct("source_tag").alias("n_sources"), F.count("*").alias("n")).where("n_sources = 1")


@query("a27_dense_presence", "SELECT company, pillar, count(seq) AS n, count(seq) = 0 AS thin FROM (SELECT company, p.pillar FROM companies, (VALUES ('E'), ('S'), ('G')) p(pillar)) d LEFT JOIN (SELECT * FROM claims WHERE confidence >= 0.99 AND strength > 0.95) c USING (company, pillar) GROUP BY company, pillar")
def _(t):
    dense = t.companies.select("company", F.explode(F.array(*map(F.lit, "ESG"))).alias("pillar"))
    strong = t.claims.where("confidence >= 0.99 and strength > 0.95").groupBy("company", "pillar").agg(F.count("*").alias("n"))
    out = dense.join(strong, ["company", "pillar"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("company", "pillar", "n", (F.col("n") == 0).alias("thin"))


@query("x41_freshness", "SELECT seq, round(CASE WHEN reported IS NULL THEN 0.6 ELSE greatest(0.5, exp(-greatest(0, date_diff('day', reported::DATE, DATE '2002-01-01')) / 365.0)) END, 6) AS fresh FROM claims")
def _(t):
    from ..functions.text import freshness

    return t.claims.select("seq", r6(freshness(F.to_date("reported"), F.lit("2002-01-01").cast("date"))).alias("fresh"))


@query("m15_coerced_claims", "SELECT event_id, CASE WHEN k IN (-1, 0, 1) THEN k ELSE 0 END AS polarity, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(value / 300, 0.5))) AS strength, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce((props->>'$.k')::DOUBLE / 90, 0.4))) AS confidence FROM (SELECT *, CAST(event_id % 5 - 2 AS int) AS k FROM events)")
def _(t):
    p, s, c = C.coerce((F.col("event_id") % 5 - 2).cast("int"), F.col("value") / 300, F.get_json_object("props", "$.k").cast("double") / 90)
    return t.events.select("event_id", p.alias("polarity"), s.alias("strength"), c.alias("confidence"))


_VOTES = """WITH v AS (SELECT company, pillar, predicted, holistic, mass, (CASE WHEN pillar = 'S' THEN 0.1::DOUBLE ELSE 0.7::DOUBLE END) * least(1, 0.4::DOUBLE + 0.04::DOUBLE * mass) AS a, (CASE WHEN pillar = 'S' THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END) * 0.5 AS b, n_claims FROM predictions),
s AS (SELECT *, CASE WHEN holistic IS NULL THEN predicted ELSE greatest(0, least(100, (a * predicted + b * holistic) / (a + b))) END AS score, abs(predicted - holistic) AS spread FROM v),
r AS (SELECT *, CASE WHEN spread IS NULL THEN 5.0::DOUBLE ELSE greatest(1, least(5, spread / 2 + 1)) END AS half, CASE WHEN spread IS NULL OR spread > 25 THEN 'low' WHEN spread <= 10 THEN 'high' ELSE 'medium' END AS label FROM s)"""


def _votes(t):
    return C.reconciled(t.predictions.withColumnRenamed("predicted", "formula"))


@query("a23_reconciled_votes", _VOTES + "SELECT company, pillar, round(score, 6) AS score, round(greatest(0, score - half), 6) AS low, round(least(100, score + half), 6) AS high, spread, label FROM r")
def _(t):
    return _votes(t).select("company", "pillar", r6("score").alias("score"), r6("low").alias("low"), r6("high").alias("high"), "spread", "label")


@query("c10_confidence_gate", _VOTES + "SELECT company, pillar, CASE WHEN label = 'low' OR mass < 2.5 OR n_claims = 0 THEN 'range' ELSE 'point' END AS mode, (label = 'low' OR mass < 2.5 OR n_claims = 0) AS needs_review FROM r")
def _(t):
    return C.gated(_votes(t).withColumn("gate_fired", F.col("mass") < 2.5)).select("company", "pillar", "mode", "needs_review")


@query("a28_majority_vote", """WITH v AS (SELECT user_id AS claim, event_id AS seq, CASE event_type WHEN 'error' THEN 'refute' WHEN 'click' THEN 'pass' WHEN 'purchase' THEN 'refute' ELSE 'abstain' END AS verdict, concat('f', CAST(event_id % 3 AS string)) AS flagged FROM events),
c AS (SELECT claim, flagged FROM (SELECT claim, flagged, count(*) AS n, min(seq) AS seq FROM v WHERE verdict = 'refute' GROUP BY claim, flagged HAVING count(*) >= 2) QUALIFY row_number() OVER (PARTITION BY claim ORDER BY seq) = 1),
b AS (SELECT claim, count(*) FILTER (verdict = 'refute') AS n_refute, count(*) FILTER (verdict <> 'abstain') AS n_answer FROM v GROUP BY claim)
SELECT claim, n_refute, n_answer, CASE WHEN n_answer < 2 THEN 'inconclusive' WHEN n_refute >= 2 THEN 'refuted' ELSE 'pass' END AS outcome, flagged AS converged FROM b LEFT JOIN c USING (claim)""")
def _(t):
    verdict = F.when(F.col("event_type").isin("error", "purchase"), "refute").when(F.col("event_type") == "click", "pass").otherwise("abstain")
    rows = t.events.select(F.col("user_id").alias("claim"), F.col("event_id").alias("seq"), verdict.alias("verdict"), F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("flagged"))
    return C.majority(rows, ["claim"])


@query("w01_midrank_percentile", "SELECT peer_id, round(100 * (rank() OVER (PARTITION BY sector ORDER BY floor(score / 100)) - 1 + count(*) OVER (PARTITION BY sector, floor(score / 100)) / 2) / count(*) OVER (PARTITION BY sector), 6) AS percentile FROM peers WHERE score IS NOT NULL")
def _(t):
    rows = t.peers.withColumn("step", F.floor(F.col("score") / 100))
    return ranking.midrank_percentile(rows, ["sector"], "step").select("peer_id", r6("percentile").alias("percentile"))


@query("w02_inclusive_percentile", "SELECT peer_id, round(100 * cume_dist() OVER (PARTITION BY sector ORDER BY score), 6) AS percentile FROM peers WHERE score IS NOT NULL")
def _(t):
    return ranking.inclusive_percentile(t.peers.where("score is not null"), ["sector"], "score").select("peer_id", r6("percentile").alias("percentile"))


@query("w03_rank_position", "SELECT country, round((row_number() OVER (ORDER BY total, country) - 1) / (count(*) OVER () - 1)::DOUBLE, 6) AS place FROM (SELECT country, sum(score) AS total FROM peers GROUP BY country)")
def _(t):
    totals = t.peers.groupBy("country").agg(F.sum("score").alias("total"))
    return totals.select("country", r6((F.row_number().over(W.orderBy("total", "country")) - 1) / (F.count("*").over(W.partitionBy()) - 1)).alias("place"))


@query("w06_average_rank", "SELECT company, rank() OVER (PARTITION BY pillar ORDER BY predicted) + (count(*) OVER (PARTITION BY pillar, predicted) - 1) / 2 AS place FROM predictions")
def _(t):
    return ranking.with_average_rank(t.predictions.select("company", "pillar", "predicted"), ["pillar"], "predicted", "place").select("company", "place")


@query("a34_spearman", "WITH b AS (SELECT pillar, rank() OVER (PARTITION BY pillar ORDER BY predicted) + (count(*) OVER (PARTITION BY pillar, predicted) - 1) / 2 AS a, rank() OVER (PARTITION BY pillar ORDER BY truth) + (count(*) OVER (PARTITION BY pillar, truth) - 1) / 2 AS b FROM predictions WHERE truth IS NOT NULL) SELECT pillar, count(*) AS n, round(corr(a, b), 6) AS rho FROM b GROUP BY pillar")
def _(t):
    out = ranking.spearman(t.predictions, ["pillar"], "predicted", "truth")
    return out.select("pillar", "n", r6("rho").alias("rho"))


@query("a35_percentile_error", "WITH b AS (SELECT pillar, rank() OVER (PARTITION BY pillar ORDER BY predicted) + (count(*) OVER (PARTITION BY pillar, predicted) - 1) / 2 AS a, rank() OVER (PARTITION BY pillar ORDER BY truth) + (count(*) OVER (PARTITION BY pillar, truth) - 1) / 2 AS b, count(*) OVER (PARTITION BY pillar) AS n FROM predictions WHERE truth IS NOT NULL) SELECT pillar, round(avg(abs(a / n - b / n)), 6) AS mae FROM b GROUP BY pillar")
def _(t):
    return ranking.percentile_error(t.predictions, ["pillar"], "predicted", "truth").select("pillar", r6("mae").alias("mae"))


@query("a36_calibration_report", _VOTES + "SELECT pillar, label, count(*) AS n, round(avg(abs(score - truth)), 6) AS mean_error, round(avg((truth BETWEEN score - half AND score + half)::INT), 6) AS covered, round(avg(half * 2), 6) AS width FROM (SELECT r.*, truth FROM r JOIN predictions USING (company) WHERE truth IS NOT NULL) GROUP BY pillar, label")
def _(t):
    half = scoring.half_width(F.col("spread"))
    rows = _votes(t).where("truth is not null").withColumn("half", half)
    inside = F.col("truth").between(F.col("score") - F.col("half"), F.col("score") + F.col("half")).cast("int")
    return rows.groupBy("pillar", "label").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("score") - F.col("truth")))).alias("mean_error"), r6(F.avg(inside)).alias("covered"), r6(F.avg(F.col("half") * 2)).alias("width"))


@query("a37_precision_recall", "WITH p AS (SELECT DISTINCT o_custkey % 20 AS market, o_custkey AS found FROM orders WHERE o_orderstatus = 'F'), g AS (SELECT DISTINCT c_custkey % 20 AS market, c_custkey AS found FROM customer WHERE c_acctbal > 3000), b AS (SELECT coalesce(p.market, g.market) AS market, p.found IS NOT NULL AS said, g.found IS NOT NULL AS gold FROM p FULL JOIN g ON p.found = g.found) SELECT market, tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS prec, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1 FROM (SELECT market, count(*) FILTER (said AND gold) AS tp, count(*) FILTER (said AND NOT gold) AS fp, count(*) FILTER (gold AND NOT said) AS fn FROM b GROUP BY market)")
def _(t):
    said = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("found")).distinct().withColumn("said", F.lit(True))
    gold = t.customer.where("c_acctbal > 3000").select(F.col("c_custkey").alias("found")).distinct().withColumn("gold", F.lit(True))
    rows = said.join(gold, "found", "full").select((F.col("found") % 20).alias("market"), F.col("said").isNotNull().alias("said"), F.col("gold").isNotNull().alias("gold"))
    c = rows.groupBy("market").agg(F.count_if(F.col("said") & F.col("gold")).alias("tp"), F.count_if(F.col("said") & ~F.col("gold")).alias("fp"), F.count_if(~F.col("said") & F.col("gold")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("market", "tp", "fp", "fn", r6(F.try_divide(tp, tp + fp)).alias("prec"), r6(F.try_divide(tp, tp + fn)).alias("recall"), r6(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"))


@query("c16_country_baselines", """WITH latest AS (SELECT iso, indicator, max_by(value, CAST(year AS bigint) * 100000000 + seq) AS value, max(year) AS year FROM indicators WHERE value IS NOT NULL GROUP BY iso, indicator),
norm AS (SELECT *, CASE WHEN lo = hi THEN 50 WHEN indicator IN ('i1', 'i5') THEN 100 - 100 * (value - lo) / (hi - lo) ELSE 100 * (value - lo) / (hi - lo) END AS norm FROM (SELECT *, min(value) OVER (PARTITION BY indicator) AS lo, max(value) OVER (PARTITION BY indicator) AS hi FROM latest)),
p AS (SELECT iso, CASE CAST(substr(indicator, 2) AS int) % 3 WHEN 0 THEN 'E' WHEN 1 THEN 'S' ELSE 'G' END AS pillar, norm, year FROM norm)
SELECT iso, pillar, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 50 ELSE avg(norm) END, 6) AS score, CAST(floor(median(year)) AS int) AS year FROM p GROUP BY iso, pillar""")
def _(t):
    key = F.col("year") * F.lit(100000000).cast("long") + F.col("seq")
    latest = t.indicators.where("value is not null").groupBy("iso", "indicator").agg(F.max_by("value", key).alias("value"), F.max("year").alias("year"))
    norm = C.normalised_indicators(latest, "iso", "indicator", "value", ["i1", "i5"])
    third = F.substring("indicator", 2, 9).cast("int") % 3
    rows = norm.withColumn("pillar", F.when(third == 0, "E").when(third == 1, "S").otherwise("G"))
    return rows.groupBy("iso", "pillar").agg(F.count("*").alias("n"), r6(F.when(F.count("*") < 2, 50.0).otherwise(F.avg("norm"))).alias("score"), F.median("year").cast("int").alias("year"))


@query("a18_component_percentiles", "WITH u AS (SELECT peer_id, sector, 'workers' AS part, workers AS value FROM peers UNION ALL SELECT peer_id, sector, 'community', community FROM peers UNION ALL SELECT peer_id, sector, 'customers', customers FROM peers), r AS (SELECT *, 100 * (rank() OVER (PARTITION BY part ORDER BY value) - 1 + count(*) OVER (PARTITION BY part, value) / 2) / count(*) OVER (PARTITION BY part) AS pct FROM u WHERE value IS NOT NULL) SELECT peer_id, round(avg(CASE part WHEN 'customers' THEN 100 - pct ELSE pct END), 6) AS proxy, count(*) AS n FROM r GROUP BY peer_id")
def _(t):
    parts = t.peers.unpivot(["peer_id"], ["workers", "community", "customers"], "part", "value")
    pct = ranking.midrank_percentile(parts, ["part"], "value", "pct")
    return pct.groupBy("peer_id").agg(r6(F.avg(F.when(F.col("part") == "customers", 100 - F.col("pct")).otherwise(F.col("pct")))).alias("proxy"), F.count("*").alias("n"))


@query("c04_peer_tiers", "WITH a AS (SELECT company, median(p.score) AS m, count(p.score) AS n FROM companies c JOIN peers p ON p.country = c.country AND p.sector = 'BUILDING' GROUP BY company), b AS (SELECT company, median(p.score) AS m, count(p.score) AS n FROM companies c JOIN peers p ON p.country = c.country GROUP BY company) SELECT company, CASE WHEN a.n >= 12 THEN 'sector_country' WHEN b.n >= 50 THEN 'country' ELSE 'none' END AS tier, round(CASE WHEN a.n >= 12 THEN a.m WHEN b.n >= 50 THEN b.m END, 6) AS anchor FROM companies LEFT JOIN a USING (company) LEFT JOIN b USING (company)")
def _(t):
    near = t.peers.where("sector = 'BUILDING'").groupBy("country").agg(F.median("score").alias("m1"), F.count("score").alias("n1"))
    wide = t.peers.groupBy("country").agg(F.median("score").alias("m2"), F.count("score").alias("n2"))
    rows = t.companies.join(near, "country", "left").join(wide, "country", "left")
    one, two = F.col("n1") >= 12, F.col("n2") >= 50
    return rows.select("company", F.when(one, "sector_country").when(two, "country").otherwise("none").alias("tier"), r6(F.when(one, F.col("m1")).when(two, F.col("m2"))).alias("anchor"))


@query("d07_newest_per_company", "SELECT company, metric, reporting_year, numeric_value FROM metric_values QUALIFY row_number() OVER (PARTITION BY company, metric ORDER BY reporting_year DESC NULLS LAST, seq) = 1")
def _(t):
    return ranking.first_per_key(t.metric_values, ["company", "metric"], F.desc_nulls_last("reporting_year"), F.col("seq")).select("company", "metric", "reporting_year", "numeric_value")


_TIERED = "SELECT company, metric, seq, source, numeric_value FROM metric_values WHERE (source IS NULL OR source <> 'wikirate') AND numeric_value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company, metric ORDER BY CASE WHEN source = 'agentic_correction' THEN 2 WHEN source = 'agentic_estimate' THEN 0 ELSE 1 END DESC, coalesce(reporting_year, 0) DESC, CASE source WHEN 'report' THEN 3 ELSE 0 END DESC, seq, numeric_value) = 1"


def _tiered(t):
    rows = t.metric_values.where("(source is null or source <> 'wikirate') and numeric_value is not null")
    tier = F.when(F.col("source") == "agentic_correction", 2).when(F.col("source") == "agentic_estimate", 0).otherwise(1)
    return ranking.first_per_key(rows, ["company", "metric"], tier.desc(), F.coalesce("reporting_year", F.lit(0)).desc(), F.when(F.col("source") == "report", 3).otherwise(0).desc(), F.col("seq"), F.col("numeric_value"))


@query("d09_provenance_tiers", _TIERED)
def _(t):
    return _tiered(t).select("company", "metric", "seq", "source", "numeric_value")


@query("c18_market_report", f"WITH d AS ({_TIERED}), s AS (SELECT company, category, CASE WHEN higher_is_better THEN 100 * greatest(0, least(1, numeric_value / 50)) ELSE 100 - 100 * greatest(0, least(1, numeric_value / 50)) END AS score FROM d JOIN metric_definitions USING (metric)), p AS (SELECT company, category, avg(score) AS score FROM s GROUP BY company, category), w AS (SELECT company, sum(CASE category WHEN 'E' THEN 0.4::DOUBLE * score WHEN 'S' THEN 0.35::DOUBLE * score ELSE 0.25::DOUBLE * score END) AS total, count(*) AS n_pillars FROM p GROUP BY company) SELECT company, round(total, 6) AS total, n_pillars, CASE WHEN total >= 75 THEN 'leader' WHEN total >= 50 THEN 'average' WHEN total >= 25 THEN 'laggard' ELSE 'poor' END AS band FROM w")
def _(t):
    rows = _tiered(t).join(t.metric_definitions, "metric")
    up = scoring.band_score(F.col("numeric_value"), F.lit(50.0), F.lit(0.0))
    pillar = rows.select("company", "category", F.when(F.col("higher_is_better"), up).otherwise(100 - up).alias("score")).groupBy("company", "category").agg(F.avg("score").alias("score"))
    share = F.when(F.col("category") == "E", 0.4).when(F.col("category") == "S", 0.35).otherwise(0.25)
    out = pillar.groupBy("company").agg(F.sum(share * F.col("score")).alias("raw"), F.count("*").alias("n_pillars"))
    # a total that stands on the edge of a band reaches it, in whatever order its parts were added up: the order moves its 14th decimal
    return out.select("company", r6("raw").alias("total"), "n_pillars", scoring.rating_band(F.round("raw", 12)).alias("band"))


@query("c13_ratio_estimates", "WITH r AS (SELECT country, median(workers / nullif(customers, 0)) AS ratio, count(workers / nullif(customers, 0)) AS n FROM peers GROUP BY country) SELECT company, round(CASE WHEN n >= 15 THEN ratio * revenue END, 6) AS estimate, CASE WHEN n >= 30 THEN 0.3::DOUBLE WHEN n >= 15 THEN 0.2::DOUBLE END AS confidence FROM companies LEFT JOIN r USING (country)")
def _(t):
    ratio = F.col("workers") / F.nullif(F.col("customers"), F.lit(0.0))
    per = t.peers.groupBy("country").agg(F.median(ratio).alias("ratio"), F.count(ratio).alias("n"))
    rows = t.companies.join(per, "country", "left")
    return rows.select("company", r6(F.when(F.col("n") >= 15, F.col("ratio") * F.col("revenue"))).alias("estimate"), F.when(F.col("n") >= 30, 0.3).when(F.col("n") >= 15, 0.2).alias("confidence"))


@query("c19_estimation_plan", "SELECT company, CASE WHEN revenue IS NULL OR revenue <= 0 THEN 'needs_revenue' WHEN n >= 4 THEN 'ready' WHEN n > 0 THEN 'partial' ELSE 'pending' END AS plan FROM companies LEFT JOIN (SELECT company, count(DISTINCT metric) AS n FROM metric_values WHERE numeric_value > 48 GROUP BY company) USING (company)")
def _(t):
    rich = t.metric_values.where("numeric_value > 48").groupBy("company").agg(F.count_distinct("metric").alias("n"))
    plan = F.when(F.col("revenue").isNull() | (F.col("revenue") <= 0), "needs_revenue").when(F.col("n") >= 4, "ready").when(F.col("n") > 0, "partial").otherwise("pending")
    return t.companies.join(rich, "company", "left").select("company", plan.alias("plan"))


@query("c21_metric_linking", "SELECT n_nationkey AS market_id, metric FROM nation, metric_definitions WHERE is_universal OR (category = 'E' AND n_nationkey % 2 = 0)")
def _(t):
    kinds = t.nation.select(F.col("n_nationkey").alias("market_id"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("all"), F.lit("E"))).otherwise(F.array(F.lit("all"))).alias("k")).select("market_id", F.explode("k").alias("kind"))
    offered = t.metric_definitions.select("metric", F.explode(F.array_compact(F.array(F.when(F.col("is_universal"), "all"), F.when(F.col("category") == "E", "E")))).alias("kind"))
    return kinds.join(offered, "kind").select("market_id", "metric").distinct()


@query("c23_self_assessment", "SELECT o_custkey, round(sum(d * 2.51279 + p * 2.0844 + e * 0.445), 4) AS kg, round(greatest(0, least(100, 50 + 50 * (1 - sum(d * 2.51279 + p * 2.0844 + e * 0.445) / nullif(sum(o_totalprice), 0)))), 6) AS score FROM (SELECT *, o_totalprice * 0.1::DOUBLE AS d, o_totalprice * 0.05::DOUBLE AS p, o_totalprice * 0.5::DOUBLE AS e FROM orders) GROUP BY o_custkey")
def _(t):
    kg = F.col("o_totalprice") * 0.1 * 2.51279 + F.col("o_totalprice") * 0.05 * 2.0844 + F.col("o_totalprice") * 0.5 * 0.445
    out = t.orders.groupBy("o_custkey").agg(F.sum(kg).alias("raw"), F.sum("o_totalprice").alias("spent"))
    return out.select("o_custkey", F.round("raw", 4).alias("kg"), r6(scoring.clamp(50 + 50 * (1 - F.col("raw") / F.nullif(F.col("spent"), F.lit(0.0))), 0.0, 100.0)).alias("score"))
