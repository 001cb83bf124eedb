"""Verification of pillar scores by panels of critics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import routing, verification
from ..session import checkpointed
from .base import query
from .scores import _RANK, _TRUST, _contributions, _reduced, r6

KEYS = ["company", "pillar"]


def scored(t, contributions: DataFrame) -> DataFrame:
    """Gated scores of the formula and of the company's second opinion."""
    formula = _reduced(t, contributions=contributions).select(*KEYS, F.col("score").alias("formula"), "mass", "gate_fired", "n_claims")
    votes = formula.join(t.predictions.select("company", "holistic"), "company", "left")
    return C.gated(C.reconciled(votes)).withColumn("basis", F.lit("evidence"))


def rescored(t, requests: DataFrame) -> DataFrame:
    """The requests that could be read again: texts of sources s0 to s2 don't bear the flagged factor out."""
    asked = requests.select(*KEYS, F.col("factor").alias("flag")).where("CAST(substr(company, 2) AS int) % 4 <> 0")
    claims = checkpointed(t.claims.join(asked, KEYS))
    flagged = F.col("factor") == F.col("flag")
    kept = claims.where(~((F.col("method") == "extracted") & flagged & F.col("source_tag").isin("s0", "s1", "s2")))
    reading = F.concat_ws(":", "source_tag", "value")
    same = verification.same_reading(claims.where(flagged).withColumn("reading", reading), kept.where(flagged).withColumn("reading", reading), KEYS)
    new = asked.select(*KEYS).join(scored(t, _contributions(t, kept.drop("flag"))), KEYS, "left").join(same, KEYS, "left")
    return new.select(*KEYS, "same", F.coalesce("mode", F.lit("range")).alias("mode"), F.coalesce("label", F.lit("low")).alias("label"), F.coalesce("score", F.lit(50.0)).alias("score"), F.coalesce("low", F.lit(45.0)).alias("low"), F.coalesce("high", F.lit(55.0)).alias("high"), F.coalesce("needs_review", F.lit(True)).alias("needs_review"))


def _scored_sql(name: str, claims: str) -> str:
    return f"""best_{name} AS (SELECT c.*, weight, full_value, none_value FROM {claims} c JOIN factors USING (factor) QUALIFY row_number() OVER (PARTITION BY company, pillar, c.factor ORDER BY confidence DESC, {_RANK} DESC, seq) = 1),
parts_{name} AS (SELECT company, pillar, factor, method, confidence, weight, CASE WHEN seq % 2 = 0 THEN 2 * greatest(0, least(1, (value - none_value) / (full_value - none_value))) - 1 ELSE polarity * strength END AS delta FROM best_{name}),
mass_{name} AS (SELECT company, pillar, sum(weight * confidence * {_TRUST}) AS mass, sum(weight * confidence * {_TRUST} * delta) AS num, sum(weight) AS den, count(*) AS n_claims FROM parts_{name} GROUP BY company, pillar),
state_{name} AS (SELECT m.*, mass < 2.5 AS gate_fired, CASE WHEN mass < 2.5 OR den <= 0 THEN 0.0::DOUBLE ELSE greatest(-1, least(1, num / den)) END AS delta,
  CASE WHEN mass < 2.5 THEN 0.0::DOUBLE ELSE greatest(0, least(1, den / (SELECT sum(weight) FROM factors))) END AS coverage FROM mass_{name} m),
formula_{name} AS (SELECT *, (CASE WHEN pillar = 'S' THEN 200.0::DOUBLE WHEN pillar = 'G' AND delta < 0 THEN 160.0::DOUBLE ELSE 40.0::DOUBLE END) * ((exp(delta) - exp(-delta)) / (exp(delta) + exp(-delta))) * (0.6::DOUBLE + 0.4::DOUBLE * coverage) AS term FROM state_{name}),
votes_{name} AS (SELECT company, pillar, mass, gate_fired, n_claims, CASE WHEN term <> 0 THEN greatest(0, least(100, 50 + term)) ELSE 50 END AS formula, holistic,
  (CASE WHEN pillar = 'S' THEN 0.1::DOUBLE ELSE 0.7::DOUBLE END) * least(1, 0.4::DOUBLE + 0.04::DOUBLE * mass) AS a, (CASE WHEN pillar = 'S' THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END) * 0.5 AS b FROM formula_{name} LEFT JOIN predictions USING (company, pillar_any)),
met_{name} AS (SELECT *, CASE WHEN holistic IS NULL THEN formula ELSE greatest(0, least(100, (a * formula + b * holistic) / (a + b))) END AS score, abs(formula - holistic) AS spread FROM votes_{name}),
wide_{name} AS (SELECT *, CASE WHEN spread IS NULL THEN 5.0::DOUBLE ELSE greatest(1, least(5, spread / 2 + 1)) END AS half, CASE WHEN spread IS NULL OR spread > 25 THEN 'low' WHEN spread <= 10 THEN 'high' ELSE 'medium' END AS label FROM met_{name}),
gated_{name} AS (SELECT company, pillar, score, greatest(0, score - half) AS low, least(100, score + half) AS high, label, label = 'low' OR gate_fired OR n_claims = 0 AS needs_review FROM wide_{name})""".replace("LEFT JOIN predictions USING (company, pillar_any)", "LEFT JOIN (SELECT company, holistic FROM predictions) USING (company)")


_TALLY = """SELECT company, pillar, round, CASE WHEN agreed THEN 2 ELSE 3 END AS calls, n_answers < 2 AS inconclusive, n_refutes >= 2 AS refuted,
  CASE WHEN n_refutes >= 2 THEN CASE WHEN f1 = f2 OR f1 = f3 THEN f1 WHEN f2 = f3 THEN f2 END END AS flagged, CASE WHEN n_refutes >= 2 THEN list_filter([o1, o2, o3], lambda o: o IS NOT NULL) ELSE [] END AS objections FROM (
  SELECT *, (v1 <> 'abstain')::INT + (v2 <> 'abstain')::INT + (v3 <> 'abstain' AND NOT agreed)::INT AS n_answers, r1::INT + r2::INT + r3::INT AS n_refutes,
    CASE WHEN r1 THEN flag1 END AS f1, CASE WHEN r2 THEN flag2 END AS f2, CASE WHEN r3 THEN flag3 END AS f3, CASE WHEN r1 THEN obj1 END AS o1, CASE WHEN r2 THEN obj2 END AS o2, CASE WHEN r3 THEN obj3 END AS o3 FROM (
    SELECT *, v1 <> 'abstain' AND v1 = v2 AS agreed, v1 = 'refute' AS r1, v2 = 'refute' AS r2, v3 = 'refute' AND NOT (v1 <> 'abstain' AND v1 = v2) AS r3 FROM (
      SELECT company, pillar, round, """ + ", ".join(f"coalesce(max(verdict) FILTER (critic = '{c}'), 'abstain') AS v{i}, max(flagged) FILTER (critic = '{c}') AS flag{i}, max(objection) FILTER (critic = '{c}') AS obj{i}" for i, c in enumerate(verification.CRITICS, 1)) + """
      FROM (SELECT * FROM critic_verdicts QUALIFY row_number() OVER (PARTITION BY company, pillar, round, critic ORDER BY seq) = 1) GROUP BY company, pillar, round)))"""

C11_SQL = f"""WITH {_scored_sql("own", "claims")},
tallies AS MATERIALIZED ({_TALLY}),
joined AS (SELECT g.*, CASE WHEN g.needs_review THEN 'range' ELSE 'point' END AS mode, coalesce(t1.calls, 3) AS calls1, coalesce(t1.inconclusive, true) AS open1, coalesce(t1.refuted, false) AS refuted1, t1.flagged, coalesce(t1.objections, []) AS objections1,
  coalesce(t2.calls, 3) AS calls2, coalesce(t2.inconclusive, true) AS open2, coalesce(t2.refuted, false) AS refuted2, coalesce(t2.objections, []) AS objections2, p.method AS flagged_method
  FROM gated_own g LEFT JOIN (SELECT * FROM tallies WHERE round = 1) t1 USING (company, pillar) LEFT JOIN (SELECT * FROM tallies WHERE round = 2) t2 USING (company, pillar) LEFT JOIN parts_own p ON p.company = g.company AND p.pillar = g.pillar AND p.factor = t1.flagged),
asked AS MATERIALIZED (SELECT *, mode = 'point' AND label = 'medium' AS asked, mode = 'point' AND label = 'medium' AND NOT open1 AND refuted1 AND flagged IS NOT NULL AND coalesce(flagged_method NOT IN ('peer_anchor', 'dataset_lookup', 'peer_ratio_fallback', 'coarse_bucket'), true) AS retried FROM joined),
requests AS (SELECT company, pillar, flagged AS flag FROM asked WHERE retried AND CAST(substr(company, 2) AS int) % 4 <> 0),
before AS (SELECT c.*, flag FROM claims c JOIN requests USING (company, pillar)),
after AS (SELECT * FROM before WHERE NOT (method = 'extracted' AND factor = flag AND source_tag IN ('s0', 's1', 's2'))),
{_scored_sql("new", "(SELECT * EXCLUDE (flag) FROM after)")},
readings AS (SELECT company, pillar, list(concat(source_tag, ':', value) ORDER BY source_tag, value) AS r FROM before WHERE factor = flag GROUP BY ALL),
rereadings AS (SELECT company, pillar, list(concat(source_tag, ':', value) ORDER BY source_tag, value) AS r2 FROM after WHERE factor = flag GROUP BY ALL),
again AS (SELECT q.company, q.pillar, true AS read, coalesce(r = r2, false) AS same, coalesce(n.score, 50) AS score, coalesce(n.low, 45) AS low, coalesce(n.high, 55) AS high, coalesce(n.label, 'low') AS label, coalesce(n.needs_review, true) AS needs_review
  FROM requests q LEFT JOIN gated_new n USING (company, pillar) LEFT JOIN readings USING (company, pillar) LEFT JOIN rereadings USING (company, pillar)),
states AS (SELECT a.*, n.score AS nscore, n.low AS nlow, n.high AS nhigh, n.label AS nlabel, n.needs_review AS nreview, CASE WHEN NOT asked THEN 'skipped' WHEN open1 THEN 'open' WHEN NOT refuted1 THEN 'passed' WHEN NOT retried THEN 'refuted' WHEN read IS NULL THEN 'unread' WHEN same THEN 'unchanged'
  WHEN NOT n.needs_review AND n.label <> 'medium' THEN 'rerouted' WHEN n.needs_review OR n.label <> 'medium' THEN 'thinned' WHEN open2 THEN 'open_again' WHEN NOT refuted2 THEN 'passed_again' ELSE 'refuted_again' END AS state FROM asked a LEFT JOIN again n USING (company, pillar))
SELECT company, pillar, CASE WHEN state = 'skipped' THEN 'skipped' WHEN state LIKE 'open%' THEN 'inconclusive' WHEN state = 'passed' THEN 'passed' WHEN state IN ('rerouted', 'passed_again') THEN 'passed_after_retry' ELSE 'refuted' END AS verdict,
  CASE WHEN state IN ('refuted', 'unread', 'unchanged', 'refuted_again', 'thinned') THEN 'range' WHEN state = 'skipped' THEN mode ELSE 'point' END AS mode,
  round(CASE WHEN state IN ('rerouted', 'thinned', 'open_again', 'passed_again', 'refuted_again') THEN nscore ELSE score END, 6) AS score, round(CASE WHEN state IN ('rerouted', 'thinned', 'open_again', 'passed_again', 'refuted_again') THEN nlow ELSE low END, 6) AS low,
  round(CASE WHEN state IN ('rerouted', 'thinned', 'open_again', 'passed_again', 'refuted_again') THEN nhigh ELSE high END, 6) AS high,
  CASE WHEN state IN ('refuted', 'unread', 'unchanged', 'refuted_again', 'thinned') THEN 'low' WHEN state IN ('rerouted', 'open_again', 'passed_again') THEN nlabel ELSE label END AS label,
  CASE WHEN state = 'skipped' THEN needs_review WHEN state IN ('rerouted', 'thinned') THEN nreview ELSE state NOT IN ('passed', 'passed_again') END AS needs_review, retried,
  CASE WHEN state = 'skipped' THEN 0 WHEN state LIKE '%_again' THEN calls1 + calls2 ELSE calls1 END AS critic_calls,
  array_to_string(CASE WHEN state = 'refuted_again' THEN list_concat(objections1, objections2) WHEN state IN ('skipped', 'open', 'passed') THEN [] ELSE objections1 END, ';') AS objections FROM states"""


def verify(t):
    """Best claims, scores, panels and requests are used several times, so each is made once and written."""
    contributions = checkpointed(_contributions(t).select(*KEYS, "factor", "method", "weight", "confidence", "delta"))
    scores = checkpointed(scored(t, contributions))
    methods = contributions.select(*KEYS, "factor", "method")
    panels = checkpointed(verification.panels(t.critic_verdicts, KEYS))
    again = rescored(t, checkpointed(verification.retry_requests(scores, panels, methods, KEYS)))
    return verification.verified(scores, panels, methods, again, KEYS)


@query("c11_verification", C11_SQL)
def _(t):
    return verify(t).select(*KEYS, "verdict", "mode", *(r6(c).alias(c) for c in ("score", "low", "high")), "label", "needs_review", "retried", "critic_calls", F.array_join("objections", ";").alias("objections"))


_UPLIFT = "SELECT company, pillar, revenue > 5000 AS applied, least(100.0, 60.0 + revenue / 1000) AS corrected, 'listed' AS reasoning FROM companies, (VALUES ('E'), ('G')) p(pillar) WHERE revenue > 3000"


@query("c12_uplift_merge", f"""SELECT v.company, v.pillar, CASE WHEN applied THEN concat(verdict, '+uplifted') ELSE verdict END AS verdict, CASE WHEN applied THEN 'point' ELSE mode END AS mode, CASE WHEN applied THEN round(corrected, 6) ELSE score END AS score, CASE WHEN applied THEN round(corrected, 6) ELSE low END AS low, CASE WHEN applied THEN round(corrected, 6) ELSE high END AS high, label,
  needs_review AND NOT coalesce(applied, false) AS needs_review, coalesce(applied, false) AS uplifted FROM ({C11_SQL}) v LEFT JOIN (SELECT * FROM ({_UPLIFT}) WHERE applied) u ON u.company = v.company AND u.pillar = v.pillar""")
def _(t):
    t.companies.createOrReplaceTempView("companies")
    out = routing.uplifted(verify(t), t.spark.sql(_UPLIFT).withColumn("corrected", F.col("corrected").cast("double")), KEYS)
    return out.select(*KEYS, "verdict", "mode", *(r6(c).alias(c) for c in ("score", "low", "high")), "label", "needs_review", F.col("reason").startswith("public-company uplift").alias("uplifted"))
