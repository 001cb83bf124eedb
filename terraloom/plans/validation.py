"""Claims through all rules of validation, severities last."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as K
from ..operators import validation as V
from ..session import checkpointed
from .base import query
from .clustering import _LIKE, like
from .scores import r6
from .windows import _TERMS, term_lists

RULES = V.FactorRules(percentages=["f2", "f3"], totalled=["f4"], negative=["f1", "f4", "f7", "f10"], corroborated=["f1", "f7", "f10"])
_TOTALS = "SELECT country, 1.5 * avg(value) AS country_total FROM claims JOIN companies USING (company) WHERE factor = 'f4' AND method = 'dataset_lookup' GROUP BY country"

C01_SQL = (
    _LIKE
    + ", "
    + _TERMS.replace("terms AS (", "listed AS (", 1)
    + rf""", lists AS (SELECT DISTINCT coalesce(factor, pillar) AS list, term FROM listed),
pieces AS (SELECT company, source_tag, generate_subscripts(parts, 1) AS i, unnest(parts) AS piece FROM (SELECT company, source_tag, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS parts FROM cited)),
following AS (SELECT *, lead(piece, 1) OVER w AS gap, lead(piece, 2) OVER w AS next FROM pieces WINDOW w AS (PARTITION BY company, source_tag ORDER BY i)),
words AS (SELECT company, source_tag, lower(piece) AS word FROM following UNION SELECT company, source_tag, lower(concat(piece, ' ', next)) FROM following WHERE gap = ' '),
present AS (SELECT company, source_tag, list_distinct(list(list)) AS present FROM words JOIN lists ON word = term GROUP BY company, source_tag),
owned AS (SELECT c.*, length(text) AS n, coalesce(present, []) AS present, CASE WHEN factor IN (SELECT list FROM lists) THEN factor WHEN pillar IN (SELECT list FROM lists) THEN pillar END AS own, country_total, method IN ('dataset_lookup', 'peer_ratio_fallback') AS exempt
  FROM claims c LEFT JOIN cited USING (company, source_tag) LEFT JOIN present USING (company, source_tag) LEFT JOIN companies USING (company) LEFT JOIN ({_TOTALS}) USING (country)),
kept AS (SELECT *, value < 0 OR (factor IN ('f2', 'f3') AND value > 100) AS unfit, factor = 'f4' AND coalesce(value > country_total, false) AS over FROM owned WHERE NOT coalesce(NOT exempt AND n > 0 AND own IS NOT NULL AND NOT list_contains(present, own), false)),
s1 AS (SELECT *, coalesce(unfit OR over, false) AS h1, CASE WHEN over AND NOT coalesce(unfit, false) THEN least(confidence, 0.3) ELSE confidence END AS c1, CASE WHEN NOT coalesce(unfit, false) THEN value END AS v FROM kept),
s2 AS (SELECT *, factor IN ('f1', 'f4', 'f7', 'f10') AND polarity = 1 AS h2, CASE WHEN factor IN ('f1', 'f4', 'f7', 'f10') AND polarity = 1 THEN c1 * 0.5 ELSE c1 END AS c2 FROM s1),
s3 AS (SELECT *, coalesce(NOT exempt AND c2 > 0.7 AND n < 200, false) AS h3, CASE WHEN coalesce(NOT exempt AND c2 > 0.7 AND n < 200, false) THEN least(c2, 0.5) ELSE c2 END AS c3 FROM s2),
alone AS (SELECT company, factor, count(DISTINCT source_tag) = 1 AS alone FROM s3 WHERE factor IN ('f1', 'f7', 'f10') AND polarity = -1 GROUP BY company, factor),
s4 AS (SELECT s3.*, coalesce(alone AND polarity = -1, false) AS h4, CASE WHEN coalesce(alone AND polarity = -1, false) THEN c3 * 0.7 ELSE c3 END AS c4 FROM s3 LEFT JOIN alone USING (company, factor)),
met AS (SELECT c.*, severity, coalesce(length(trim(text)) >= 30 AND s >= 0.12 AND severity IS NOT NULL, false) AS hit, s FROM s4 c LEFT JOIN best b ON b.grp = c.pillar AND b.key = concat(c.company, '/', c.source_tag) LEFT JOIN labels l ON l.grp = b.grp AND l.centre = b.centre)
SELECT seq, v AS value, CASE WHEN hit THEN severity ELSE strength END AS strength, round(CASE WHEN hit THEN round(c4 * (0.7::DOUBLE + 0.30000000000000004::DOUBLE * least(1.0::DOUBLE, s / 0.45::DOUBLE)), 3) ELSE c4 END, 6) AS confidence,
  concat_ws(',', CASE WHEN h1 THEN 'numeric_bounds' END, CASE WHEN h2 THEN 'polarity_consistency' END, CASE WHEN h3 THEN 'known_failure_shape' END, CASE WHEN h4 THEN 'corroboration' END) AS flags FROM met"""
)


@query("c01_full_validation", C01_SQL)
def _(t):
    lists: dict[str, list[str]] = {}
    for name, _, terms in term_lists(t):
        lists.setdefault(name, []).extend(terms)
    cited = t.signals.groupBy("company", "source_tag").agg(F.min_by("text", "seq").alias("text"))
    # 700 rows at most, without their texts, so claims stay where they are.
    cited = checkpointed(cited.select("company", "source_tag", F.length("text").alias("text_length"), V.lists_present(F.col("text"), lists).alias("present")))
    t.claims.createOrReplaceTempView("claims")
    t.companies.createOrReplaceTempView("companies")
    home = t.companies.select("company", "country").join(t.spark.sql(_TOTALS), "country", "left").select("company", "country_total")
    rows = V.joined_where(t.claims, F.col("factor").isin(RULES.totalled), home, ["company"]).join(F.broadcast(cited), ["company", "source_tag"], "left")
    kept = V.validate(rows, RULES, list(lists))
    out = K.with_severity(kept.join(F.broadcast(like(t)), ["pillar", "company", "source_tag"], "left"), None, "cluster", "similarity", "severity")
    return out.select("seq", "value", "strength", r6("confidence").alias("confidence"), F.array_join("flags", ",").alias("flags"))
