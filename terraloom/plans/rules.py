"""Contributions with revenue and age, routing, calculators, dates and pieces of texts, small choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, scoring, text
from ..operators import calculators, ranking
from ..operators import claims as C
from .base import query
from .scores import _RANK, _SCORED, _contributions, _reduced
from .texts import _NAMES, _named

r6 = lambda c: F.round(c, 6)

_SHARES = f"""WITH best AS (SELECT c.*, f.weight, f.full_value, f.none_value, CAST(substr(factor, 2) AS int) AS k FROM (SELECT * EXCLUDE (value), CASE WHEN seq % 13 = 0 THEN NULL ELSE value END AS value FROM claims) c JOIN factors f USING (factor) QUALIFY row_number() OVER (PARTITION BY company, factor ORDER BY confidence DESC, {_RANK} DESC, seq) = 1),
located AS (SELECT b.*, revenue / 1000 AS musd, country FROM best b LEFT JOIN companies USING (company)),
totals AS (SELECT country, sum(value) AS total FROM claims JOIN companies USING (company) WHERE factor = 'f4' AND method = 'dataset_lookup' GROUP BY country),
told AS (SELECT l.*, total, k % 2 = 0 AS banded, k % 4 = 0 AND k % 2 = 0 AND value IS NOT NULL AND NOT coalesce(musd > 0, false) AS missing, factor = 'f4' AND method = 'dataset_lookup' AND coalesce(total > 0, false) AS tracked,
  CASE WHEN reported IS NULL THEN 0.6 ELSE greatest(0.5, exp(-greatest(0, date_diff('day', reported::DATE, DATE '2002-01-01')) / 365.0)) END AS fresh FROM located l LEFT JOIN totals USING (country)),
placed AS (SELECT company, pillar, factor, weight, seq, CASE WHEN missing AND tracked THEN 1 - 2 * greatest(0, least(1, value / total)) WHEN missing OR NOT banded OR value IS NULL THEN polarity * strength
  ELSE 2 * greatest(0, least(1, (CASE WHEN k % 4 = 0 THEN value / musd ELSE value END - none_value) / (full_value - none_value))) - 1 END AS delta,
  confidence * CASE WHEN missing AND NOT tracked THEN 0.5 ELSE 1 END * CASE WHEN NOT banded AND method = 'extracted' AND NOT starts_with(source_tag, 'report_pdf') THEN fresh ELSE 1 END AS conf FROM told)
"""


def _placed(t):
    number = F.expr("CAST(substr(factor, 2) AS int)")
    claims = t.claims.withColumn("value", F.when(F.col("seq") % 13 != 0, F.col("value")))
    best = C.best_claims(claims.join(t.factors, "factor"), ["company", "factor"])
    home = t.companies.select("company", (F.col("revenue") / 1000).alias("revenue"), "country")
    totals = t.claims.where("factor = 'f4' and method = 'dataset_lookup'").join(home, "company").groupBy("country").agg(F.sum("value").alias("country_total"))
    rows = best.join(home, "company", "left").join(totals, "country", "left").withColumn("banded", number % 2 == 0).withColumn("per_revenue", number % 4 == 0)
    rows = rows.withColumn("tracked", F.col("factor") == "f4").withColumn("fresh", text.freshness(F.to_date("reported"), F.lit("2002-01-01").cast("date")))
    return C.contributions(rows)


@query("c03_contributions", _SHARES + "SELECT company, factor, pillar, seq, round(delta, 6) AS delta, round(conf, 6) AS confidence, round(weight * conf * delta, 6) AS points FROM placed")
def _(t):
    return _placed(t).select("company", "factor", "pillar", "seq", r6("delta").alias("delta"), r6("confidence").alias("confidence"), r6("points").alias("points"))


@query("a21_linear_reduction", _SHARES + "SELECT company, pillar, round(greatest(0, least(100, 50 + sum(weight * conf * delta))), 6) AS score FROM placed GROUP BY company, pillar")
def _(t):
    score = scoring.clamp(F.lit(50.0) + F.sum("points"), 0.0, 100.0)
    return _placed(t).groupBy("company", "pillar").agg(r6(score).alias("score"))


# Words of a pillar's topic; claims made without reading a text are exempt.
_TERMS = {"E": ["license", "un"], "S": ["token", "les"], "G": ["email", "the"]}
_EXEMPT = ["dataset_lookup", "peer_ratio_fallback"]
_OFF = "CASE pillar " + " ".join(f"WHEN '{p}' THEN NOT regexp_matches(text, '(?i)(^|[^a-z0-9_])(?:{'|'.join(w)})([^a-z0-9_]|$)')" for p, w in _TERMS.items()) + " END"
_JUDGED = f"""WITH cited AS (SELECT company, source_tag, text FROM signals QUALIFY row_number() OVER (PARTITION BY company, source_tag ORDER BY seq DESC) = 1),
judged AS (SELECT c.seq, c.method, c.confidence, length(text) AS n, method NOT IN ('dataset_lookup', 'peer_ratio_fallback') AND coalesce({_OFF} AND text <> '', false) AS dropped FROM claims c LEFT JOIN cited USING (company, source_tag))
"""


def _judged(t):
    """The texts are judged once for each pillar; claims then only look the result up."""
    cited = ranking.first_per_key(t.signals, ["company", "source_tag"], F.desc("seq"))
    verdicts = F.array(*(F.struct(F.lit(p).alias("pillar"), text.off_topic(F.col("text"), words).alias("off")) for p, words in _TERMS.items()))
    cited = cited.select("company", "source_tag", F.length("text").alias("n"), F.explode(verdicts).alias("v")).select("company", "source_tag", "n", "v.*")
    rows = t.claims.join(cited, ["company", "source_tag", "pillar"], "left")
    return rows.withColumn("dropped", ~F.col("method").isin(_EXEMPT) & F.coalesce("off", F.lit(False)))


@query("f30_lexical_relevance", _JUDGED + "SELECT seq, method FROM judged WHERE NOT dropped")
def _(t):
    return _judged(t).where("not dropped").select("seq", "method")


@query("a39_validator_counts", _JUDGED + "SELECT method, count(*) AS n, count(*) FILTER (dropped) AS n_dropped, count(*) FILTER (NOT dropped AND coalesce(n < 200 AND confidence > 0.7, false)) AS n_capped FROM judged GROUP BY method")
def _(t):
    capped = ~F.col("dropped") & (F.col("n") < 200) & (F.col("confidence") > 0.7)
    return _judged(t).groupBy("method").agg(F.count("*").alias("n"), F.count_if("dropped").alias("n_dropped"), F.count_if(capped).alias("n_capped"))


@query("c08_thin_routing", _SCORED + """, strong AS (SELECT company, pillar, count(*) AS n FROM claims WHERE confidence >= 0.99 AND strength > 0.95 GROUP BY company, pillar),
overlaid AS (SELECT company, pillar, CAST(coalesce(sum(weight * confidence * -delta) FILTER (factor IN ('f1', 'f4', 'f7', 'f10') AND delta < 0), 0) AS double) AS s FROM contributions GROUP BY company, pillar),
priors AS (SELECT country, avg(score) / 100 AS p FROM peers WHERE sector = 'BUILDING' GROUP BY country),
based AS (SELECT company, pillar, n IS NULL AS thin, p, s, CASE WHEN n IS NULL THEN greatest(0, least(100, 50 + coalesce(15 * (p - 50) / 50, 0))) WHEN term <> 0 THEN greatest(0, least(100, 50 + term)) ELSE 50 END AS base FROM termed JOIN companies USING (company) LEFT JOIN strong USING (company, pillar) LEFT JOIN overlaid USING (company, pillar) LEFT JOIN priors USING (country))
SELECT company, pillar, CASE WHEN thin THEN 'thin' ELSE 'rich' END AS route, CASE WHEN thin AND p IS NOT NULL THEN 'country' END AS rung, round(greatest(0, least(100, base + CASE WHEN s > 0 THEN -20 * ((exp(1.2 * s / 20) - exp(-1.2 * s / 20)) / (exp(1.2 * s / 20) + exp(-1.2 * s / 20))) ELSE 0 END)), 6) AS score FROM based""")
def _(t):
    strong = t.claims.where("confidence >= 0.99 and strength > 0.95").groupBy("company", "pillar").agg(F.count("*").alias("n_strong"))
    severity = F.when(F.col("factor").isin("f1", "f4", "f7", "f10") & (F.col("delta") < 0), F.col("weight") * F.col("confidence") * -F.col("delta")).otherwise(0.0)
    overlaid = _contributions(t).groupBy("company", "pillar").agg(F.sum(severity).alias("severity"))
    priors = t.peers.where("sector = 'BUILDING'").groupBy("country").agg((F.avg("score") / 100).alias("prior"))
    rows = _reduced(t).join(t.companies, "company").join(strong, ["company", "pillar"], "left").join(overlaid, ["company", "pillar"], "left").join(priors, "country", "left")
    thin = F.col("n_strong").isNull()
    base = F.when(thin, scoring.blended(F.lit(0.0), F.lit(0.0), F.col("prior"))).otherwise(F.col("score"))
    score = scoring.clamp(base + scoring.overlay(F.col("severity")), 0.0, 100.0)
    return rows.select("company", "pillar", F.when(thin, "thin").otherwise("rich").alias("route"), F.when(thin & F.col("prior").isNotNull(), "country").alias("rung"), r6(score).alias("score"))


_CALCULATED = """WITH c AS (SELECT *, CASE WHEN country_score IS NULL THEN industry_score WHEN industry_score IS NULL THEN country_score ELSE (country_score + industry_score) / 2 END AS base,
  CAST(CASE WHEN industry_score IS NULL THEN 15 ELSE 15 * greatest(0.15, (100 - industry_score) / 100) END AS double) AS room,
  coalesce(diesel * CAST(2.51279 AS double), 0) + coalesce(petrol * CAST(2.0844 AS double), 0) + coalesce(kwh * grid, 0) AS kilos FROM calculator),
p AS (SELECT company_id, base, 'E' AS pillar, coalesce(CASE WHEN (diesel IS NOT NULL OR petrol IS NOT NULL OR kwh IS NOT NULL) AND revenue <> 0 THEN 40 * greatest(-1, least(1, (50 - kilos / (revenue / 1000)) / 50)) END, 0) + CASE tier WHEN 'some' THEN 0.5 * room WHEN 'mostly' THEN room ELSE 0 END AS points, 40 + room AS most,
  (diesel IS NOT NULL OR petrol IS NOT NULL)::INT + (kwh IS NOT NULL)::INT + (tier IS NOT NULL)::INT AS given FROM c
UNION ALL SELECT company_id, base, 'S', CASE WHEN staff > 0 AND women IS NOT NULL THEN least(1, 100 * women / staff / 50) * 20 ELSE 0 END + CASE WHEN fined THEN -25 WHEN NOT fined THEN 10 ELSE 0 END + CASE WHEN missed THEN -15 WHEN NOT missed THEN 5 ELSE 0 END, 60,
  (staff > 0 AND women IS NOT NULL)::INT + (fined IS NOT NULL)::INT + (missed IS NOT NULL)::INT FROM c
UNION ALL SELECT company_id, base, 'G', 20 * (coalesce(bribery_policy, false)::INT + responsible::INT + whistle::INT), 60, coalesce(bribery_policy, false)::INT + responsible::INT + whistle::INT FROM c),
s AS (SELECT company_id, pillar, base, round(given / 3, 3) AS coverage, greatest(0, least(100, coalesce(base, 50) + 50 * (points / most))) AS score FROM p),
h AS (SELECT *, CASE WHEN base IS NULL THEN 50 - 45 * coverage ELSE 20 - 15 * coverage END AS half FROM s)
"""


def _calculated(t):
    c = F.col
    base = scoring.mean_of(c("country_score"), c("industry_score"))
    parts = {
        "E": calculators.environment(c("diesel"), c("petrol"), c("kwh"), c("grid"), c("revenue"), c("tier"), c("industry_score"), base),
        "S": calculators.social(c("staff"), c("women"), c("fined"), c("missed"), base),
        "G": calculators.governance(c("bribery_policy"), c("responsible"), c("whistle"), baseline=base),
    }
    rows = F.array(*(F.struct(F.lit(p).alias("pillar"), r.alias("r")) for p, r in parts.items()))
    return t.calculator.select("company_id", F.explode(rows).alias("x")).select("company_id", "x.pillar", "x.r.*")


@query("m22_calculated_pillars", _CALCULATED + "SELECT company_id, pillar, round_even(score, 0) AS score, round_even(greatest(0, score - half), 0) AS low, round_even(least(100, score + half), 0) AS high, coverage FROM h")
def _(t):
    return _calculated(t)


@query("m21_overall_coverage", _CALCULATED + "SELECT company_id, round(sum(coverage) / 3, 3) AS coverage FROM h GROUP BY company_id")
def _(t):
    return _calculated(t).groupBy("company_id").agg(F.round(F.sum("coverage") / 3, 3).alias("coverage"))


@query("m24_overflow_penalty", "SELECT company, round(sum(CASE WHEN lower_is_better AND worst > 0 AND value > worst THEN log10(value / worst) * 4 * confidence ELSE 0 END), 6) AS penalty FROM (SELECT company, value, confidence, none_value AS worst, factor NOT IN ('f1', 'f6') AS lower_is_better FROM claims JOIN factors USING (factor)) GROUP BY company")
def _(t):
    penalty = calculators.overflow(F.col("value"), F.col("none_value"), ~F.col("factor").isin("f1", "f6"), F.col("confidence"))
    return t.claims.join(t.factors, "factor").groupBy("company").agg(r6(F.sum(penalty)).alias("penalty"))


@query("m25_certainty", """WITH n AS (SELECT company_id, country_score, industry_score, CAST(company_id * 37 % 101 AS double) AS score, company_id % 4 AS n_claims, CASE WHEN company_id % 4 > 0 THEN CAST(company_id % 11 AS double) / 10 END AS mean FROM calculator),
l AS (SELECT *, country_score IS NOT NULL OR industry_score IS NOT NULL AS sourced, n_claims >= 2 AND coalesce(mean >= CAST(0.6 AS double), false) AS strong FROM n),
h AS (SELECT *, CASE WHEN NOT sourced AND n_claims = 0 THEN 50 WHEN country_score IS NOT NULL AND industry_score IS NOT NULL THEN 5 WHEN sourced AND strong THEN 5 WHEN sourced THEN 8 ELSE 15 END AS half FROM l)
SELECT company_id, CASE WHEN sourced THEN 'high' WHEN strong THEN 'medium' ELSE 'low' END AS label, greatest(0, score - half) AS low, least(100, score + half) AS high FROM h""")
def _(t):
    k = F.col("company_id")
    mean = F.when(k % 4 > 0, (k % 11).cast("double") / 10)
    label, low, high = calculators.certainty(F.col("country_score"), F.col("industry_score"), k % 4, mean, (k * 37 % 101).cast("double"))
    return t.calculator.select("company_id", label.alias("label"), low.alias("low"), high.alias("high"))


_SAID = "concat('Filed ', k % 33, ' ', split_part('Jan February mar April MAY June Jul August Sept Oct November DEC', ' ', CAST(k % 12 + 1 AS int)), ' 199', k % 10, ', due 199', k % 7, '-0', 1 + k % 9, '-', lpad(CAST(k % 33 AS string), 2, '0'), '.')"


@query("x40_dates_in_text", rf"""WITH s AS (SELECT o_orderkey, {_SAID} AS said FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)),
f AS (SELECT o_orderkey, list_filter(list_concat(list_transform(regexp_extract_all(said, '(?i)\b\d{{1,2}}\s+(?:{text.MONTHS})\w*\s+\d{{4}}\b', 0), lambda x: TRY_CAST(concat(regexp_extract(x, '\d{{4}}$'), '-', lpad(CAST((strpos('{text.MONTHS.lower()}', lower(regexp_extract(x, '[A-Za-z]{{3}}'))) + 3) // 4 AS varchar), 2, '0'), '-', lpad(regexp_extract(x, '^\d+'), 2, '0')) AS DATE)),
  list_transform(regexp_extract_all(said, '\b\d{{4}}-\d{{2}}-\d{{2}}\b', 0), lambda x: TRY_CAST(x AS DATE))), lambda d: d IS NOT NULL) AS dates FROM s)
SELECT o_orderkey, len(dates) AS n_dates, CAST(list_max(dates) AS varchar) AS latest FROM f""")
def _(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderkey").alias("k")).select("o_orderkey", text.dates_in(F.expr(_SAID)).alias("dates"))
    return rows.select("o_orderkey", F.size("dates").alias("n_dates"), F.array_max("dates").cast("string").alias("latest"))


@query("x42_mail_times", "SELECT o_orderkey, CAST(epoch(CAST(o_orderdate AS timestamp)) AS bigint) + 37800 - CASE WHEN o_orderkey % 3 = 0 THEN 7200 ELSE 0 END AS seconds FROM orders")
def _(t):
    zone = F.when(F.col("o_orderkey") % 3 == 0, " +0200").when(F.col("o_orderkey") % 3 == 1, " GMT").otherwise("")
    header = F.concat(F.lit("Tue, "), F.date_format("o_orderdate", "d MMM yyyy"), F.lit(" 10:30:00"), zone)
    return t.orders.select("o_orderkey", F.unix_timestamp(text.mail_time(header)).alias("seconds"))


_FILED = "concat('item 2. properties none ', text, ' Item 2.  Properties ', text, ' Item 3. Legal ', text)"


@query("x13_sections", rf"""WITH b AS (SELECT doc_id, regexp_replace(substr(regexp_replace({_FILED}, '(?is)^.*(?:item\s*2\.\s*properties)', ''), 1, 2000), '^\s+|\s+$', '', 'g') AS body FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, body, regexp_extract(body, '(?s)^(.*?)Item\s*\d+[A-Z]?\.', 1) AS early FROM b)
SELECT doc_id, nullif(regexp_replace(CASE WHEN length(early) > 100 THEN early ELSE body END, '^\s+|\s+$', '', 'g'), '') AS body FROM c""")
def _(t):
    rows = t.documents.where("text is not null").select("doc_id", F.expr(_FILED).alias("filed"))
    return rows.select("doc_id", text.section(F.col("filed"), r"item\s*2\.\s*properties").alias("body"))


_MARKED = "concat('see <', url, '> and <', split_part(url, '?', 1), '> or <', url, '> at the end')"


@query("x09_marked_urls", rf"SELECT page_id, concat_ws(' ', '<http', url, CASE WHEN split_part(url, '?', 1) <> url THEN split_part(url, '?', 1) END) AS urls, 'see  and  or  at the end' AS plain FROM pages WHERE regexp_matches(url, '^https?://[^>\s]+$')")
def _(t):
    rows = t.pages.where(F.col("url").rlike(r"^https?://[^>\s]+$")).select("page_id", F.expr(_MARKED).alias("said"))
    return rows.select("page_id", F.concat_ws(" ", F.lit("<http"), text.marked_urls(F.col("said"))).alias("urls"), text.without_urls(F.col("said")).alias("plain"))


@query("x10_segments", r"WITH s AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(html, '>\s+', '>' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS pieces FROM pages) SELECT page_id, len(pieces) AS n_pieces, pieces[1] AS first_piece, list_max(list_transform(pieces, lambda x: length(x))) AS longest FROM s")
def _(t):
    rows = t.pages.select("page_id", text.segments(F.col("html")).alias("pieces"))
    return rows.select("page_id", F.size("pieces").alias("n_pieces"), F.try_element_at("pieces", F.lit(1)).alias("first_piece"), F.array_max(F.transform("pieces", F.length)).alias("longest"))


_LISTED = "replace(concat(text, chr(10)), chr(10), concat(' ', doc_id % 1500, chr(10)))"


@query("f24_navigation", rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex({_LISTED}, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(lines) >= 6 AND len(list_filter(lines, lambda x: regexp_matches(x, '\s\d{{1,3}}$'))) >= greatest(4, len(lines) * 0.3) AND len(list_filter(lines, lambda x: length(x) < 60)) >= len(lines) * 0.7 AS navigation FROM l""")
def _(t):
    return t.documents.where("text is not null").select("doc_id", text.is_navigation(F.expr(_LISTED)).alias("navigation"))


@query("d04_window_prefixes", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY substr(text, 1, 200)")
def _(t):
    return t.documents.groupBy(F.substring("text", 1, 200).alias("head")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("t07_by_midpoint", "WITH m AS (SELECT market_id, company, round(sum((low + high) / 2), 6) AS total FROM (SELECT company, metric, min(numeric_value) AS low, max(numeric_value) AS high FROM metric_values GROUP BY company, metric) JOIN companies USING (company) GROUP BY market_id, company) SELECT market_id, company, total, row_number() OVER (PARTITION BY market_id ORDER BY total DESC NULLS LAST, company) AS place FROM m")
def _(t):
    from pyspark.sql import Window as W

    ranges = t.metric_values.groupBy("company", "metric").agg(F.min("numeric_value").alias("low"), F.max("numeric_value").alias("high"))
    totals = ranges.join(t.companies, "company").groupBy("market_id", "company").agg(r6(F.sum((F.col("low") + F.col("high")) / 2)).alias("total"))
    return totals.withColumn("place", F.row_number().over(W.partitionBy("market_id").orderBy(F.desc_nulls_last("total"), "company")))


@query("u02_later_overwrites", "SELECT company, metric, source, numeric_value FROM metric_values QUALIFY row_number() OVER (PARTITION BY company, metric ORDER BY CASE source WHEN 'agentic_estimate' THEN 1 WHEN 'wikirate' THEN 2 WHEN 'report' THEN 3 WHEN 'agentic_correction' THEN 4 ELSE 0 END DESC, seq DESC) = 1")
def _(t):
    layer = scoring.by_key(F.col("source"), {"agentic_estimate": 1, "wikirate": 2, "report": 3, "agentic_correction": 4}, 0)
    return ranking.first_per_key(t.metric_values, ["company", "metric"], layer.desc(), F.desc("seq")).select("company", "metric", "source", "numeric_value")


@query("u03_claims_of_both", "SELECT seq, method FROM claims WHERE method = 'extracted' UNION ALL SELECT seq, method FROM claims WHERE method = 'dataset_lookup'")
def _(t):
    return t.claims.where(F.col("method").isin("extracted", "dataset_lookup")).select("seq", "method")


@query("x50_first_and_rest", "SELECT p_partkey, string_split(p_name, ' ')[1] AS head, array_to_string(string_split(p_name, ' ')[2:], '|') AS rest FROM part")
def _(t):
    words = F.split("p_name", " ")
    return t.part.select("p_partkey", F.try_element_at(words, F.lit(1)).alias("head"), F.array_join(F.slice(words, 2, F.size(words)), "|").alias("rest"))


@query("a17_group_mean_percentile", "WITH r AS (SELECT sector, country, 100 * (count(*) OVER (PARTITION BY country ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY country, score) / 2) / count(*) OVER (PARTITION BY country) AS p FROM peers WHERE score IS NOT NULL) SELECT sector, country, round(avg(p), 6) AS mean, count(*) AS n FROM r GROUP BY sector, country")
def _(t):
    ranked = ranking.midrank_percentile(t.peers.select("sector", "country", "score"), ["country"], "score")
    return ranked.groupBy("sector", "country").agg(r6(F.avg("percentile")).alias("mean"), F.count("*").alias("n"))


@query("j16_owner_match", rf"WITH n AS ({_NAMES}), f AS (SELECT p_partkey, trim(regexp_replace(concat(' ', trim(regexp_replace(regexp_replace(lower(name), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))), '(\s+({'|'.join(names.SUFFIXES)}))+\s*$', '')) AS form FROM n), o AS (SELECT p_name, min(p_partkey) AS owner FROM part GROUP BY p_name) SELECT p_partkey, owner FROM f JOIN o ON form = p_name WHERE form <> ''")
def _(t):
    owners = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("owner"))
    own = _named(t).select("p_partkey", names.normal_form(F.col("name")).alias("form")).where("form <> ''")
    return own.join(owners, F.col("form") == F.col("p_name")).select("p_partkey", "owner")
