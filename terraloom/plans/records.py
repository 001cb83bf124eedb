"""Public records, units, planners, reports and trained heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, scoring, units
from ..operators import ranking, vectors
from .base import query

r6 = lambda c: F.round(c, 6)


@query("m12_currency", "SELECT o_orderkey, round(CASE CAST(o_orderkey % 4 AS int) WHEN 0 THEN o_totalprice * 1.08::DOUBLE WHEN 1 THEN o_totalprice WHEN 2 THEN NULL ELSE o_totalprice * 0.0067::DOUBLE END, 6) AS usd FROM orders")
def _(t):
    label = F.when(F.col("o_orderkey") % 4 == 0, "eur").when(F.col("o_orderkey") % 4 == 2, "XXX").when(F.col("o_orderkey") % 4 == 3, "JPY")
    return t.orders.select("o_orderkey", r6(units.in_dollars(F.col("o_totalprice"), label)).alias("usd"))


@query("m13_units", "SELECT l_orderkey, l_linenumber, round(CASE l_returnflag WHEN 'R' THEN l_quantity * 1000 WHEN 'A' THEN l_quantity ELSE NULL END, 6) AS base FROM lineitem")
def _(t):
    unit = F.when(F.col("l_returnflag") == "R", "kt").when(F.col("l_returnflag") == "N", "furlong")
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(units.with_unit(F.col("l_quantity"), unit)).alias("base"))


@query("m14_coerced_values", "SELECT c_custkey, round(CASE WHEN c_custkey % 3 = 0 THEN least(100, greatest(0, c_acctbal / 50)) ELSE greatest(0, c_acctbal / 50) END, 6) AS value, round(least(c_acctbal, 5000), 6) AS low, round(greatest(c_acctbal, 5000), 6) AS high FROM customer")
def _(t):
    low, high = units.ordered_range(F.lit(5000.0), F.col("c_acctbal"))
    return t.customer.select("c_custkey", r6(units.coerced_value(F.col("c_acctbal") / 50, F.col("c_custkey") % 3 == 0)).alias("value"), r6(low).alias("low"), r6(high).alias("high"))


@query("m04_band_scores", "SELECT seq, round(CASE WHEN numeric_value IS NULL THEN NULL WHEN metric = 'm3' THEN 50 ELSE 100 * greatest(0, least(1, (numeric_value - 45) / -40)) END, 1) AS score FROM metric_values")
def _(t):
    none = F.when(F.col("metric") == "m3", 5.0).otherwise(45.0)
    score = F.when(F.col("numeric_value").isNotNull(), scoring.band_score(F.col("numeric_value"), F.lit(5.0), none))
    return t.metric_values.select("seq", F.round(score, 1).alias("score"))


@query("m10_rating_bands", "SELECT peer_id, CASE WHEN score / 100 >= 75 THEN 'leader' WHEN score / 100 >= 50 THEN 'average' WHEN score / 100 >= 25 THEN 'laggard' WHEN score IS NOT NULL THEN 'poor' END AS band FROM peers")
def _(t):
    return t.peers.select("peer_id", scoring.rating_band(F.col("score") / 100).alias("band"))


@query("a01_owner_totals", "SELECT company, metric, reporting_year, round(sum(numeric_value), 4) AS total, count(*) AS n FROM metric_values WHERE metric IN ('m1', 'm2') GROUP BY company, metric, reporting_year")
def _(t):
    return t.metric_values.where(F.col("metric").isin("m1", "m2")).groupBy("company", "metric", "reporting_year").agg(F.round(F.sum("numeric_value"), 4).alias("total"), F.count("*").alias("n"))


@query("a07_field_sample_sizes", "SELECT sector, count(*) AS n, count(score) AS n_score, count(workers) AS n_workers, count(DISTINCT country) AS n_countries FROM peers GROUP BY sector")
def _(t):
    return t.peers.groupBy("sector").agg(F.count("*").alias("n"), F.count("score").alias("n_score"), F.count("workers").alias("n_workers"), F.count_distinct("country").alias("n_countries"))


@query("a15_global_mean_and_max", "SELECT round(avg(score), 6) AS mean, max(score) AS most, count(DISTINCT country) AS n FROM peers")
def _(t):
    return t.peers.agg(r6(F.avg("score")).alias("mean"), F.max("score").alias("most"), F.count_distinct("country").alias("n"))


@query("a16_peer_set_median", "SELECT n_regionkey, round(median(base), 6) AS middle, count(*) AS n FROM (SELECT n_regionkey, country, avg(score) AS base FROM peers JOIN nation ON country = n_name GROUP BY n_regionkey, country) GROUP BY n_regionkey HAVING count(*) >= 2")
def _(t):
    home = t.nation.select(F.col("n_name").alias("country"), "n_regionkey")
    base = t.peers.join(home, "country").groupBy("n_regionkey", "country").agg(F.avg("score").alias("base"))
    return base.groupBy("n_regionkey").agg(r6(F.median("base")).alias("middle"), F.count("*").alias("n")).where("n >= 2")


@query("a30_market_averages", "SELECT market_id, round(avg(low), 1) AS low, round(avg(high), 1) AS high FROM (SELECT market_id, company, min(numeric_value) AS low, max(numeric_value) AS high FROM metric_values JOIN companies USING (company) GROUP BY market_id, company) GROUP BY market_id")
def _(t):
    per = t.metric_values.join(t.companies, "company").groupBy("market_id", "company").agg(F.min("numeric_value").alias("low"), F.max("numeric_value").alias("high"))
    return per.groupBy("market_id").agg(F.round(F.avg("low"), 1).alias("low"), F.round(F.avg("high"), 1).alias("high"))


@query("a32_weighted_total", "SELECT company, round(sum(w * s) / sum(w), 6) AS available, CASE WHEN count(*) = 3 THEN round(sum(w * s), 6) END AS complete FROM (SELECT company, CASE pillar WHEN 'E' THEN 0.4::DOUBLE WHEN 'S' THEN 0.35::DOUBLE ELSE 0.25::DOUBLE END AS w, avg(strength) AS s FROM claims WHERE confidence > 0.9 AND polarity = 1 AND strength < 0.2 GROUP BY company, pillar) GROUP BY company")
def _(t):
    rows = t.claims.where("confidence > 0.9 and polarity = 1 and strength < 0.2").groupBy("company", "pillar").agg(F.avg("strength").alias("s"))
    w = F.when(F.col("pillar") == "E", 0.4).when(F.col("pillar") == "S", 0.35).otherwise(0.25)
    rows = rows.withColumn("w", w)
    total = F.sum(F.col("w") * F.col("s"))
    return rows.groupBy("company").agg(r6(total / F.sum("w")).alias("available"), F.when(F.count("*") == 3, r6(total)).alias("complete"))


@query("a40_flag_counts", "SELECT c_nationkey AS iso, count(*) FILTER (o_orderstatus = 'F') AS in_force, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")
def _(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").alias("iso")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("in_force"), F.count("*").alias("n"))


@query("j21_records_by_tokens", "WITH k AS (SELECT p_partkey AS company, string_split(p_name, ' ') AS tokens FROM part), r AS (SELECT p_partkey AS record, string_split(concat(p_name, ' ', lower(p_type)), ' ') AS words FROM part) SELECT company, count(*) AS n, min(record) AS first_record FROM k, r WHERE len(list_filter(tokens, lambda w: NOT list_contains(words, w))) = 0 GROUP BY company")
def _(t):
    """Names of equal tokens are matched once, by their rarest token, with records of equal words; all tokens are then verified."""
    companies = t.part.select(F.col("p_partkey").alias("company"), F.array_sort(F.array_distinct(F.split("p_name", " "))).alias("tokens"))
    words = F.array_sort(F.array_distinct(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")))
    records = t.part.groupBy(words.alias("words")).agg(F.count("*").alias("n_records"), F.min("p_partkey").alias("least"))
    index = records.select("words", "n_records", "least", F.explode("words").alias("token"))
    often = index.groupBy("token").agg(F.count("*").alias("n_sets"))
    rare = companies.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(often, "token", "left")
    rare = ranking.first_per_key(rare, ["tokens"], F.coalesce("n_sets", F.lit(0)), F.col("token"))
    hits = rare.join(index, "token").where(F.size(F.array_except("tokens", "words")) == 0)
    found = hits.groupBy("tokens").agg(F.sum("n_records").alias("n"), F.min("least").alias("first_record"))
    return companies.join(found, "tokens").select("company", "n", "first_record")


@query("j17_token_overlap", "WITH a AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS x FROM part), b AS (SELECT p_partkey + 1 AS p_partkey, list_distinct(string_split(p_name, ' ')) AS y FROM part) SELECT a.p_partkey, round((len(list_intersect(x, y)) / len(x)::DOUBLE + len(list_intersect(x, y)) / len(y)::DOUBLE) / 2, 6) AS overlap FROM a JOIN b ON a.p_partkey = b.p_partkey WHERE len(list_intersect(x, y)) / len(x)::DOUBLE >= 0.5 AND len(list_intersect(x, y)) / len(y)::DOUBLE >= 0.5")
def _(t):
    a = t.part.select("p_partkey", F.array_distinct(F.split("p_name", " ")).alias("x"))
    b = t.part.select((F.col("p_partkey") + 1).alias("p_partkey"), F.array_distinct(F.split("p_name", " ")).alias("y"))
    rows = a.join(b, "p_partkey").withColumn("overlap", r6(names.overlap_match(F.col("x"), F.col("y"), 0.5, 0.5)))
    return rows.where("overlap is not null").select("p_partkey", "overlap")


@query("d05_ordered_distinct", "SELECT user_id, list_slice(list(event_type ORDER BY first_id), 1, 3) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def _(t):
    first = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    ordered = F.array_sort(F.collect_list(F.struct("first_id", "event_type")))
    return first.groupBy("user_id").agg(F.slice(F.transform(ordered, lambda x: x["event_type"]), 1, 3).alias("kinds"))


@query("d06_first_of_key_and_year", "SELECT company, metric, reporting_year, numeric_value FROM metric_values QUALIFY row_number() OVER (PARTITION BY company, metric, reporting_year ORDER BY seq) = 1")
def _(t):
    return ranking.first_per_key(t.metric_values, ["company", "metric", "reporting_year"], F.col("seq")).select("company", "metric", "reporting_year", "numeric_value")


@query("c15_sector_anchor", "WITH s AS (SELECT c_mktsegment AS sector, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment) SELECT sector, round(100 * (1 - (row_number() OVER (ORDER BY total, sector) - 1) / (count(*) OVER () - 1)::DOUBLE), 6) AS anchor FROM s")
def _(t):
    from pyspark.sql import Window as W

    s = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("sector")).agg(F.sum("o_totalprice").alias("total"))
    place = (F.row_number().over(W.orderBy("total", "sector")) - 1) / (F.count("*").over(W.partitionBy()) - 1)
    return s.select("sector", r6(100 * (1 - place)).alias("anchor"))


@query("c06_structural_votes", "WITH s AS (SELECT country, avg(score) AS e, avg(workers) AS a, avg(community) AS b FROM peers GROUP BY country), p AS (SELECT country, 100 - 100 * cume_dist() OVER (ORDER BY e) AS e, (100 * cume_dist() OVER (ORDER BY a) + 100 * cume_dist() OVER (ORDER BY b)) / 2 AS s FROM s) SELECT country, round(e, 6) AS e, round(s, 6) AS s, round((e + s) / 2, 6) AS g FROM p")
def _(t):
    from pyspark.sql import Window as W

    s = t.peers.groupBy("country").agg(F.avg("score").alias("e"), F.avg("workers").alias("a"), F.avg("community").alias("b"))
    share = lambda c: 100 * F.cume_dist().over(W.orderBy(c))
    p = s.select("country", (100 - share("e")).alias("e"), ((share("a") + share("b")) / 2).alias("s"))
    return p.select("country", r6("e").alias("e"), r6("s").alias("s"), r6((F.col("e") + F.col("s")) / 2).alias("g"))


@query("c20_status_counts", "SELECT market_id, count(*) FILTER (revenue > 6000) AS done, count(*) FILTER (revenue <= 6000 AND revenue > 1000) AS running, count(*) FILTER (revenue <= 1000) AS waiting, CASE WHEN count(*) FILTER (revenue <= 6000) = 0 THEN 'complete' ELSE 'open' END AS state FROM companies GROUP BY market_id")
def _(t):
    c = F.col("revenue")
    counts = t.companies.groupBy("market_id").agg(F.count_if(c > 6000).alias("done"), F.count_if((c <= 6000) & (c > 1000)).alias("running"), F.count_if(c <= 1000).alias("waiting"))
    return counts.withColumn("state", F.when(F.col("running") + F.col("waiting") == 0, "complete").otherwise("open"))


@query("c22_lookup_to_metrics", "SELECT name, metric, value FROM (SELECT name, 'workers' AS metric, workers AS value FROM peers UNION ALL SELECT name, 'community', community FROM peers UNION ALL SELECT name, 'customers', customers FROM peers) WHERE value IS NOT NULL AND value >= 0")
def _(t):
    rows = t.peers.unpivot(["name"], ["workers", "community", "customers"], "metric", "value")
    return rows.where("value is not null and value >= 0")


@query("c25b_densest_document", "WITH d AS (SELECT doc_id % 40 AS grp, doc_id, lang, CAST(len(regexp_extract_all(text, '[0-9]+')) AS double) / length(text) * 1000 AS density FROM documents WHERE length(text) > 200) SELECT grp, lang, doc_id, round(density, 6) AS density FROM d QUALIFY row_number() OVER (PARTITION BY grp, lang ORDER BY round(density, 9) DESC, doc_id) = 1")
def _(t):
    density = F.regexp_count("text", F.lit("[0-9]+")).cast("double") / F.length("text") * 1000
    rows = t.documents.where("length(text) > 200").select((F.col("doc_id") % 40).alias("grp"), "doc_id", "lang", density.alias("raw"))
    return ranking.first_per_key(rows, ["grp", "lang"], F.desc(F.round("raw", 9)), F.col("doc_id")).select("grp", "lang", "doc_id", r6("raw").alias("density"))


@query("c29_persistence_rule", "WITH l AS (SELECT company, metric, source, numeric_value FROM metric_values QUALIFY row_number() OVER (PARTITION BY company, metric ORDER BY reporting_year DESC NULLS LAST, seq) = 1) SELECT company, metric, CASE WHEN source = 'agentic_correction' THEN 'correction' WHEN source IN ('report', 'wikirate') THEN 'kept' ELSE 'estimate' END AS action, CASE WHEN source IN ('report', 'wikirate') THEN numeric_value ELSE round(numeric_value * 1.1::DOUBLE, 6) END AS value FROM l")
def _(t):
    latest = ranking.first_per_key(t.metric_values, ["company", "metric"], F.desc_nulls_last("reporting_year"), F.col("seq"))
    real = F.coalesce(F.col("source").isin("report", "wikirate"), F.lit(False))
    action = F.when(F.col("source") == "agentic_correction", "correction").when(real, "kept").otherwise("estimate")
    return latest.select("company", "metric", action.alias("action"), F.when(real, F.col("numeric_value")).otherwise(r6(F.col("numeric_value") * 1.1)).alias("value"))


@query("l04_trained_head", "")
def _(t):
    points = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), (F.col("label") == 0).alias("label"))
    held_out = F.crc32(F.col("vec_id").cast("string")) % 4 == 2
    return vectors.trained_head(points, "vec_id", "v", "label", held_out)
