"""Scans, filters, joins, aggregations, set operations and keyed writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, scoring, text
from ..operators import ranking
from ..sources import keyed
from .base import query

r6 = lambda c: F.round(c, 6)


@query("s01_scan_columns", "SELECT company, country, revenue FROM companies")
def _(t):
    return t.companies.select("company", "country", "revenue")


@query("s03_wide_scan_distributions", "SELECT component, count(value) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high FROM (SELECT 'workers' AS component, workers AS value FROM peers UNION ALL SELECT 'community', community FROM peers UNION ALL SELECT 'customers', customers FROM peers) GROUP BY component")
def _(t):
    parts = t.peers.unpivot([], ["workers", "community", "customers"], "component", "value")
    return parts.groupBy("component").agg(F.count("value").alias("n"), r6(F.min("value")).alias("low"), r6(F.max("value")).alias("high"))


@query("s15_links_of_pages", r"SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href FROM pages")
def _(t):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))).alias("href"))


@query("s14_titles_and_paragraphs", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>'))::INT AS n_paragraphs FROM pages")
def _(t):
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).alias("n_paragraphs"))


@query("s24_rollup_levels", "SELECT n_name AS country, c_mktsegment AS sector, grouping(n_name)::INT * 2 + grouping(c_mktsegment)::INT AS level, count(*) AS n, round(sum(c_acctbal), 4) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)")
def _(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("country"), F.col("c_mktsegment").alias("sector"), "c_acctbal")
    return rows.rollup("country", "sector").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 4).alias("total"))


@query("s25_profile_latest", "SELECT iso, max_by(value, CAST(year AS bigint) * 100000000 + seq) AS latest, string_agg(DISTINCT indicator, ',' ORDER BY indicator) AS named, count(DISTINCT year) AS n_years FROM indicators WHERE value IS NOT NULL GROUP BY iso")
def _(t):
    rows = t.indicators.where("value is not null")
    return rows.groupBy("iso").agg(F.max_by("value", F.col("year") * F.lit(100000000).cast("long") + F.col("seq")).alias("latest"), F.array_join(F.array_sort(F.collect_set("indicator")), ",").alias("named"), F.count_distinct("year").alias("n_years"))


@query("f01_optional_filters", "SELECT peer_id, score FROM peers WHERE sector = 'MACHINERY' AND country = 'NATION_3' AND name <> 'Customer#000000001' AND score IS NOT NULL")
def _(t):
    wanted = {"sector": "MACHINERY", "country": "NATION_3", "size": None}
    out = t.peers.where("score is not null and name <> 'Customer#000000001'")
    for column, value in wanted.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.select("peer_id", "score")


@query("f02_null_or_not_prefix", "SELECT seq, source FROM metric_values WHERE source IS NULL OR source NOT LIKE 'agentic\\_%' ESCAPE '\\'")
def _(t):
    return t.metric_values.where(F.col("source").isNull() | ~F.col("source").startswith("agentic_")).select("seq", "source")


@query("f03_any_all", "SELECT seq, metric, source FROM metric_values WHERE metric IN ('m1', 'm4', 'm9') AND source NOT IN ('wikirate', 'report')")
def _(t):
    return t.metric_values.where(F.col("metric").isin("m1", "m4", "m9") & ~F.col("source").isin("wikirate", "report")).select("seq", "metric", "source")


@query("f05_anti_resume", "SELECT company FROM companies WHERE company NOT IN (SELECT company FROM claims WHERE polarity = -1 AND confidence > 0.9 AND strength > 0.9)")
def _(t):
    done = t.claims.where("polarity = -1 and confidence > 0.9 and strength > 0.9").select("company").distinct()
    return t.companies.join(done, "company", "left_anti").select("company")


@query("f06_contains_ignoring_case", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def _(t):
    return t.part.where(F.contains(F.lower("p_name"), F.lit("ring"))).select("p_partkey", "p_name")


@query("f07_exact_then_prefix", "SELECT asked, p_name, p_partkey FROM (SELECT a.p_name AS asked, b.p_name, b.p_partkey, row_number() OVER (PARTITION BY a.p_name ORDER BY CASE WHEN a.p_name = b.p_name THEN 0 ELSE 1 END, length(b.p_name), b.p_name, b.p_partkey) AS n FROM (SELECT DISTINCT p_name FROM part) a JOIN part b ON substr(a.p_name, 1, 5) = substr(b.p_name, 1, 5)) WHERE n = 1")
def _(t):
    """One best row per prefix and one per exact name, so no pair of names meets."""
    parts = t.part.where("p_name is not null").select("p_name", "p_partkey", F.substring("p_name", 1, 5).alias("head"))
    asked = parts.select(F.col("p_name").alias("asked"), "head").distinct()
    exact = parts.groupBy(F.col("p_name").alias("asked")).agg(F.min("p_partkey").alias("exact"))
    near = parts.groupBy("head").agg(F.min(F.struct(F.length("p_name").alias("n"), "p_name", "p_partkey")).alias("near"))
    rows = asked.join(exact, "asked", "left").join(near, "head")
    return rows.select("asked", F.when(F.col("exact").isNotNull(), F.col("asked")).otherwise(F.col("near.p_name")).alias("p_name"), F.coalesce("exact", "near.p_partkey").alias("p_partkey"))


@query("f13_leakage_guard", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%license%' OR lower(text) LIKE '%password%' OR lower(text) LIKE '%token = %'")
def _(t):
    low = F.lower("text")
    return t.documents.where(F.contains(low, F.lit("license")) | F.contains(low, F.lit("password")) | F.contains(low, F.lit("token = "))).select("doc_id")


@query("f14_keyword_relevance", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(license|token|idiot)([^\p{L}\p{N}_]|$)')")
def _(t):
    return t.documents.where(F.col("text").rlike(text.whole_word(["license", "token", "idiot"]))).select("doc_id")


@query("f15_embedding_relevance", "WITH q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id IN (1, 2, 3, 4)), s AS (SELECT e.vec_id, qid, list_inner_product(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(q, lambda x: x::DOUBLE)) AS sim FROM embeddings e, q) SELECT vec_id, round(max(CASE WHEN qid <= 2 THEN sim END) - max(CASE WHEN qid > 2 THEN sim END), 6) AS margin FROM s GROUP BY vec_id HAVING margin > 0.05")
def _(t):
    seeds = t.embeddings.where("vec_id in (1, 2, 3, 4)").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))  # four rows, by key
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    sims = t.embeddings.join(F.broadcast(seeds)).select("vec_id", "qid", dot.alias("sim"))
    margin = r6(F.max(F.when(F.col("qid") <= 2, F.col("sim"))) - F.max(F.when(F.col("qid") > 2, F.col("sim"))))
    return sims.groupBy("vec_id").agg(margin.alias("margin")).where("margin > 0.05")


@query("f20_recency_order", "SELECT event_id, row_number() OVER (ORDER BY ts DESC NULLS LAST, event_id) AS place FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-20 00:00:00' QUALIFY place <= 50")
def _(t):
    kept = t.events.where("ts is null or ts >= timestamp'2024-01-20 00:00:00'").orderBy(F.desc_nulls_last("ts"), "event_id").limit(50)
    from pyspark.sql import Window as W

    return kept.select("event_id", F.row_number().over(W.orderBy(F.desc_nulls_last("ts"), "event_id")).alias("place"))


@query("f26_garbled", r"SELECT doc_id FROM documents WHERE length(text) = 0 OR length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text)::DOUBLE < 0.45 OR length(regexp_replace(text, '[^ \t\r\n]', '', 'g')) / length(text)::DOUBLE < 0.08")
def _(t):
    return t.documents.where(text.looks_garbled(F.col("text"))).select("doc_id")


@query("f32_closed_set", "SELECT seq, factor, pillar FROM claims WHERE factor IN (SELECT factor FROM factors) AND pillar IN ('E', 'S', 'G')")
def _(t):
    return t.claims.where(F.col("pillar").isin("E", "S", "G")).join(t.factors.select("factor"), "factor", "left_semi").select("seq", "factor", "pillar")


@query("j01_three_way_join", "SELECT name, category, count(*) AS n, round(avg(numeric_value), 6) AS mean_value FROM metric_values JOIN metric_definitions USING (metric) JOIN companies USING (company) GROUP BY name, category")
def _(t):
    rows = t.metric_values.join(t.metric_definitions, "metric").join(t.companies, "company")
    return rows.groupBy("name", "category").agg(F.count("*").alias("n"), r6(F.avg("numeric_value")).alias("mean_value"))


@query("j02_left_count", "SELECT n_name AS market, count(s_suppkey) AS n_companies FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def _(t):
    return t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("market")).agg(F.count("s_suppkey").alias("n_companies"))


@query("j04_best_mapping", "SELECT company, metric, numeric_value FROM (SELECT company, metric, numeric_value, row_number() OVER (PARTITION BY company ORDER BY numeric_value DESC, metric, seq) AS n FROM metric_values WHERE numeric_value >= 30) WHERE n = 1")
def _(t):
    return ranking.first_per_key(t.metric_values.where("numeric_value >= 30"), ["company"], F.desc("numeric_value"), F.col("metric"), F.col("seq")).select("company", "metric", "numeric_value")


@query("j06_claims_with_signals", "SELECT c.company, c.source_tag, count(*) AS n, count(s.n_chars) AS with_text, coalesce(sum(s.n_chars), 0)::BIGINT AS chars FROM claims c LEFT JOIN (SELECT company, source_tag, sum(length(text)) AS n_chars FROM signals GROUP BY company, source_tag) s USING (company, source_tag) GROUP BY c.company, c.source_tag")
def _(t):
    texts = t.signals.groupBy("company", "source_tag").agg(F.sum(F.length("text")).alias("n_chars"))
    rows = t.claims.join(texts, ["company", "source_tag"], "left")
    return rows.groupBy("company", "source_tag").agg(F.count("*").alias("n"), F.count("n_chars").alias("with_text"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


@query("j09_fallback_chain", "WITH exact AS (SELECT country, avg(score) AS base FROM peers WHERE country <> 'NATION_4' GROUP BY country), region_mean AS (SELECT n_regionkey, avg(score) AS base FROM peers JOIN nation ON country = n_name GROUP BY n_regionkey), everything AS (SELECT avg(score) AS base FROM peers) SELECT company, round(coalesce(e.base, r.base, g.base), 6) AS base, CASE WHEN e.base IS NOT NULL THEN 'exact' WHEN r.base IS NOT NULL THEN 'parent' ELSE 'global' END AS how FROM companies c JOIN nation n ON c.country = n.n_name LEFT JOIN exact e ON e.country = c.country LEFT JOIN region_mean r ON r.n_regionkey = n.n_regionkey, everything g")
def _(t):
    exact = t.peers.where("country <> 'NATION_4'").groupBy("country").agg(F.avg("score").alias("exact"))
    home = t.nation.select(F.col("n_name").alias("country"), "n_regionkey")
    parent = t.peers.join(home, "country").groupBy("n_regionkey").agg(F.avg("score").alias("parent"))
    everything = t.peers.agg(F.avg("score").alias("everything"))  # one row
    rows = t.companies.join(home, "country").join(exact, "country", "left").join(parent, "n_regionkey", "left").join(F.broadcast(everything))
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("parent").isNotNull(), "parent").otherwise("global")
    return rows.select("company", r6(F.coalesce("exact", "parent", "everything")).alias("base"), how.alias("how"))


@query("j12_peers_without_self", "SELECT company, count(p.peer_id) AS n_peers, round(median(p.score), 6) AS middle FROM companies c JOIN peers p ON c.country = p.country AND lower(p.name) <> replace(lower(c.name), 'supplier', 'customer') GROUP BY company")
def _(t):
    peers = t.peers.select("country", names.normal_form(F.col("name")).alias("name"), "score", "peer_id")
    owners = t.companies.select("company", "country", F.regexp_replace(names.normal_form(F.col("name")), "supplier", "customer").alias("name"))
    out = ranking.medians_without_own(peers, "country", "name", "score", "peer_id", owners)
    return out.where("n_others > 0").select("company", F.col("n_others").alias("n_peers"), r6("middle").alias("middle"))


@query("j13_crosswalk", "SELECT peer_id, CASE sector WHEN 'MACHINERY' THEN 'industry' WHEN 'AUTOMOBILE' THEN 'industry' WHEN 'BUILDING' THEN 'real estate' END AS label FROM peers")
def _(t):
    known = {"MACHINERY": "industry", "AUTOMOBILE": "industry", "BUILDING": "real estate"}
    return t.peers.select("peer_id", F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col("sector")].alias("label"))


@query("j20_id_then_name", "SELECT o_orderkey, coalesce(a.c_name, b.c_name) AS found, CASE WHEN a.c_name IS NOT NULL THEN 'id' WHEN b.c_name IS NOT NULL THEN 'name' ELSE 'none' END AS how FROM orders LEFT JOIN customer a ON o_custkey = a.c_custkey AND a.c_mktsegment <> 'BUILDING' LEFT JOIN customer b ON b.c_name = concat('Customer#', lpad(CAST(o_custkey AS string), 9, '0')) AND b.c_acctbal >= 0")
def _(t):
    a = t.customer.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("by_id"))
    b = t.customer.where("c_acctbal >= 0").select(F.col("c_name").alias("name"), F.col("c_name").alias("by_name"))
    rows = t.orders.withColumn("name", F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).join(a, "o_custkey", "left").join(b, "name", "left")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name").otherwise("none")
    return rows.select("o_orderkey", F.coalesce("by_id", "by_name").alias("found"), how.alias("how"))


@query("j24_distinct_semi", "SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 45")
def _(t):
    returned = t.lineitem.where("l_returnflag = 'R' and l_linestatus = 'F' and l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(returned, "o_orderkey", "left_semi").select("o_custkey").distinct()


@query("a02_group_with_nulls", "SELECT metric, reporting_year, source, count(*) AS n, round(sum(numeric_value), 4) AS total FROM metric_values GROUP BY metric, reporting_year, source")
def _(t):
    return t.metric_values.groupBy("metric", "reporting_year", "source").agg(F.count("*").alias("n"), F.round(F.sum("numeric_value"), 4).alias("total"))


@query("a04_column_profile", "SELECT 'source' AS name, count(source) AS filled, round(100.0 * count(source) / count(*), 6) AS pct FROM metric_values UNION ALL SELECT 'numeric_value', count(numeric_value), round(100.0 * count(numeric_value) / count(*), 6) FROM metric_values UNION ALL SELECT 'reporting_year', count(reporting_year), round(100.0 * count(reporting_year) / count(*), 6) FROM metric_values")
def _(t):
    columns = ["source", "numeric_value", "reporting_year"]
    one = t.metric_values.agg(F.count("*").alias("all"), *[F.count(c).alias(c) for c in columns])
    return one.unpivot(["all"], columns, "name", "filled").select("name", "filled", r6(100.0 * F.col("filled") / F.col("all")).alias("pct"))


@query("a06_exact_median", "SELECT sector, country, round(median(score), 6) AS middle, count(score) AS n FROM peers GROUP BY sector, country")
def _(t):
    return t.peers.groupBy("sector", "country").agg(r6(F.median("score")).alias("middle"), F.count("score").alias("n"))


@query("a08_mean_of_available", "SELECT peer_id, round((coalesce(workers, 0) + coalesce(community, 0) + coalesce(customers, 0)) / nullif((workers IS NOT NULL)::INT + (community IS NOT NULL)::INT + (customers IS NOT NULL)::INT, 0), 6) AS mean_part FROM peers")
def _(t):
    return t.peers.select("peer_id", r6(scoring.mean_of(F.col("workers"), F.col("community"), F.col("customers"))).alias("mean_part"))


@query("a09_net_impact", "SELECT peer_id, CASE WHEN workers IS NULL AND community IS NULL AND customers IS NULL THEN NULL ELSE round(coalesce(workers, 0) + coalesce(community, 0) - coalesce(customers, 0), 6) END AS net FROM peers")
def _(t):
    return t.peers.select("peer_id", r6(scoring.net_of([F.col("workers"), F.col("community")], [F.col("customers")])).alias("net"))


@query("a12_latest_value", "SELECT iso, indicator, max_by(value, CAST(year AS bigint) * 100000000 + seq) AS latest FROM indicators WHERE value IS NOT NULL GROUP BY iso, indicator")
def _(t):
    return t.indicators.where("value is not null").groupBy("iso", "indicator").agg(F.max_by("value", F.col("year") * F.lit(100000000).cast("long") + F.col("seq")).alias("latest"))


@query("a13_pivot_first", "SELECT iso, " + ", ".join(f"min_by(value, seq) FILTER (indicator = 'i{k}' AND value IS NOT NULL) AS i{k}" for k in range(4)) + " FROM indicators GROUP BY iso")
def _(t):
    rows = t.indicators.where("value is not null")
    wide = rows.groupBy("iso").pivot("indicator", ["i0", "i1", "i2", "i3"]).agg(F.min_by("value", "seq"))
    return t.indicators.select("iso").distinct().join(wide, "iso", "left")


@query("a29_entity_index", "SELECT user_id, event_type, count(*) AS n, CAST(min(year(ts) * 100 + month(ts)) AS int) AS first_month, CAST(max(year(ts) * 100 + month(ts)) AS int) AS last_month, round(sum(value), 4) AS volume, min_by(value, event_id) AS sample FROM events GROUP BY user_id, event_type")
def _(t):
    month = F.year("ts") * 100 + F.month("ts")
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min(month).alias("first_month"), F.max(month).alias("last_month"), F.round(F.sum("value"), 4).alias("volume"), F.min_by("value", "event_id").alias("sample"))


@query("a33_provenance_counts", "SELECT company, count(*) FILTER (source = 'report') AS n_real, count(*) FILTER (source LIKE 'agentic%') AS n_estimated, max(reporting_year) AS last_year, CASE WHEN n_real > 0 AND n_estimated > 0 THEN 'mixed' WHEN n_real > 0 THEN 'reported' WHEN n_estimated > 0 THEN 'estimated' ELSE 'none' END AS kind FROM metric_values GROUP BY company")
def _(t):
    rows = t.metric_values.groupBy("company").agg(F.count_if(F.col("source") == "report").alias("n_real"), F.count_if(F.col("source").startswith("agentic")).alias("n_estimated"), F.max("reporting_year").alias("last_year"))
    real, guess = F.col("n_real") > 0, F.col("n_estimated") > 0
    return rows.withColumn("kind", F.when(real & guess, "mixed").when(real, "reported").when(guess, "estimated").otherwise("none"))


@query("a41_completeness", "SELECT market_id, count(*) AS n, count(DISTINCT CASE WHEN filled > 0 THEN c.company END) AS complete FROM companies c LEFT JOIN (SELECT company, count(*) AS filled FROM metric_values WHERE metric = 'm3' AND numeric_value > 40 GROUP BY company) USING (company) GROUP BY market_id")
def _(t):
    filled = t.metric_values.where("metric = 'm3' and numeric_value > 40").select("company").distinct().withColumn("filled", F.lit(1))
    return t.companies.join(filled, "company", "left").groupBy("market_id").agg(F.count("*").alias("n"), F.count("filled").alias("complete"))


@query("t01_top_then_seeded_sample", "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS n FROM customer) WHERE n <= 200 ORDER BY md5(concat('7:', CAST(c_custkey AS string))), c_custkey LIMIT 25")
def _(t):
    head = t.customer.orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(200)
    return head.orderBy(F.md5(F.concat(F.lit("7:"), F.col("c_custkey").cast("string"))), "c_custkey").limit(25).select("c_custkey")


@query("t04_hybrid_top_k", "WITH s AS (SELECT doc_id % 50 AS grp, doc_id, CAST(length(text) AS double) AS sparse, CAST(n_chars % 97 AS double) AS dense FROM documents), n AS (SELECT *, (sparse - min(sparse) OVER w) / nullif(max(sparse) OVER w - min(sparse) OVER w, 0) AS a, (dense - min(dense) OVER w) / nullif(max(dense) OVER w - min(dense) OVER w, 0) AS b FROM s WINDOW w AS (PARTITION BY grp)) SELECT grp, doc_id, round(greatest(coalesce(a, 0), coalesce(b, 0)), 6) AS score FROM n QUALIFY row_number() OVER (PARTITION BY grp ORDER BY greatest(coalesce(a, 0), coalesce(b, 0)) DESC, doc_id) <= 3")
def _(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("grp")
    rows = t.documents.select((F.col("doc_id") % 50).alias("grp"), "doc_id", F.length("text").cast("double").alias("sparse"), (F.col("n_chars") % 97).cast("double").alias("dense"))
    scaled = lambda c: F.coalesce((F.col(c) - F.min(c).over(w)) / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0)), F.lit(0.0))
    rows = rows.withColumn("raw", F.greatest(scaled("sparse"), scaled("dense")))
    return ranking.top_per_key(rows, ["grp"], 3, F.desc("raw"), F.col("doc_id")).select("grp", "doc_id", r6("raw").alias("score"))


@query("u01_union_by_name", "SELECT 'peer' AS kind, name, country, score, NULL::DOUBLE AS revenue FROM peers UNION ALL SELECT 'company', name, country, NULL, revenue FROM companies")
def _(t):
    a = t.peers.select(F.lit("peer").alias("kind"), "name", "country", "score")
    return a.unionByName(t.companies.select(F.lit("company").alias("kind"), "name", "country", "revenue"), allowMissingColumns=True)


@query("u06_token_sets", "WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part) SELECT p_partkey, len(list_intersect(a, ['ring', 'red', 'small'])) AS common, len(list_filter(list_distinct(a), lambda x: NOT list_contains(['ring'], x))) AS rest FROM w")
def _(t):
    words = F.split("p_name", " ")
    return t.part.select("p_partkey", F.size(F.array_intersect(words, F.array(F.lit("ring"), F.lit("red"), F.lit("small")))).alias("common"), F.size(F.array_except(words, F.array(F.lit("ring")))).alias("rest"))


_OLD = "SELECT company, metric, max(numeric_value) AS value FROM metric_values WHERE seq % 3 = 0 GROUP BY company, metric"
_NEW = "SELECT company, metric, min(numeric_value) AS value FROM metric_values WHERE seq % 5 = 0 GROUP BY company, metric"


def _old_new(t):
    group = lambda df, f: df.groupBy("company", "metric").agg(f("numeric_value").alias("value"))
    return group(t.metric_values.where("seq % 3 = 0"), F.max), group(t.metric_values.where("seq % 5 = 0"), F.min)


@query("k01_upsert", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.company = o.company AND n.metric = o.metric)")
def _(t):
    return keyed.upsert(*_old_new(t), ["company", "metric"])


@query("k02_upsert_coalescing", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT company, metric, coalesce(n.value, o.value) AS value FROM o FULL JOIN n USING (company, metric)")
def _(t):
    return keyed.upsert_coalescing(*_old_new(t), ["company", "metric"])


@query("k03_insert_ignoring", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT *, false AS inserted FROM o UNION ALL SELECT n.*, true FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.company = o.company AND n.metric = o.metric)")
def _(t):
    return keyed.insert_ignoring(*_old_new(t), ["company", "metric"])


@query("k04_replace_scope", f"WITH o AS ({_OLD}), n AS ({_NEW} HAVING company LIKE 'c1%') SELECT * FROM o WHERE company NOT IN (SELECT company FROM n) UNION ALL SELECT * FROM n")
def _(t):
    old, new = _old_new(t)
    return keyed.replace_scope(old, new.where("company like 'c1%'"), ["company"])


@query("k09_claim_batch", "SELECT o_orderkey, CASE WHEN n <= 10 THEN 'processing' ELSE 'pending' END AS status FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'estimated' ELSE 'failed' END FROM orders WHERE o_orderstatus <> 'O'")
def _(t):
    first = t.orders.where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(10).select("o_orderkey", F.lit(True).alias("taken"))
    status = F.when(F.col("o_orderstatus") == "F", "estimated").when(F.col("o_orderstatus") != "O", "failed").when(F.col("taken"), "processing").otherwise("pending")
    return t.orders.join(first, "o_orderkey", "left").select("o_orderkey", status.alias("status"))
