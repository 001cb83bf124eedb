"""Countries named in texts, and codes of country names as people write them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import countries
from .base import query

_TEXTS = "SELECT seq, concat(substr(text, 1, 200), ' based in ', lower(country), ', of ', lower(market), '. ', substr(text, 201)) AS text FROM signals JOIN (SELECT company, country, r_name AS market FROM companies JOIN nation ON n_nationkey = market_id JOIN region ON r_regionkey = n_regionkey) USING (company)"
_NAMES = "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region"


@query("x26_first_country", f"""WITH texts AS ({_TEXTS}), names AS ({_NAMES})
SELECT seq, name AS country FROM texts LEFT JOIN (SELECT seq, name FROM texts JOIN names ON contains(lower(text), lower(name)) QUALIFY row_number() OVER (PARTITION BY seq ORDER BY strpos(lower(text), lower(name)), length(name) DESC) = 1) USING (seq)""")
def _(t):
    t.signals.createOrReplaceTempView("signals")
    t.companies.createOrReplaceTempView("companies")
    t.nation.createOrReplaceTempView("nation")
    t.region.createOrReplaceTempView("region")
    names = [r.name for r in t.spark.sql(_NAMES).collect()]  # a dimension table
    return t.spark.sql(_TEXTS).select("seq", countries.first_named(F.col("text"), names).alias("country"))


_CODES = "SELECT concat('N', lpad(CAST(n_nationkey AS string), 2, '0')) AS code, lower(replace(n_name, '_', ' ')) AS name FROM nation"
_ALIASES = "SELECT concat('n', CAST(n_nationkey AS string)) AS alias, concat('N', lpad(CAST(n_nationkey AS string), 2, '0')) AS code FROM nation"
_PARTS = "SELECT DISTINCT lower(p_brand) AS part, concat('N', lpad(CAST(CAST(substr(p_brand, 7) AS int) % 25 AS string), 2, '0')) AS code FROM part"
_RAWS = """SELECT c_custkey, CASE CAST(c_custkey % 12 AS int) WHEN 0 THEN concat('**', name) WHEN 1 THEN concat(upper(name), ' (US)') WHEN 2 THEN concat(name, ', the') WHEN 3 THEN concat(' N.', CAST(c_nationkey AS string), '. ') WHEN 4 THEN concat('12 ', name, ' street')
  WHEN 5 THEN concat('far away  from ', name, ' and more') WHEN 6 THEN 'asia' WHEN 7 THEN concat('Brand#', CAST(c_nationkey AS string)) WHEN 8 THEN concat('ation ', CAST(c_nationkey AS string)) WHEN 9 THEN concat('europe ', name) WHEN 10 THEN NULL ELSE concat('n', lpad(CAST(c_nationkey AS string), 2, '0')) END AS raw
  FROM (SELECT c_custkey, c_nationkey, replace(n_name, '_', ' ') AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query("x25_country_codes", f"""WITH codes AS ({_CODES}), aliases AS ({_ALIASES}), parts AS ({_PARTS}), raws AS ({_RAWS}), bad AS (SELECT list(lower(r_name)) AS words FROM region),
names AS (SELECT k, CASE WHEN count(DISTINCT code) = 1 THEN min(code) END AS c FROM (SELECT lower(code) AS k, code FROM codes UNION ALL SELECT name, code FROM codes) GROUP BY k),
keyed AS (SELECT *, trim(replace(trim(lower(regexp_replace(trim(trim(trim(raw), '*')), '\\s+', ' ', 'g')), ' .,;:-'), '.', '')) AS key FROM raws),
based AS (SELECT *, trim(regexp_replace(trim(regexp_replace(key, '\\s*\\([^)]*\\)\\s*$', '')), ',\\s*(fed rep|fed sts|the)$', '')) AS base FROM keyed)
SELECT c_custkey, raw, CASE WHEN key = '' OR list_contains(words, key) THEN NULL ELSE coalesce((SELECT code FROM aliases WHERE alias = key), (SELECT c FROM names WHERE k = key), CASE WHEN base <> '' THEN (SELECT code FROM aliases WHERE alias = base) END, (SELECT c FROM names WHERE k = base),
  CASE WHEN NOT regexp_matches(raw, '^\\s*[0-9]') AND len(string_split(key, ' ')) <= 5 AND NOT list_has_any(string_split(key, ' '), words) THEN coalesce((SELECT code FROM parts WHERE part = key), (SELECT CASE WHEN count(DISTINCT code) = 1 THEN min(code) END FROM codes WHERE contains(name, key))) END) END AS iso3 FROM based, bad""".replace("\\\\", "\\"))
def _(t):
    for table in ("nation", "part", "customer"):
        getattr(t, table).createOrReplaceTempView(table)
    rejected = [r.w for r in t.region.select(F.lower("r_name").alias("w")).collect()]  # a dimension table
    return countries.resolved(t.spark.sql(_RAWS), "raw", t.spark.sql(_CODES), t.spark.sql(_ALIASES), t.spark.sql(_PARTS), rejected).select("c_custkey", "raw", "iso3")
