"""Registry of queries, and the views that recast the given tables as claims, signals, metrics and peers.

The views are SQL that Spark and DuckDB read alike, so a query and the SQL it must equal start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "claims": """
SELECT l_orderkey * 10 + l_linenumber AS seq, concat('c', CAST(l_suppkey AS string)) AS company,
  CASE CAST(l_partkey % 3 AS int) WHEN 0 THEN 'E' WHEN 1 THEN 'S' ELSE 'G' END AS pillar, concat('f', CAST(l_partkey % 29 AS string)) AS factor,
  CASE l_returnflag WHEN 'R' THEN -1 WHEN 'A' THEN 0 ELSE 1 END AS polarity, l_discount * 10 AS strength, l_tax * 12.5 AS confidence, l_quantity AS value,
  CASE CAST(l_orderkey % 4 AS int) WHEN 0 THEN 'extracted' WHEN 1 THEN 'dataset_lookup' WHEN 2 THEN 'peer_ratio_fallback' ELSE 'coarse_bucket' END AS method,
  concat('s', CAST(l_partkey % 7 AS string)) AS source_tag, l_shipdate AS reported FROM lineitem""",
    "factors": """
SELECT DISTINCT concat('f', CAST(p_partkey % 29 AS string)) AS factor, CAST(1 + (p_partkey % 29) % 8 AS double) AS weight,
  50.0 - (p_partkey % 29) AS full_value, CAST((p_partkey % 29) % 5 AS double) AS none_value FROM part WHERE p_partkey % 29 < 26""",
    "signals": """
SELECT concat('c', CAST(doc_id % 100 AS string)) AS company, concat('s', CAST(doc_id % 7 AS string)) AS source_tag, doc_id AS seq, text, lang, source FROM documents""",
    "metric_values": """
SELECT l_orderkey * 10 + l_linenumber AS seq, concat('c', CAST(l_suppkey AS string)) AS company, concat('m', CAST(l_partkey % 18 AS string)) AS metric,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(year(l_shipdate) AS int) END AS reporting_year, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_quantity END AS numeric_value,
  CASE CAST(l_orderkey % 5 AS int) WHEN 0 THEN 'agentic_estimate' WHEN 1 THEN 'agentic_correction' WHEN 2 THEN 'report' WHEN 3 THEN NULL ELSE 'wikirate' END AS source FROM lineitem""",
    "metric_definitions": """
SELECT DISTINCT concat('m', CAST(p_partkey % 18 AS string)) AS metric, CASE CAST(p_partkey % 18 % 3 AS int) WHEN 0 THEN 'E' WHEN 1 THEN 'S' ELSE 'G' END AS category,
  (p_partkey % 18) % 4 = 0 AS is_universal, p_partkey % 18 % 2 = 0 AS higher_is_better FROM part""",
    "peers": """
SELECT c_custkey AS peer_id, c_name AS name, c_mktsegment AS sector, n_name AS country, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS score,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal / 2 END AS workers, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal + 10 END AS community,
  CASE WHEN c_custkey % 35 = 0 THEN NULL ELSE CAST(c_custkey % 100 AS double) END AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "companies": """
SELECT concat('c', CAST(s_suppkey AS string)) AS company, s_name AS name, n_name AS country, s_acctbal AS revenue, s_nationkey AS market_id FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "indicators": """
SELECT c_nationkey AS iso, concat('i', CAST(o_orderkey % 12 AS string)) AS indicator, CAST(year(o_orderdate) AS int) AS year,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS value, o_orderkey AS seq FROM orders JOIN customer ON o_custkey = c_custkey""",
    "predictions": """
SELECT concat('c', CAST(c_custkey AS string)) AS company, CASE CAST(c_custkey % 3 AS int) WHEN 0 THEN 'E' WHEN 1 THEN 'S' ELSE 'G' END AS pillar,
  CAST(c_custkey * 7 % 101 AS double) AS predicted, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE floor(c_acctbal / 100) END AS truth,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey * 13 % 97 AS double) END AS holistic, CAST(c_custkey % 21 AS double) AS mass, c_custkey % 4 AS n_claims FROM customer""",
    "critic_verdicts": """
SELECT concat('c', CAST(user_id AS string)) AS company, CASE CAST(event_id % 3 AS int) WHEN 0 THEN 'E' WHEN 1 THEN 'S' ELSE 'G' END AS pillar, event_id AS seq, 1 + CAST(floor(event_id / 9) AS int) % 2 AS round,
  CASE CAST(floor(event_id / 3) AS int) % 3 WHEN 0 THEN 'evidence_support' WHEN 1 THEN 'peer_plausibility' ELSE 'internal_consistency' END AS critic,
  CASE WHEN event_type IN ('error', 'purchase') THEN 'refute' WHEN event_type = 'view' THEN 'abstain' ELSE 'pass' END AS verdict,
  CASE WHEN value >= 2 THEN concat('f', CAST(CAST(floor(value) AS int) % 2 AS string)) END AS flagged, concat(event_type, ' ', CAST(event_id AS string)) AS objection FROM events""",
    "calculator": """
SELECT c_custkey AS company_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_nationkey * 3 + 10 AS double) END AS country_score,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(length(c_mktsegment) * 7 AS double) END AS industry_score, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 900 AS double) END AS diesel,
  CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE CAST(c_custkey % 500 AS double) END AS petrol, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_custkey % 4000 AS double) END AS kwh,
  CAST(1 + c_nationkey % 5 AS double) / 8 AS grid, CASE WHEN c_acctbal > 0 THEN c_acctbal * 10 END AS revenue,
  CASE CAST(c_custkey % 4 AS int) WHEN 0 THEN 'none' WHEN 1 THEN 'some' WHEN 2 THEN 'mostly' END AS tier, c_custkey % 40 AS staff, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 25 END AS women,
  CASE CAST(c_custkey % 3 AS int) WHEN 0 THEN true WHEN 1 THEN false END AS fined, CASE CAST(c_custkey % 7 AS int) WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS missed,
  CASE CAST(c_custkey % 3 AS int) WHEN 0 THEN true WHEN 1 THEN false END AS bribery_policy, c_custkey % 2 = 0 AS responsible, c_custkey % 5 = 0 AS whistle FROM customer""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Source:
    """Tables and views of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        for table in TABLES:
            if re.search(rf"\b{table}\b", VIEWS[name]):
                getattr(self, table).createOrReplaceTempView(table)
        return self.spark.sql(VIEWS[name])


def query(name: str, sql: str):
    """Registers a function of a Source as a query; views that the SQL names are defined before it."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if sql:
            used = [f"{v} AS ({body.strip()})" for v, body in VIEWS.items() if re.search(rf"\b{v}\b", sql)]
            body = sql.strip()
            if used and body.upper().startswith("WITH "):
                body = ", ".join(used) + ", " + body[5:]
                ORACLES[name] = "WITH " + body
            else:
                ORACLES[name] = f"WITH {', '.join(used)} {body}" if used else body
        return f

    return add
