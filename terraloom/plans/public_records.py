"""Records of many sources matched to companies, as one table of rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.record_rules import RecordRule, record_signals
from .base import query

_CUSTOMER = "lpad(CAST({0} AS string), 9, '0')"
RULES = [
    RecordRule("recall", "orders", (f"concat('CUSTOMER#', {_CUSTOMER.format('o_custkey')}, ' Inc.')",), "strict", ("o_orderpriority", "CAST(CAST(floor(o_totalprice) AS bigint) AS string)", "substr(CAST(o_orderdate AS string), 1, 10)"), "o_orderkey", "o_orderstatus = 'F'", "substr(CAST(o_orderdate AS string), 1, 10)", 1996, head="Recall: ", link=" <https://recalls.example/>"),
    RecordRule("award", "orders", (f"concat('customer#', {_CUSTOMER.format('o_custkey')})",), "neutral", ("CAST(CAST(floor(o_totalprice) AS bigint) AS string)", "o_orderpriority"), "o_orderkey", "o_orderstatus = 'O'", cap=5, head="Awards: ", polarity="neutral"),
    RecordRule("sanction", "customer", ("c_name",), "strict", ("c_name", "c_mktsegment"), "c_custkey", "c_acctbal < 0", head="Sanctions: "),
    RecordRule("facility", "lineitem", (f"concat('Supplier#', {_CUSTOMER.format('l_suppkey')}, ' plant')",), "strict", ("l_returnflag", "l_linestatus", "substr(CAST(l_shipdate AS string), 1, 4)"), "l_orderkey * 10 + l_linenumber", distinct=True, cap=10, head="Facilities: ", polarity="footprint"),
    RecordRule("spill", "lineitem", (f"concat('Supplier#', {_CUSTOMER.format('l_suppkey')})",), "strict", ("substr(CAST(l_shipdate AS string), 1, 10)", "CAST(CAST(floor(l_quantity) AS bigint) AS string)"), "l_orderkey * 10 + l_linenumber", "l_returnflag = 'R' AND l_quantity > 45", "substr(CAST(l_shipdate AS string), 1, 10)", 1997, head="Spills: "),
    RecordRule("rating", "supplier", ("s_name",), "neutral", ("CAST(CAST(floor(s_acctbal) AS bigint) AS string)",), "s_suppkey", polarity="rating"),
    RecordRule("notice", "events", (f"concat('about Customer#', {_CUSTOMER.format('user_id')}, '/x')",), "substring", ("event_type", "CAST(CAST(floor(value) AS bigint) AS string)"), "event_id", "event_type = 'error'", distinct=True, cap=8, head="Notices: "),
    RecordRule("action", "conversations", (f"concat('Customer#', {_CUSTOMER.format('conv_id')}, ' and partners')",), "strict", ("role", "nullif(CAST(turn AS string), '0')"), "conv_id * 1000 + turn", "turn < 4", head="Actions: "),
    RecordRule("leak", "customer", ("concat('former ', c_name)", f"concat('Supplier#', {_CUSTOMER.format('c_custkey')})"), "strict", ("c_mktsegment",), "c_custkey", "c_nationkey < 12", head="Leaks: ", polarity="transparency"),
]

_COMPANIES = "SELECT concat('k', CAST(c_custkey AS string)) AS company, c_name AS name FROM customer UNION ALL SELECT concat('s', CAST(s_suppkey AS string)), s_name FROM supplier"


def _rule_sql(r: RecordRule) -> str:
    told = ", ".join(f"nullif(trim(CAST({c} AS string)), '')" for c in r.told)
    recent = f"AND (len(regexp_extract_all({r.dated}, '(?:19|20)[0-9][0-9]')) = 0 OR list_max(list_transform(regexp_extract_all({r.dated}, '(?:19|20)[0-9][0-9]'), lambda y: y::INT)) >= {r.since})" if r.dated else ""
    return f"""SELECT '{r.tag}' AS tag, '{r.match}' AS match, unnest([{", ".join(r.names)}]) AS name, concat_ws('; ', {told}) AS body, {r.order} AS seq, {str(r.distinct).lower()} AS once, {r.cap or 2200} AS cap, '{r.head}' AS head, '{r.link}' AS link, '{r.polarity}' AS polarity FROM {r.table} WHERE ({r.where}) {recent}"""


_STOPS = "('inc', 'the', 'and', 'for')"
_SQL = f"""WITH companies2 AS ({_COMPANIES}), records AS (SELECT * FROM ({" UNION ALL ".join(map(_rule_sql, RULES))}) WHERE body <> ''),
listed AS (SELECT DISTINCT match, name, string_split_regex(lower(name), '[^a-z0-9]+') AS words FROM records),
asked AS (SELECT company, name AS own, list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN {_STOPS}) AS tokens FROM companies2),
pairs AS (SELECT match, name, company FROM listed JOIN asked ON list_has_all(words, tokens) WHERE match <> 'substring' AND len(tokens) > 0 AND (match = 'neutral' OR (list_sum(list_transform(tokens, lambda w: length(w))) >= 8 AND (len(tokens) > 1 OR length(tokens[1]) >= 10)))
  UNION ALL SELECT match, name, company FROM listed JOIN asked ON contains(lower(name), lower(trim(substr(own, 1, 40)))) WHERE match = 'substring'),
met AS (SELECT DISTINCT company, tag, seq, body, once, cap, head, link, polarity FROM records JOIN pairs USING (match, name)),
said AS (SELECT company, tag, body, min(seq) AS seq, any_value(cap) AS cap, any_value(head) AS head, any_value(link) AS link, any_value(polarity) AS polarity FROM met GROUP BY company, tag, body, CASE WHEN once THEN NULL ELSE seq END)
SELECT company, tag, any_value(polarity) AS polarity, any_value(n) AS n_records, concat(any_value(head), substr(string_agg(body, ' | ' ORDER BY nth), 1, 2200), any_value(link)) AS text FROM (
  SELECT *, row_number() OVER (PARTITION BY company, tag ORDER BY seq, body) AS nth, count(*) OVER (PARTITION BY company, tag) AS n FROM said) WHERE nth <= cap GROUP BY company, tag"""


@query("s_record_signals", _SQL)
def _(t):
    tables = {r.table: getattr(t, r.table) for r in RULES}
    customers = t.customer.select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("company"), F.col("c_name").alias("name"))
    suppliers = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("company"), F.col("s_name").alias("name"))
    return record_signals(RULES, tables, customers.unionByName(suppliers))
