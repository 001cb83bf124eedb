"""Names looked up in registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registers
from .base import query

_QUALIFIERS = ["economy", "standard", "small"]
_IN = "('economy', 'standard', 'small')"


@query("j19_register_prefix", f"""WITH asked AS (SELECT p_partkey, lower(concat(p_name, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(' ', p_type) END, CASE WHEN p_partkey % 7 = 0 THEN ' small' ELSE '' END)) AS key FROM part),
known AS (SELECT key, max_by(id, id) AS id, min(id) AS seq FROM (SELECT p_partkey AS id, lower(CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 2) WHEN p_partkey % 3 = 1 THEN p_name ELSE concat(p_name, ' small') END) AS key FROM part WHERE p_size > 20) GROUP BY key)
SELECT p_partkey, id FROM asked LEFT JOIN (SELECT p_partkey, id FROM asked a JOIN known k ON a.key = k.key OR (length(k.key) > 3 AND starts_with(a.key, concat(k.key, ' ')) AND len(list_filter(string_split(substr(a.key, length(k.key) + 2), ' '), lambda w: w NOT IN {_IN})) = 0)
  QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY a.key = k.key DESC, seq) = 1) USING (p_partkey)""")
def _(t):
    typed = F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit(" "), "p_type")), F.when(F.col("p_partkey") % 7 == 0, ", small Inc.").otherwise(""))
    listed = F.when(F.col("p_partkey") % 3 == 0, F.split("p_name", " ")[1]).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" Small Corp")))
    register = t.part.where("p_size > 20").select(listed.alias("name"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("seq"))
    return registers.by_prefix(t.part.select("p_partkey", typed.alias("name")), "name", register, _QUALIFIERS).select("p_partkey", "id")


@query("j18_name_subsets", f"""WITH names AS (SELECT p_partkey, lower(concat(p_name, ' ', p_type)) AS name FROM part), listed AS (SELECT name, max(n) AS n, min(seq) AS seq FROM (SELECT lower(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE concat(p_type, ' ', p_name) END) AS name, p_size AS n, p_partkey AS seq FROM part WHERE p_partkey % 4 <> 3) GROUP BY name),
asked AS (SELECT DISTINCT name FROM names), words AS (SELECT name, list_sort(list_distinct(list_filter(string_split_regex(name, '[^a-z0-9]+'), lambda w: length(w) > 2))) AS ws FROM (SELECT name FROM asked UNION SELECT name FROM listed)),
pairs AS (SELECT a.name, l.name AS found, n, seq FROM asked a JOIN words wa USING (name), listed l JOIN words wl ON wl.name = l.name WHERE (list_has_all(wa.ws, wl.ws) OR list_has_all(wl.ws, wa.ws)) AND len(list_filter(list_concat(list_filter(wa.ws, lambda w: NOT list_contains(wl.ws, w)), list_filter(wl.ws, lambda w: NOT list_contains(wa.ws, w))), lambda w: w NOT IN {_IN})) = 0),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, seq) = 1)
SELECT p_partkey, coalesce(l.name, b.found) AS found FROM names LEFT JOIN listed l USING (name) LEFT JOIN best b ON b.name = names.name""")
def _(t):
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_type", "p_name"))
    index = t.part.where("p_partkey % 4 <> 3").select(name.alias("name"), F.col("p_size").alias("n"), F.col("p_partkey").alias("seq"))
    return registers.by_core(t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("name")), "name", index, _QUALIFIERS).select("p_partkey", "found")


@query("j15_most_like_names", "")
def _(t):
    return registers.most_like(t.part.select(F.concat_ws(" ", "p_name", "p_type")), t.part.select(F.concat_ws(" ", "p_name", "p_brand")), 0.6)


@query("x07_most_like_by_words", "")
def _(t):
    return registers.most_like(t.part.select(F.concat_ws(" ", "p_name", "p_type")), t.part.select(F.concat_ws(" ", "p_name", "p_brand")), 0.5, by_words=True)


@query("j15_containing_names", "WITH n AS (SELECT DISTINCT c_name AS name FROM customer), k AS (SELECT DISTINCT right(s_name, 3) AS needle FROM supplier) SELECT needle, name FROM n JOIN k ON contains(lower(name), needle)")
def _(t):
    return registers.containing(t.supplier.select(F.expr("right(s_name, 3)")), t.customer.select("c_name"))
