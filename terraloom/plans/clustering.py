"""Weights of n-grams, clusters of texts and the severities they lend to claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as K
from ..session import checkpointed
from .base import query
from .scores import r6

STOP = ["the", "and", "of", "to", "de", "la", "que", "der", "die", "und", "le", "les", "en"]
CENTRES, ROUNDS = 3, 3

_CLASS = "CASE CAST({0} % 3 AS int) WHEN 0 THEN 'E' WHEN 1 THEN 'S' ELSE 'G' END"
_STOPS = ", ".join(f"'{w}'" for w in STOP)


def _vectors_sql(name: str) -> str:
    """Counts of the n-grams of the table `name` (grp, key, text) as counts_name."""
    return f"""words_{name} AS (SELECT grp, key, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOPS})) AS ws FROM {name}),
counts_{name} AS (SELECT grp, key, term, count(*) AS tf FROM (SELECT grp, key, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])))) AS term FROM words_{name}) GROUP BY ALL),
raw_{name} AS (SELECT grp, key, term, (1 + ln(tf)) * idf AS w FROM counts_{name} JOIN terms USING (grp, term)),
points_{name} AS MATERIALIZED (SELECT grp, key, term, w / sqrt(sum(w * w) OVER (PARTITION BY grp, key)) AS w FROM raw_{name})"""


_POINTS = f"""WITH corpus AS (SELECT {_CLASS.format("doc_id")} AS grp, doc_id AS key, text, source FROM documents WHERE length(trim(text)) >= 30),
terms AS MATERIALIZED (SELECT grp, term, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM (SELECT grp, term, count(*) AS df, sum(tf) AS total FROM counts_corpus GROUP BY grp, term HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY total DESC, term) <= 5000) JOIN (SELECT grp, count(*) AS n FROM corpus GROUP BY grp) USING (grp)),
{_vectors_sql("corpus")}"""
# The counts come before the vocabulary that is made of them.
_HEAD, _TAIL = _POINTS.split("terms AS MATERIALIZED", 1)
_TERMS, _VECTORS = _TAIL.split("words_corpus AS", 1)
_BEFORE, _AFTER = _VECTORS.split("raw_corpus AS", 1)
_POINTS = f"{_HEAD}words_corpus AS{_BEFORE}terms AS MATERIALIZED{_TERMS}raw_corpus AS{_AFTER}"


def _assigned_sql(i: int) -> str:
    return f"""assigned_{i} AS MATERIALIZED (SELECT grp, key, centre AS cluster FROM (SELECT k.grp, k.key, n.centre, round(norm - 2 * coalesce(dot, 0), 9) AS d FROM (SELECT grp, key FROM corpus) k JOIN (SELECT grp, centre, sum(c * c) AS norm FROM index_{i} GROUP BY ALL) n USING (grp)
  LEFT JOIN (SELECT p.grp, p.key, centre, sum(w * c) AS dot FROM points_corpus p JOIN index_{i} USING (grp, term) GROUP BY ALL) d ON d.grp = k.grp AND d.key = k.key AND d.centre = n.centre) QUALIFY row_number() OVER (PARTITION BY grp, key ORDER BY d, centre) = 1)"""


def _next_sql(i: int) -> str:
    return f"""index_{i + 1} AS MATERIALIZED (SELECT grp, term, cluster AS centre, sum(w) / any_value(n) AS c FROM points_corpus JOIN assigned_{i} USING (grp, key) JOIN (SELECT grp, cluster, count(*) AS n FROM assigned_{i} GROUP BY ALL) USING (grp, cluster) GROUP BY ALL
  UNION ALL SELECT * FROM index_{i} WHERE (grp, centre) NOT IN (SELECT (grp, cluster) FROM assigned_{i}))"""


_SEEDS = f"seeds AS (SELECT {_CLASS.format('item_id')} AS grp, item_id // 3 AS key, text FROM benchmark WHERE item_id < {3 * CENTRES})"
_FITTED = f"{_POINTS}, {_SEEDS}, {_vectors_sql('seeds')}, index_0 AS (SELECT grp, term, key AS centre, w AS c FROM points_seeds), " + ", ".join(f"{_assigned_sql(i)}, {_next_sql(i)}" for i in range(ROUNDS)) + f", {_assigned_sql(ROUNDS)}"
_UNIT = f"unit AS (SELECT grp, term, centre, c / sqrt(sum(c * c) OVER (PARTITION BY grp, centre)) AS c FROM index_{ROUNDS})"
_LAST = f"assigned_{ROUNDS}"


def _class(c: str):
    return F.expr(_CLASS.format(c))


def corpus(t):
    return t.documents.where("length(trim(text)) >= 30").select(_class("doc_id").alias("group"), F.col("doc_id").alias("key"), "text")


def _fit(t):
    texts = corpus(t)
    terms = checkpointed(K.text_vocabulary(texts, STOP))
    points = checkpointed(K.text_vectors(texts, terms, STOP))
    seeds = t.benchmark.where(F.col("item_id") < 3 * CENTRES).select(_class("item_id").alias("group"), F.expr("item_id div 3").alias("key"), "text")
    keys = texts.select("group", "key")
    of, index = K.seeded_clusters(points, keys, K.centre_index(seeds, terms, CENTRES, STOP), CENTRES, ROUNDS)
    return keys, terms, points, of, index


@query("l01_ngram_weights", _POINTS + """ SELECT grp AS "group", key, term, round(w, 6) AS w FROM points_corpus""")
def _(t):
    texts = corpus(t)
    terms = checkpointed(K.text_vocabulary(texts, STOP))
    vectors = K.unpacked(K.text_vectors(texts, terms, STOP))
    return vectors.join(F.broadcast(terms.select("group", "id", "term")), ["group", "id"]).select("group", "key", "term", r6("w").alias("w"))


@query("l02_seeded_clusters", _FITTED + f""" SELECT grp AS "group", key, cluster FROM {_LAST}""")
def _(t):
    return _fit(t)[3].withColumn("cluster", F.col("cluster").cast("long"))


@query("l02_silhouette", _FITTED + f""", sizes AS (SELECT grp, cluster, count(*) AS n FROM {_LAST} GROUP BY ALL), sums AS (SELECT grp, cluster, term, sum(w) AS s FROM points_corpus JOIN {_LAST} USING (grp, key) GROUP BY ALL),
dots AS (SELECT p.grp, p.key, s.cluster, sum(w * s) AS dot FROM points_corpus p JOIN sums s USING (grp, term) GROUP BY ALL), square AS (SELECT grp, key, sum(w * w) AS q FROM points_corpus GROUP BY ALL),
rows AS (SELECT a.grp, a.key, a.cluster AS own, z.cluster, n, coalesce(dot, 0) AS dot, coalesce(q, 0) AS q FROM {_LAST} a JOIN sizes z USING (grp) LEFT JOIN dots d ON d.grp = a.grp AND d.key = a.key AND d.cluster = z.cluster LEFT JOIN square q ON q.grp = a.grp AND q.key = a.key),
ab AS (SELECT grp, key, max(CASE WHEN own = cluster THEN n END) AS n, max(CASE WHEN own = cluster AND n > 1 THEN (n - dot - (1 - q)) / (n - 1) END) AS a, min(CASE WHEN own <> cluster THEN 1 - dot / n END) AS b FROM rows GROUP BY grp, key)
SELECT grp AS "group", count(*) AS n, round(avg(CASE WHEN b IS NULL THEN NULL WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab GROUP BY grp""")
def _(t):
    _, _, points, of, _ = _fit(t)
    return K.silhouettes(points, of, CENTRES).select("group", "n", r6("silhouette").alias("silhouette"))


@query("t06_cluster_description", _FITTED + f""", {_UNIT}, near AS (SELECT a.grp, a.cluster, a.key, round(coalesce(sum(w * c), 0), 9) AS s FROM {_LAST} a LEFT JOIN points_corpus p ON p.grp = a.grp AND p.key = a.key LEFT JOIN unit u ON u.grp = a.grp AND u.term = p.term AND u.centre = a.cluster GROUP BY ALL),
sources AS (SELECT grp, cluster, source, count(*) AS n FROM {_LAST} JOIN corpus USING (grp, key) WHERE source IS NOT NULL GROUP BY ALL)
SELECT grp AS "group", cluster, 'text' AS kind, row_number() OVER (PARTITION BY grp, cluster ORDER BY s DESC, key)::INT AS place, CAST(key AS string) AS value FROM near QUALIFY place <= 4
UNION ALL SELECT grp, centre, 'term', row_number() OVER (PARTITION BY grp, centre ORDER BY round(c, 9) DESC, term)::INT AS place, term FROM index_{ROUNDS} WHERE c > 0 QUALIFY place <= 8
UNION ALL SELECT grp, cluster, 'source', row_number() OVER (PARTITION BY grp, cluster ORDER BY n DESC, source)::INT AS place, source FROM sources QUALIFY place <= 5""")
def _(t):
    _, _, points, of, index = _fit(t)
    row = lambda df, kind, value: df.select("group", F.col("cluster").cast("long").alias("cluster"), F.lit(kind).alias("kind"), "place", F.col(value).cast("string").alias("value"))
    sources = of.join(t.documents.select(F.col("doc_id").alias("key"), "source"), "key").where("source is not null").groupBy("group", "cluster", "source").agg(F.count("*").alias("n"))
    most = K.top_per_key(sources, ["group", "cluster"], 5, F.desc("n"), F.col("source"))
    return row(K.representatives(points, of, index, CENTRES), "text", "key").unionByName(row(K.top_terms(index, CENTRES), "term", "term")).unionByName(row(most, "source", "source"))


_RAW_SEVERITY = "CASE WHEN item_id = 5 THEN NULL ELSE (length(text) % 11)::DOUBLE / 10 END"


_LIKE = _FITTED + f""", {_UNIT}, cited AS (SELECT company, source_tag, min_by(text, seq) AS text FROM signals GROUP BY company, source_tag),
said AS (SELECT DISTINCT c.pillar AS grp, concat(c.company, '/', c.source_tag) AS key, text FROM claims c JOIN cited USING (company, source_tag)), {_vectors_sql("said")},
sims AS (SELECT k.grp, k.key, k.text, n.centre, round(coalesce(s, 0), 9) AS s FROM said k JOIN (SELECT DISTINCT grp, centre FROM unit) n USING (grp) LEFT JOIN (SELECT p.grp, p.key, centre, sum(w * c) AS s FROM points_said p JOIN unit USING (grp, term) GROUP BY ALL) d ON d.grp = k.grp AND d.key = k.key AND d.centre = n.centre),
best AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY grp, key ORDER BY s DESC, centre) = 1),
labels AS (SELECT grp, centre, CASE WHEN v <= 0.375 THEN 0.25 WHEN v <= 0.625 THEN 0.5 WHEN v <= 0.875 THEN 0.75 WHEN v IS NOT NULL THEN 1.0 END::DOUBLE AS severity FROM (SELECT {_CLASS.format("item_id")} AS grp, item_id // 3 AS centre, {_RAW_SEVERITY} AS v FROM benchmark WHERE item_id < {3 * CENTRES}))"""


@query("m19_cluster_severity", _LIKE + f""", met AS (SELECT c.seq, c.strength, c.confidence, b.centre, b.s, severity, coalesce(length(trim(text)) >= 30 AND s >= 0.12 AND severity IS NOT NULL, false) AS hit FROM claims c LEFT JOIN best b ON b.grp = c.pillar AND b.key = concat(c.company, '/', c.source_tag) LEFT JOIN labels l ON l.grp = b.grp AND l.centre = b.centre)
SELECT seq, centre AS cluster, round(s, 6) AS similarity, CASE WHEN hit THEN severity ELSE strength END AS strength, CASE WHEN hit THEN round(confidence * (0.7::DOUBLE + 0.30000000000000004::DOUBLE * least(1.0::DOUBLE, s / 0.45::DOUBLE)), 3) ELSE confidence END AS confidence FROM met""")
def _(t):
    out = K.with_severity(t.claims.join(F.broadcast(like(t)), ["pillar", "company", "source_tag"], "left"), None, "cluster", "similarity", "severity")
    return out.select("seq", F.col("cluster").cast("long").alias("cluster"), r6("similarity").alias("similarity"), "strength", "confidence")


def like(t):
    """pillar, company, source_tag, cluster, similarity and severity (none of short texts) of the texts that claims cite.

    Signals are of 100 companies and 7 tags, so this has 2,100 short rows at most, and claims meet it where they are.
    """
    _, terms, _, _, index = _fit(t)
    cited = checkpointed(t.signals.groupBy("company", "source_tag").agg(F.min_by("text", "seq").alias("text")))
    asked = t.claims.select("company", "source_tag", F.col("pillar").alias("group")).join(F.broadcast(cited.select("company", "source_tag")), ["company", "source_tag"], "left_semi")
    said = checkpointed(asked.distinct().join(cited, ["company", "source_tag"]).select("group", F.concat_ws("/", "company", "source_tag").alias("key"), "text"))
    found = K.similarities(K.text_vectors(said, terms, STOP), said, index, CENTRES).join(said, ["group", "key"])
    raw = F.when(F.col("item_id") != 5, (F.length("text") % 11) / 10)
    labels = t.benchmark.where(F.col("item_id") < 3 * CENTRES).select(_class("item_id").alias("group"), F.expr("CAST(item_id div 3 AS int)").alias("cluster"), K.snapped(raw).alias("severity"))
    found = found.join(labels, ["group", "cluster"], "left").select(
        F.col("group").alias("pillar"), F.split("key", "/")[0].alias("company"), F.split("key", "/")[1].alias("source_tag"),
        "cluster", F.round("similarity", 9).alias("similarity"), K.severity_of(F.col("text"), F.col("severity")).alias("severity"),
    )
    return checkpointed(found)
