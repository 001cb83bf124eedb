"""Candidate windows of texts and predictions over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import INDEX_ENTRY, table_of_contents
from ..operators import candidates
from .base import query

# Terms of a factor are the long words and the first two words of its benchmark items; every fifth item gives a pillar's own.
_TERMS = r"""terms AS (SELECT CASE CAST(item_id % 3 AS int) WHEN 0 THEN 'E' WHEN 1 THEN 'S' ELSE 'G' END AS pillar, CASE WHEN item_id % 5 = 4 THEN NULL ELSE concat('f', CAST(item_id % 29 AS string)) END AS factor, term FROM (
  SELECT item_id, unnest(list_append(regexp_extract_all(lower(text), '[a-zà-ÿ]{8,}'), regexp_extract(lower(text), '^[a-zà-ÿ]+ [a-zà-ÿ]+'))) AS term FROM benchmark) WHERE term <> '')"""
_GROUPS = "groups AS (SELECT DISTINCT pillar, coalesce(factor, pillar) AS factor, term, CASE pillar WHEN 'E' THEN 0 WHEN 'S' THEN 1 ELSE 2 END AS p, factor IS NULL AS own FROM terms)"
# A term doesn't overlap itself: of a run of one word said over and over, every other pair of neighbours counts.
_WINDOWS = rf"""WITH {_TERMS}, {_GROUPS},
pieces AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS piece FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS parts FROM documents WHERE length(text) >= 400)),
placed AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS pos, lead(piece, 1) OVER w AS gap, lead(piece, 2) OVER w AS next FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
said AS (SELECT doc_id, i, pos, piece AS said, false AS pair FROM placed UNION ALL SELECT doc_id, i, pos, concat(piece, ' ', next), true FROM placed WHERE gap = ' '),
met AS (SELECT doc_id, p, own, factor, pillar, i, pos, said, pair, term, i - 2 * row_number() OVER (PARTITION BY doc_id, p, own, factor, term ORDER BY i) AS run FROM said JOIN groups ON lower(said) = term),
hits AS (SELECT doc_id, p, own, factor, pillar, pos, said, length(said) AS n FROM met QUALIFY NOT pair OR row_number() OVER (PARTITION BY doc_id, p, own, factor, term, run ORDER BY i) % 2 = 1),
spans AS (SELECT h.*, greatest(0, pos - 300) AS lo, least(length(text), pos + n + 300) AS hi, text FROM hits h JOIN documents USING (doc_id)),
marked AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY doc_id, p, own, factor ORDER BY pos, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM spans),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, p, own, factor ORDER BY pos, n ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT doc_id, p, own, factor, pillar, min(lo)::INT AS start, max(hi)::INT AS "end", lower(min_by(said, (pos, n))) AS term, any_value(text) AS text FROM islands GROUP BY doc_id, p, own, factor, pillar, island),
texts AS (SELECT * EXCLUDE (text), regexp_replace(substr(text, start + 1, "end" - start), '^\s+|\s+$', '', 'g') AS cut FROM merged),
kept AS (SELECT * FROM texts QUALIFY row_number() OVER (PARTITION BY doc_id, substr(cut, 1, 200) ORDER BY p, own, factor, start) = 1)"""

# A stand-in for a classifier: the share of evidence words, abstaining below a bound.
_EVIDENCE = r"(?i)\b(?:licen[sc]e|token|mail|contact|version)"


def _predict(text):
    p = F.round(F.least(F.lit(1.0), F.regexp_count(text, F.lit(_EVIDENCE)) * 40.0 / (F.length(text) + 100)), 6)
    return F.struct(F.when(F.regexp_count(text, F.lit("(?i)mail|contact")) > 0, "contact").otherwise("legal").alias("label"), p.alias("probability"), (p < 0.05).alias("abstained"))


def term_lists(t) -> list[tuple[str, str, list[str]]]:
    """(factor, pillar, terms) by pillar, the pillar's own terms after those of its factors; the benchmark is small."""
    low = F.lower("text")
    words = F.concat(F.regexp_extract_all(low, F.lit("[a-zà-ÿ]{8,}"), F.lit(0)), F.array(F.regexp_extract(low, "^[a-zà-ÿ]+ [a-zà-ÿ]+", 0)))
    terms = t.benchmark.select((F.col("item_id") % 3).alias("p"), F.when(F.col("item_id") % 5 != 4, F.concat(F.lit("f"), (F.col("item_id") % 29).cast("string"))).alias("factor"), F.explode(words).alias("term")).where("term <> ''")
    rows = terms.groupBy("p", "factor").agg(F.array_sort(F.collect_set("term")).alias("terms")).orderBy("p", F.col("factor").isNull(), "factor").collect()  # the benchmark's words
    return [(r.factor or "ESG"[r.p], "ESG"[r.p], r.terms) for r in rows]


@query("l07_candidate_windows", _WINDOWS + """SELECT doc_id, factor, pillar, start, "end", term, md5(cut) AS window_md5 FROM kept""")
def _(t):
    docs = t.documents.select("doc_id", F.explode(candidates.candidate_windows(F.col("text"), term_lists(t))).alias("w"))
    return docs.select("doc_id", "w.factor", "w.pillar", "w.start", "w.end", F.lower("w.term").alias("term"), F.md5(F.col("w.window").cast("binary")).alias("window_md5"))


_P = r"""round(least(1.0::DOUBLE, len(regexp_extract_all(x, '(?i)\b(?:licen[sc]e|token|mail|contact|version)')) * 40.0::DOUBLE / (length(x) + 100)), 6) AS probability, CASE WHEN regexp_matches(x, '(?i)mail|contact') THEN 'contact' ELSE 'legal' END AS label"""


@query("l06_gated_prediction", _WINDOWS + rf""", tried AS (SELECT doc_id, factor, p, own, start, {_P} FROM (SELECT *, cut AS x FROM kept)),
options AS (SELECT doc_id, factor, row_number() OVER (PARTITION BY doc_id ORDER BY p, own, factor, start) AS place, probability, label, probability < 0.05 AS abstained FROM tried
  UNION ALL SELECT doc_id, NULL, 0, probability, label, probability < 0.05 FROM (SELECT doc_id, {_P} FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents))),
best AS (SELECT * FROM options WHERE NOT abstained OR place = 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY abstained, probability DESC, place) = 1),
listed AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{INDEX_ENTRY}')) >= 3 AS toc FROM documents)
SELECT doc_id, CASE WHEN toc THEN 'no_evidence' ELSE label END AS label, CASE WHEN toc THEN 1.0 ELSE probability END AS probability, toc OR abstained AS abstained, CASE WHEN NOT toc THEN factor END AS factor FROM best JOIN listed USING (doc_id)""")
def _(t):
    out = candidates.gated_prediction(t.documents.select("doc_id", "text"), "text", term_lists(t), _predict)
    return out.select("doc_id", "prediction.*")


@query("f23_table_of_contents", rf"""SELECT l_orderkey, len(regexp_extract_all(string_agg(entry, ' ' ORDER BY l_linenumber, entry), '{INDEX_ENTRY}')) >= 3 AS is_index FROM (
  SELECT l_orderkey, l_linenumber, concat('Item ', CAST(l_linenumber AS string), '. ', l_returnflag, ' of ', l_linestatus, ' ', CAST(CAST(floor(l_quantity * l_linenumber * 25) AS int) AS string)) AS entry FROM lineitem) GROUP BY l_orderkey""")
def _(t):
    entry = F.concat(F.lit("Item "), F.col("l_linenumber").cast("string"), F.lit(". "), "l_returnflag", F.lit(" of "), "l_linestatus", F.lit(" "), (F.col("l_quantity") * F.col("l_linenumber") * 25).cast("int").cast("string"))
    texts = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", entry.alias("entry")))).alias("entries"))
    return texts.select("l_orderkey", table_of_contents(F.array_join("entries.entry", " ")).alias("is_index"))
