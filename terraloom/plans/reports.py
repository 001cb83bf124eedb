"""What long texts say for each pillar."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from .base import query
from .scores import r6

TERMS = reports.ReportTerms({"E": ["license", "tion", "the "], "S": ["token", "les ", "que "], "G": ["mail", "und ", "der "]}, ["secret", "password", "version"])


def _hits(x: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"(length(lower({x})) - length(replace(lower({x}), '{w}', ''))) // {len(w)}" for w in terms) + ")"


def _by_pillar(x: str) -> str:
    return "CASE pillar " + " ".join(f"WHEN '{p}' THEN {_hits(x, w)}" for p, w in TERMS.pillars.items()) + " END"


_LINES = r"list_filter(list_transform(string_split_regex(b, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"

C25_SQL = rf"""WITH RECURSIVE units AS (SELECT doc_id, generate_subscripts(u, 1) AS k, unnest(u) AS u FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS u FROM documents)),
pieces AS (SELECT doc_id, k, j, CASE WHEN length(u) <= 2400 THEN u ELSE substr(u, j * 1200 + 1, 1200) END AS b FROM (SELECT *, unnest(CASE WHEN length(u) <= 2400 THEN [0] ELSE range(0, (length(u) - 1) // 1200 + 1) END) AS j FROM units)),
blocks AS (SELECT doc_id, b, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS i FROM pieces WHERE regexp_matches(b, '\S')),
lined AS (SELECT *, {_LINES} AS lines FROM blocks),
fit AS (SELECT doc_id, i, b FROM lined WHERE NOT (len(lines) >= 6 AND len(list_filter(lines, lambda x: regexp_matches(x, '\s[0-9]{{1,3}}$'))) >= greatest(4.0, len(lines) * 0.3) AND len(list_filter(lines, lambda x: length(x) < 60)) >= len(lines) * 0.7) AND {_hits("b", TERMS.financial)} < 1),
scored AS (SELECT doc_id, pillar, i, b, round({_by_pillar("b")} * (1.0::DOUBLE + 2.0::DOUBLE * (len(regexp_extract_all(b, '{reports.UNIT_NUMBER}')) / greatest(1.0::DOUBLE, length(b) / 400.0::DOUBLE))), 9) AS score FROM fit, (VALUES ('E'), ('S'), ('G')) p(pillar)),
ordered AS MATERIALIZED (SELECT *, length(b) AS n, row_number() OVER (PARTITION BY doc_id, pillar ORDER BY score DESC, i) AS nth FROM scored WHERE score > 0),
folded AS (SELECT doc_id, pillar, i, b, nth, n <= 3500 AS taken, CASE WHEN n <= 3500 THEN n ELSE 0 END AS used FROM ordered WHERE nth = 1
  UNION ALL SELECT o.doc_id, o.pillar, o.i, o.b, o.nth, used < 3150 AND used + o.n <= 3500, used + CASE WHEN used < 3150 AND used + o.n <= 3500 THEN o.n ELSE 0 END FROM folded f JOIN ordered o ON o.doc_id = f.doc_id AND o.pillar = f.pillar AND o.nth = f.nth + 1),
selections AS (SELECT doc_id, pillar, substr(string_agg(b, chr(10) || chr(10) ORDER BY i), 1, 3500) AS s FROM folded WHERE taken GROUP BY doc_id, pillar),
dense AS (SELECT doc_id, pillar, coalesce(s, '') AS s FROM (SELECT doc_id, unnest(['E', 'S', 'G']) AS pillar FROM documents) LEFT JOIN selections USING (doc_id, pillar)),
rated AS (SELECT *, CASE WHEN length(s) > 200 THEN 1000.0::DOUBLE * {_by_pillar("s")} / greatest(1, length(s)) ELSE 0 END AS density, CASE WHEN length(s) > 200 THEN {_hits("s", TERMS.financial)} ELSE 0 END AS f FROM dense)
SELECT doc_id, pillar, md5(s) AS selection_md5, round(density, 6) AS density, f::INT AS financial_hits, CASE WHEN length(s) <= 200 OR density < 1.2 THEN 'none' WHEN density >= 5 AND f < 2 THEN 'strong' ELSE 'weak' END AS verdict FROM rated"""


@query("c25_report_coverage", C25_SQL)
def _(t):
    out = reports.coverage(t.documents, ["doc_id"], "text", TERMS)
    return out.select("doc_id", "pillar", F.md5(F.col("selection").cast("binary")).alias("selection_md5"), r6("density").alias("density"), "financial_hits", "verdict")
