"""The calibration report in full."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import calibration
from ..operators import claims as C
from .base import query
from .scores import _VOTES, r6

# Three neighbouring keys are the pillars of one company.
_ROWS = _VOTES + """, scored AS (SELECT concat('g', CAST(floor(CAST(substr(r.company, 2) AS bigint) / 3) AS bigint)) AS company, r.pillar, r.score AS predicted, truth, spread, label, r.n_claims, CASE WHEN label = 'low' OR r.mass < 2.5 OR r.n_claims = 0 THEN 'range' ELSE 'point' END AS mode,
  greatest(0, score - half) AS low, least(100, score + half) AS high, CASE WHEN label <> 'medium' THEN 'skipped' WHEN r.n_claims % 2 = 0 THEN 'passed' END AS verdict FROM r JOIN predictions p ON p.company = r.company),
rows AS (SELECT * FROM scored UNION ALL BY NAME SELECT company, 'Total' AS pillar, max(predicted) FILTER (pillar = 'E') * 0.40::DOUBLE + max(predicted) FILTER (pillar = 'S') * 0.35::DOUBLE + max(predicted) FILTER (pillar = 'G') * 0.25::DOUBLE AS predicted, avg(truth) AS truth, sum(n_claims) AS n_claims FROM scored GROUP BY company),
cut AS (SELECT *, unnest(list_filter(['overall', CASE WHEN n_claims > 0 THEN 'evidence_only' END, concat_ws('', CASE WHEN mode IS NOT NULL THEN 'gated_' END, mode), concat_ws('', CASE WHEN label IS NOT NULL THEN 'confidence_' END, label), CASE WHEN verdict IS NOT NULL THEN CASE WHEN mode = 'range' THEN 'verify_flagged' ELSE 'verify_unflagged' END END,
  CASE WHEN spread IS NOT NULL THEN 'spread' END, CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN 'coverage' END], lambda x: x IS NOT NULL AND x <> '')) AS slice FROM rows),
paired AS (SELECT *, abs(predicted - truth) AS err, rank() OVER (PARTITION BY slice, pillar ORDER BY predicted) + (count(*) OVER (PARTITION BY slice, pillar, predicted) - 1) / 2 AS a, rank() OVER (PARTITION BY slice, pillar ORDER BY truth) + (count(*) OVER (PARTITION BY slice, pillar, truth) - 1) / 2 AS b,
  count(*) OVER (PARTITION BY slice, pillar) AS m FROM cut WHERE predicted IS NOT NULL AND truth IS NOT NULL),
gaps AS (SELECT *, abs(a - b) AS gap FROM paired),
told AS (SELECT slice, pillar, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(a, b) END AS spearman, avg(gap / m) AS pct_error, CASE WHEN count(*) >= 3 THEN avg(err) END AS mean_error, CASE WHEN count(*) >= 3 THEN median(err) END AS median_error, CASE WHEN count(*) >= 3 THEN avg(gap) END AS mean_rank_error,
  avg(spread) FILTER (slice = 'spread') AS mean_spread, median(spread) FILTER (slice = 'spread') AS median_spread, avg((truth BETWEEN low AND high)::INT) FILTER (slice = 'coverage') AS coverage, avg(high - low) FILTER (slice = 'coverage') AS mean_width, median(high - low) FILTER (slice = 'coverage') AS median_width FROM gaps GROUP BY slice, pillar),
spreads AS (SELECT slice, pillar, CASE WHEN count(*) >= 3 THEN corr(s, g) END AS spread_to_error FROM (SELECT slice, pillar, rank() OVER (PARTITION BY pillar ORDER BY spread) + (count(*) OVER (PARTITION BY pillar, spread) - 1) / 2 AS s, rank() OVER (PARTITION BY pillar ORDER BY gap) + (count(*) OVER (PARTITION BY pillar, gap) - 1) / 2 AS g FROM gaps WHERE slice = 'spread') GROUP BY slice, pillar),
report AS (SELECT * EXCLUDE (n), coalesce(n, 0) AS n FROM (SELECT slice, pillar, count(*) AS n_rows FROM cut GROUP BY ALL) LEFT JOIN told USING (slice, pillar) LEFT JOIN spreads USING (slice, pillar))"""

_MEASURES = ["spearman", "pct_error", "mean_error", "median_error", "mean_rank_error", "mean_spread", "median_spread", "spread_to_error", "coverage", "mean_width", "median_width"]


def _report(t):
    key = F.expr("CAST(substr(company, 2) AS bigint)")
    rows = C.gated(C.reconciled(t.predictions.withColumnRenamed("predicted", "formula")).withColumn("gate_fired", F.col("mass") < scoring.MASS_GATE))
    verdict = F.when(F.col("label") != "medium", "skipped").when(F.col("n_claims") % 2 == 0, "passed")
    rows = rows.select(F.concat(F.lit("g"), F.floor(key / 3).cast("string")).alias("company"), "pillar", F.col("score").alias("predicted"), "truth", "spread", "label", "n_claims", "mode", "low", "high", verdict.alias("verdict"))
    return calibration.report(calibration.with_totals(rows))


@query("a36_full_report", _ROWS + " SELECT slice, pillar, n_rows, n, " + ", ".join(f"round({m}, 6) AS {m}" for m in _MEASURES) + " FROM report")
def _(t):
    return _report(t).select("slice", "pillar", "n_rows", "n", *(r6(m).alias(m) for m in _MEASURES))


@query("a36_monotonic_errors", _ROWS + """ SELECT pillar, CASE WHEN (h IS NOT NULL)::INT + (m IS NOT NULL)::INT + (l IS NOT NULL)::INT >= 2 THEN coalesce(h <= m, true) AND coalesce(m <= l, true) AND coalesce(h <= l, true) END AS monotonic
  FROM (SELECT pillar, max(mean_error) FILTER (slice = 'confidence_high') AS h, max(mean_error) FILTER (slice = 'confidence_medium') AS m, max(mean_error) FILTER (slice = 'confidence_low') AS l FROM report GROUP BY pillar)""")
def _(t):
    return calibration.rises(_report(t))
