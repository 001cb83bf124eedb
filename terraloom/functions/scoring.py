"""Score arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Trust in how a claim was made; any other way has DEFAULT_TRUST.
METHOD_TRUST = {"dataset_lookup": 1.0, "extracted": 0.9, "peer_ratio_fallback": 0.7, "coarse_bucket": 0.5, "peer_anchor": 1.0}
DEFAULT_TRUST = 0.9
# Points that full evidence moves a pillar up and down.
AMPLITUDE = {"E": (40.0, 40.0), "S": (200.0, 200.0), "G": (40.0, 160.0)}
COVERAGE_FLOOR, MASS_GATE, CENTRE, BASELINE_SHARE = 0.6, 2.5, 50.0, 0.02
# Weights of the two votes of a pillar, and the second one's confidence.
VOTE_WEIGHTS = {"E": (0.7, 0.3), "S": (0.1, 0.9), "G": (0.7, 0.3)}
HOLISTIC_CONFIDENCE, LEAST_HALF, MOST_HALF = 0.5, 1.0, 5.0
# The factors of votes that aren't claims, and the weights they have by pillar.
PEER_ANCHOR, INDUSTRY_VOTE = "_peer_anchor", "_industry_median"
ANCHOR_WEIGHT, INDUSTRY_WEIGHTS = 10.0, {"E": 10.0, "S": 6.0, "G": 6.0}


def by_key(key: Column, values: dict, default) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def trust(method: Column) -> Column:
    return by_key(method, METHOD_TRUST, DEFAULT_TRUST)


def band_delta(value: Column, full: Column, none: Column) -> Column:
    """-1 to 1 by where a value stands between what earns 0 and what earns 100."""
    return 2 * clamp((value - none) / (full - none), 0.0, 1.0) - 1


def band_score(value: Column, full: Column, none: Column) -> Column:
    """0 to 100; 50 for a band without width."""
    return F.when(full == none, 50.0).otherwise(100 * clamp((value - none) / (full - none), 0.0, 1.0))


def evidence_term(pillar: Column, delta: Column, coverage: Column) -> Column:
    up = by_key(pillar, {k: v[0] for k, v in AMPLITUDE.items()}, 40.0)
    down = by_key(pillar, {k: v[1] for k, v in AMPLITUDE.items()}, 40.0)
    return F.when(delta < 0, down).otherwise(up) * F.tanh(delta) * (COVERAGE_FLOOR + (1 - COVERAGE_FLOOR) * coverage)


def tiebroken(term: Column, baseline: Column) -> Column:
    """50 plus the evidence; only without any does a small share of the baseline count."""
    return clamp(F.when(term != 0, CENTRE + term).otherwise(CENTRE + BASELINE_SHARE * (baseline - CENTRE)), 0.0, 100.0)


def blended(term: Column, mass: Column, prior: Column, k: float = 2.5, points: float = 15.0) -> Column:
    """Evidence and prior weighed by the mass of evidence; without a prior the evidence alone."""
    w = F.when(prior.isNull(), 1.0).otherwise(mass / (mass + k))
    return clamp(CENTRE + w * term + (1 - w) * F.when(prior.isNull(), 0.0).otherwise(points * (prior - 50) / 50), 0.0, 100.0)


def overlay(severity: Column) -> Column:
    """Points that confirmed negative events take off."""
    return F.when(severity > 0, -20.0 * F.tanh(1.2 * severity / 20)).otherwise(0.0)


def confidence_label(n: Column, spread: Column) -> Column:
    return F.when((n == 1) | (spread > 25) | (n == 0), "low").when((n == 2) & (spread <= 10), "high").otherwise("medium")


def half_width(spread: Column) -> Column:
    return F.when(spread.isNull(), MOST_HALF).otherwise(clamp(spread / 2 + LEAST_HALF, LEAST_HALF, MOST_HALF))


def rating_band(score: Column) -> Column:
    return F.when(score >= 75, "leader").when(score >= 50, "average").when(score >= 25, "laggard").when(score.isNotNull(), "poor")


def mean_of(*columns: Column) -> Column:
    """Mean of the columns that aren't null; null if all are."""
    given = F.array_compact(F.array(*columns))
    return F.when(F.size(given) > 0, F.aggregate(given, F.lit(0.0), lambda a, x: a + x) / F.size(given))


def net_of(gains: list[Column], losses: list[Column]) -> Column:
    """Gains less losses, null if every part is null."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.when(F.coalesce(*gains, *losses).isNotNull(), sum(map(zero, gains)) - sum(map(zero, losses)))
