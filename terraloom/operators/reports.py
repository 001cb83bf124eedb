"""What a long report says for a pillar: its best blocks under a budget, and how well they cover it.

A report is one row, and its blocks are an array of it: nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_navigation, occurrences

# Letters of a block, of a selection and the part of it that is enough; hits in 1000 letters that count and that are strong; markers that veto a block and a selection; numbers with a unit.
BLOCK, BUDGET, ENOUGH = 1200, 3500, 0.9
LEAST_DENSITY, STRONG_DENSITY, LEAST_SELECTION = 1.2, 5.0, 200
BLOCK_VETO, SELECTION_VETO = 1, 2
UNIT_NUMBER = r"(?i)\b[0-9][0-9,]*(?:\.[0-9]+)?\s?(?:%|tco2e?|co2e?|kg|tonnes?|tons?|mwh|kwh|gwh|gj|tj|m3|litres?|liters?|million|billion|mn|bn|employees|hours|days|years)\b|\b[0-9]+\.[0-9]+\b|\b[0-9][0-9,]*\s?%"


@dataclass(frozen=True)
class ReportTerms:
    """Terms of each pillar, and markers of financial statements; lower case, found inside words too."""

    pillars: dict[str, list[str]]
    financial: list[str]


def _counted(low: Column, terms: list[str]) -> Column:
    return sum((occurrences(low, t) for t in terms), F.lit(0))


def hits(text: Column, terms: list[str]) -> Column:
    """Occurrences of all terms, in any case."""
    return _counted(F.lower(text), terms)


def blocks(text: Column, page_mark: str | None = None, size: int = BLOCK) -> Column:
    """Pages, or paragraphs where the mark of a page doesn't occur; those over twice the size are cut into pieces of it. Blank ones go."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    units = F.split(text, r"\n\s*\n")
    if page_mark:
        units = F.when(F.contains(text, F.lit(page_mark)), F.split(text, r"\Q" + page_mark + r"\E")).otherwise(units)
    units = F.filter(F.transform(units, trim), lambda u: u != "")
    pieces = lambda u: F.transform(F.sequence(F.lit(0), F.floor((F.length(u) - 1) / size).cast("int")), lambda i: F.substr(u, i * size + 1, F.lit(size)))
    cut = F.flatten(F.transform(units, lambda u: F.when(F.length(u) <= 2 * size, F.array(u)).otherwise(pieces(u))))
    return F.filter(cut, lambda b: b.rlike(r"\S"))


def fit_blocks(parts: Column, financial: list[str]) -> Column:
    """i, n, b, low and weight of the blocks that may be chosen: contents pages and financial statements aren't. Numbers with units weigh."""
    weight = lambda b: 1.0 + 2.0 * (F.regexp_count(b, F.lit(UNIT_NUMBER)) / F.greatest(F.lit(1.0), F.length(b) / 400.0))
    all_ = F.transform(parts, lambda b, i: F.struct(i.alias("i"), F.length(b).alias("n"), b.alias("b"), F.lower(b).alias("low")))
    fit = F.filter(all_, lambda x: (_counted(x["low"], financial) < BLOCK_VETO) & ~is_navigation(x["b"]))
    return F.transform(fit, lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n"), x["b"].alias("b"), x["low"].alias("low"), weight(x["b"]).alias("weight")))


def selected(fit: Column, terms: list[str], budget: int = BUDGET) -> Column:
    """The best of fit_blocks that fit the budget, in the report's order, joined by empty lines; a block that doesn't fit is passed over."""
    scored = F.transform(fit, lambda x: F.struct((-F.round(_counted(x["low"], terms) * x["weight"], 9)).alias("less"), x["i"].alias("i"), x["n"].alias("n"), x["b"].alias("b")))
    ordered = F.array_sort(F.filter(scored, lambda s: s["less"] < 0))
    none = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<i: int, b: string>>").alias("taken"))

    def step(acc, s):
        fits = (acc["used"] < ENOUGH * budget) & (acc["used"] + s["n"] <= budget)
        return F.struct((acc["used"] + F.when(fits, s["n"]).otherwise(0)).alias("used"), F.when(fits, F.array_append(acc["taken"], F.struct(s["i"].alias("i"), s["b"].alias("b")))).otherwise(acc["taken"]).alias("taken"))

    taken = F.array_sort(F.aggregate(ordered, none, step)["taken"])
    return F.substring(F.array_join(F.transform(taken, lambda x: x["b"]), "\n\n"), 1, budget)


def coverage(reports: DataFrame, keys: list[str], text: str, terms: ReportTerms, page_mark: str | None = None) -> DataFrame:
    """keys, pillar, selection, density, financial_hits, verdict: strong, weak or none by pillar.

    A selection of LEAST_SELECTION letters or less, or with too few terms, is none; a dense one without financial markers is
    strong. Null and empty reports are none.
    """
    rows = reports.select(*keys, fit_blocks(blocks(F.coalesce(F.col(text), F.lit("")), page_mark), terms.financial).alias("__fit"))
    each = [F.struct(F.lit(p).alias("pillar"), selected(F.col("__fit"), own).alias("selection")) for p, own in terms.pillars.items()]
    rows = rows.select(*keys, F.inline(F.array(*each)))
    found = None
    for p, own in terms.pillars.items():
        found = F.when(F.col("pillar") == p, hits(F.col("selection"), own)) if found is None else found.when(F.col("pillar") == p, hits(F.col("selection"), own))
    long_enough = F.length("selection") > LEAST_SELECTION
    density = F.when(long_enough, 1000.0 * found / F.greatest(F.lit(1), F.length("selection"))).otherwise(0.0)
    rows = rows.withColumn("density", density).withColumn("financial_hits", F.when(long_enough, hits(F.col("selection"), terms.financial)).otherwise(0))
    strong = (F.col("density") >= STRONG_DENSITY) & (F.col("financial_hits") < SELECTION_VETO)
    return rows.withColumn("verdict", F.when(~long_enough | (F.col("density") < LEAST_DENSITY), "none").when(strong, "strong").otherwise("weak"))
