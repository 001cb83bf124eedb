"""The rules that claims pass before they count, in their order, with what each rule did."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .candidates import TermFinder

# Ways of claiming that aren't held against a text; bounds of confidence, text length and what rules take off.
NO_TEXT_NEEDED = ["dataset_lookup", "peer_ratio_fallback"]
HIGH_CONFIDENCE, SHORT_TEXT, SHORT_CAP, TOTAL_CAP = 0.7, 200, 0.5, 0.3
WRONG_SIGN, ONE_SOURCE = 0.5, 0.7


@dataclass(frozen=True)
class FactorRules:
    """Which factors a rule holds for: percentages, those that can't exceed the country's total, those that are never good news, those that need two sources."""

    percentages: list[str] = field(default_factory=list)
    totalled: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    corroborated: list[str] = field(default_factory=list)


def lists_present(text: Column, lists: dict[str, list[str]]) -> Column:
    """Names of the lists of which some term stands in the text, as whole words in any case; null text has null."""
    names = list(lists)

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = TermFinder([lists[n] for n in names])
        for texts in batches:
            yield texts.map(lambda t: None if t is None else [names[i] for i in sorted({h[0] for h in finder.hits(t)})])

    return find(text)


def source_family(tag: Column) -> Column:
    """The parts of one report are one source."""
    return F.when(tag.startswith("report_pdf"), "report_pdf").otherwise(tag)


def joined_where(rows: DataFrame, holds: Column, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows joined with `other` (unique in `on`) where `holds`; elsewhere, and where it has no match, other's columns are null.

    Only rows for which it holds are shuffled. `rows` is read once for these and once for the rest.
    """
    holds = F.coalesce(holds, F.lit(False))
    return rows.where(holds).join(other, on, "left").unionByName(rows.where(~holds), allowMissingColumns=True)


def validate(claims: DataFrame, rules: FactorRules, listed: list[str]) -> DataFrame:
    """Claims that pass, with `flags`: the rules that changed them, in order. Each rule sees what the ones before it left.

    Beside a claim's own columns it needs text_length and present (of its cited text; null where there is none) and
    country_total. 1. lexical_relevance drops a claim whose text has no term of its factor's list (of its pillar's, for a
    factor without one in `listed`). 2. numeric_bounds empties values that are negative, not finite or percentages over
    100, and caps confidence where a value exceeds the country's total. 3. polarity_consistency halves good news of a factor
    that has none. 4. known_failure_shape caps sure claims on short texts. 5. corroboration cuts bad news of a company and
    factor that all comes from one source. An empty text is no text to the first rule, and a short one to the fourth.
    """
    exempt = F.coalesce(F.col("method").isin(NO_TEXT_NEEDED), F.lit(False))
    own = F.when(F.col("factor").isin(listed), F.col("factor")).when(F.col("pillar").isin(listed), F.col("pillar"))
    off = ~exempt & (F.col("text_length") > 0) & own.isNotNull() & ~F.array_contains("present", own)
    out = claims.where(~F.coalesce(off, F.lit(False)))

    value = F.col("value")
    unfit = F.isnan(value) | (F.abs(value) == float("inf")) | (value < 0) | (F.col("factor").isin(rules.percentages) & (value > 100))
    over = F.col("factor").isin(rules.totalled) & (value > F.col("country_total"))
    steps = [
        ("numeric_bounds", F.coalesce(unfit | over, F.lit(False)), F.when(F.coalesce(over & ~unfit, F.lit(False)), F.least(F.col("confidence"), F.lit(TOTAL_CAP))).otherwise(F.col("confidence"))),
        ("polarity_consistency", F.coalesce(F.col("factor").isin(rules.negative) & (F.col("polarity") == 1), F.lit(False)), F.col("confidence") * WRONG_SIGN),
        ("known_failure_shape", F.coalesce(~exempt & (F.col("confidence") > HIGH_CONFIDENCE) & (F.col("text_length") < SHORT_TEXT), F.lit(False)), F.least(F.col("confidence"), F.lit(SHORT_CAP))),
    ]
    out = out.withColumn("flags", F.array().cast("array<string>"))
    for name, hit, confidence in steps:
        out = out.withColumn("__hit", hit).withColumn("confidence", F.when(F.col("__hit"), confidence).otherwise(F.col("confidence")))
        if name == "numeric_bounds":
            out = out.withColumn("value", F.when(~F.coalesce(unfit, F.lit(False)), value))
        out = out.withColumn("flags", F.when(F.col("__hit"), F.array_append("flags", F.lit(name))).otherwise(F.col("flags")))
    bad = F.col("factor").isin(rules.corroborated) & (F.col("polarity") == -1)
    family = source_family(F.coalesce("source_tag", F.lit("")))
    alone = out.where(bad).groupBy("company", "factor").agg((F.min(family) == F.max(family)).alias("__alone"))
    out = joined_where(out, bad, alone, ["company", "factor"]).withColumn("__hit", F.coalesce("__alone", F.lit(False)))
    out = out.withColumn("confidence", F.when(F.col("__hit"), F.col("confidence") * ONE_SOURCE).otherwise(F.col("confidence")))
    return out.withColumn("flags", F.when(F.col("__hit"), F.array_append("flags", F.lit("corroboration"))).otherwise(F.col("flags"))).drop("__hit", "__alone")
