"""Countries: the first one a text names, and codes of written country names.

Dimension tables (names, codes, aliases) are collected; MOST_NAMES bounds what goes into an expression, and a longer list of
names is searched by an automaton instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .candidates import folded

#: Names in one regular expression, and rows of a dimension in one expression.
MOST_NAMES = 5_000
# Fixed value: most words of a name that is looked for inside other names.
MOST_WORDS = 5


def first_named(text: Column, names: list[str], most: int = MOST_NAMES) -> Column:
    """The name that stands first in the text, in any case and inside words too; of names that start at one place the longest.

    It is given as the list has it (of names that differ in case only, the first of the longest-first order). Null without one.
    """
    known = {}
    for name in sorted(filter(None, names), key=len, reverse=True):
        known.setdefault(name.lower(), name)
    if not known:
        return F.lit(None).cast("string")
    if len(known) > most:
        return _by_automaton(text, known)
    pattern = "(?iu)" + "|".join(re.escape(n) for n in known.values())
    found = F.regexp_extract(text, pattern, 0)
    as_listed = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.when(found != "", F.coalesce(F.element_at(as_listed, F.lower(found)), found))


def _by_automaton(text: Column, known: dict[str, str]) -> Column:
    @F.pandas_udf("string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for low, name in known.items():
            automaton.add_word(folded(name), (len(name), known[low]))
        automaton.make_automaton()

        def first(t: str | None) -> str | None:
            best = None
            for last, (size, name) in automaton.iter(folded(t or "")):
                place = (last + 1 - size, -size)
                if best is None or place < best[0]:
                    best = place, name
            return best and best[1]

        for texts in batches:
            yield texts.map(first)

    return find(text)


def cleaned(raw: Column) -> Column:
    """Lower case, single spaces, without stars, dots and punctuation at the ends."""
    spaced = F.regexp_replace(F.btrim(F.btrim(F.btrim(raw, F.lit(" \t\n\r")), F.lit("*")), F.lit(" \t\n\r")), r"\s+", " ")
    return F.btrim(F.replace(F.btrim(F.lower(spaced), F.lit(" .,;:-")), F.lit("."), F.lit("")))


def resolved(raws: DataFrame, raw: str, codes: DataFrame, aliases: DataFrame, parts: DataFrame, rejected: list[str], fuzzy: bool = True) -> DataFrame:
    """raws with `iso3`, or null where a text is no country: (code, name) of codes, (alias, code) of aliases, (part, code) of parts.

    In this order: rejected words give none; alias; code or name; both again without a bracket or a qualifier at the end.
    Then only texts that don't begin with a digit, of five words at most and without a rejected word go on: parts of a
    country, and at last a text that stands inside the names of just one country. Each text is resolved once, however many
    rows have it. Names of two codes count as neither. Null and empty texts give null.
    """
    one = lambda df, key, code: df.select(F.lower(key).alias("k"), F.col(code).alias("c")).where("k is not null").groupBy("k").agg(F.when(F.count_distinct("c") == 1, F.min("c")).alias("c"))
    names = one(codes.select("code", F.explode(F.array("code", "name")).alias("name")), "name", "code")
    listed = codes.select(F.lower("name").alias("name"), "code").distinct().limit(MOST_NAMES + 1).collect() if fuzzy else []
    if len(listed) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} country names")
    texts = raws.select(F.col(raw).alias("raw")).distinct().withColumn("key", cleaned(F.col("raw")))
    base = F.btrim(F.regexp_replace(F.btrim(F.regexp_replace("key", r"\s*\([^)]*\)\s*$", "")), r",\s*(fed rep|fed sts|the)$", ""))
    texts = texts.withColumn("base", F.when((base != "") & (base != F.col("key")), base))
    for column, (table, key) in {"alias": (one(aliases, "alias", "code"), "key"), "exact": (names, "key"), "base_alias": (one(aliases, "alias", "code"), "base"), "base_exact": (names, "base"), "part": (one(parts, "part", "code"), "key")}.items():
        texts = texts.join(table.withColumnsRenamed({"k": key, "c": column}), key, "left")
    words = F.split("key", " ")
    bad = F.array(*map(F.lit, rejected)).cast("array<string>")
    open_ = ~F.col("raw").rlike(r"^\s*[0-9]") & (F.size(words) <= MOST_WORDS) & ~F.arrays_overlap(words, bad)
    steps = ["alias", "exact", "base_alias", "base_exact"]
    found = F.coalesce(*steps)
    if fuzzy:
        inside = F.lit(None).cast("string")
        if listed:
            known = F.array(*(F.struct(F.lit(r["name"]).alias("name"), F.lit(r["code"]).alias("code")) for r in listed))
            hits = F.array_distinct(F.transform(F.filter(known, lambda x: F.contains(x["name"], F.col("key"))), lambda x: x["code"]))
            inside = F.when(F.size(hits) == 1, hits[0])
        found = F.coalesce(found, F.when(open_, F.coalesce("part", inside)))
    texts = texts.select("raw", F.when((F.col("key") != "") & ~F.array_contains(bad, F.col("key")), found).alias("iso3"))
    return raws.join(texts.withColumnRenamed("raw", raw), raw, "left")
