"""Names against registers of names: by prefix, by equal cores, and by likeness among names that contain each other's words.

Each is an equi-join on something that a match must share, so the work grows with the matches and no name meets all others.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import first_per_key

# Words that may follow a registrant's name without making it another company's.
QUALIFIERS = [
    "inc", "incorporated", "corp", "corporation", "co", "company", "llc", "lp", "llp", "ltd", "limited", "plc", "gmbh", "ag", "sa", "nv", "bv", "spa", "srl", "pty", "pvt", "private", "kk", "as", "ab", "oyj", "oy",
    "usa", "us", "u.s.", "america", "americas", "north", "south", "east", "west", "europe", "european", "asia", "asia-pacific", "apac", "international", "global", "worldwide", "uk", "canada", "india", "japan", "china",
    "australia", "brasil", "brazil", "mexico", "deutschland", "france", "italia", "holdings", "holding", "group", "groupe", "grp", "sub", "subsidiary", "the", "and", "of",
]
# Words that two names of one company may differ by.
GENERIC = ["group", "holdings", "holding", "corporation", "corp", "company", "co", "limited", "ltd", "inc", "plc"]
# Letters of the part that a candidate must contain, the gain for all words in, the loss for each word more.
NEEDLE, ALL_WORDS, WORD_MORE = 20, 0.15, 0.05
LEAST_PREFIX = 4

_LEGAL = r"\b(inc|incorporated|corp|corporation|co|company|ltd|limited|plc|llc|lp|holdings?|group|the)\b"


def register_key(name: Column) -> Column:
    """Lower case, ASCII letters and digits, without legal forms wherever they stand."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9 ]+", " "), _LEGAL, " ")
    return F.btrim(F.regexp_replace(plain, r"\s+", " "))


def by_prefix(names: DataFrame, name: str, register: DataFrame, qualifiers: list[str] | None = None) -> DataFrame:
    """names with `id` of the register (name, id, seq): the equal key, else the first (by seq) whose key begins it.

    A key that begins a longer one has LEAST_PREFIX letters or more, ends with a word, and all words after it are qualifiers.
    A name is looked up by each of its beginnings, so the register is met by equal keys only. Of equal keys of the register
    the last one (by seq) counts, in the place of the first. Nulls and empty keys match nothing.
    """
    known = register.select(register_key(F.col("name")).alias("key"), "id", "seq").where("key <> ''")
    known = known.groupBy("key").agg(F.max_by("id", "seq").alias("id"), F.min("seq").alias("seq"))
    asked = names.select(F.col(name).alias("__name")).distinct().withColumn("__key", register_key(F.col("__name"))).where("__key <> ''")
    words = F.split("__key", " ")
    heads = asked.select("__name", "__key", words.alias("__words"), F.explode(F.sequence(F.lit(1), F.size(words))).alias("__n"))
    heads = heads.withColumn("key", F.array_join(F.slice("__words", F.lit(1), F.col("__n")), " "))
    rest = F.slice("__words", F.col("__n") + 1, F.size("__words"))
    whole = F.col("key") == F.col("__key")
    allowed = whole | ((F.length("key") >= LEAST_PREFIX) & F.forall(rest, lambda w: w.isin(QUALIFIERS if qualifiers is None else qualifiers)))
    found = first_per_key(heads.where(allowed).join(known, "key"), ["__name"], whole.desc(), F.col("seq")).select(F.col("__name").alias(name), "id")
    return names.join(found, name, "left")


def _tokens(name: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: F.length(w) > 2)))


def by_core(names: DataFrame, name: str, index: DataFrame, generic: list[str] | None = None) -> DataFrame:
    """names with `found`: the name of the index (name, n, seq) of largest n, then first by seq, that is the same but for generic words.

    One name's words hold all of the other's, and what is more is generic; so both have the same other words, and those are
    joined on. A name that the index has as it is takes that. Words have three letters or more; a name without any, and
    null, match only themselves or nothing.
    """
    generic = GENERIC if generic is None else generic
    core = lambda words: F.filter(words, lambda w: ~w.isin(generic))
    asked = names.select(F.col(name).alias("__name")).where("__name is not null").distinct().withColumn("__words", _tokens(F.col("__name")))
    listed = index.groupBy(F.lower("name").alias("found")).agg(F.max("n").alias("n"), F.min("seq").alias("seq")).withColumn("words", _tokens(F.col("found")))
    same = asked.withColumn("core", core(F.col("__words"))).where(F.size("__words") > 0).join(listed.withColumn("core", core(F.col("words"))).where(F.size("words") > 0), "core")
    held = (F.size(F.array_except("words", "__words")) == 0) | (F.size(F.array_except("__words", "words")) == 0)
    best = first_per_key(same.where(held), ["__name"], F.desc("n"), F.col("seq")).select("__name", F.col("found").alias("__best"))
    exact = listed.select(F.col("found").alias("__exact"))
    out = asked.select("__name").join(exact, F.lower("__name") == F.col("__exact"), "left").join(best, "__name", "left")
    return names.join(out.select(F.col("__name").alias(name), F.coalesce("__exact", "__best").alias("found")), name, "left")


def _grams(text: Column, size: int) -> Column:
    at = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, names: DataFrame) -> DataFrame:
    """(needle, name) for each name (lower-cased) that contains the needle, both given as their only column.

    A needle looks names up by the rarest of its three-letter pieces (shorter needles by themselves); what is found is tested
    in full. Empty needles and nulls match nothing.
    """
    needles = needles.toDF("needle").where("needle <> ''").distinct()
    names = names.toDF("name").where("name is not null").distinct().withColumn("__low", F.lower("name"))
    own = needles.select("needle", F.explode(F.when(F.length("needle") < 3, F.array("needle")).otherwise(_grams(F.col("needle"), 3))).alias("gram"))
    wanted = own.select("gram").distinct()
    pieces = F.explode(F.array_union(_grams(F.col("__low"), 3), F.array_union(_grams(F.col("__low"), 2), _grams(F.col("__low"), 1)))).alias("gram")
    index = names.select("name", "__low", pieces).join(wanted, "gram")
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    rare = first_per_key(own.join(often, "gram", "left"), ["needle"], F.coalesce("n", F.lit(0)), F.col("gram"))
    return rare.select("needle", "gram").join(index, "gram").where(F.contains("__low", "needle")).select("needle", "name")


@F.pandas_udf(T.DoubleType())
def likeness(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two names, lower-cased and without space at the ends."""
    for a, b in batches:
        pairs = ((x.lower().strip(), y.lower().strip()) for x, y in zip(a, b, strict=True))
        yield pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in pairs])


@F.pandas_udf(T.DoubleType())
def likeness_bound(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """No less than likeness: twice the letters in common, in any order, over all letters."""

    def bound(x: str, y: str) -> float:
        x, y = x.lower().strip(), y.lower().strip()
        return 2 * (Counter(x) & Counter(y)).total() / (len(x) + len(y)) if x or y else 1.0

    for a, b in batches:
        yield pd.Series([bound(x, y) for x, y in zip(a, b, strict=True)])


def word_gain(target: Column, name: Column) -> Column:
    """What words add: ALL_WORDS when the name has all words of the target, else less WORD_MORE for each word it has besides."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.btrim(F.lower(c)), r"\s+"), lambda w: w != ""))
    own, other = words(target), words(name)
    inside = (F.size(own) > 0) & (F.size(F.array_except(own, other)) == 0)
    return F.when(inside, ALL_WORDS).otherwise(-WORD_MORE * F.size(F.array_except(other, own)))


def most_like(targets: DataFrame, names: DataFrame, least: float, by_words: bool = False) -> DataFrame:
    """(target, name, score) of the most like name, if its score is `least` or more (over `least` where words count, too).

    Candidates contain the target's first NEEDLE letters, or, where no name does, its first word. Scores are rounded to 6
    places; of equal ones the first name counts. Pairs whose length or letters can't reach `least` aren't compared in full.
    Nulls are left out, repeated names count once. Each table has one column.
    """
    targets = targets.toDF("target").where("target is not null").distinct()
    names = names.toDF("name")
    head, word = F.lower(F.substring("target", 1, NEEDLE)), F.lower(F.coalesce(F.get(F.filter(F.split("target", r"\s+"), lambda w: w != ""), F.lit(0)), F.col("target")))
    targets = targets.withColumn("head", head).withColumn("word", word)
    first = targets.join(containing(targets.select("head"), names).withColumnRenamed("needle", "head"), "head").select("target", "name")
    others = targets.join(first.select("target").distinct(), "target", "left_anti")
    second = others.join(containing(others.select("word"), names).withColumnRenamed("needle", "word"), "word").select("target", "name")
    pairs = first.unionByName(second)
    gain = word_gain(F.col("target"), F.col("name")) if by_words else F.lit(0.0)
    size = lambda c: F.length(F.btrim(c))
    by_length = 2 * F.least(size("target"), size("name")) / F.greatest(size("target") + size("name"), F.lit(1))
    pairs = pairs.withColumn("gain", gain).where((by_length + F.col("gain") >= least - 1e-6) | (size("target") + size("name") == 0))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(parts, "target", "name")  # a small table of pairs is much work: one task a part
    pairs = pairs.where(likeness_bound("target", "name") + F.col("gain") >= least - 1e-6)
    scored = pairs.select("target", "name", F.round(likeness("target", "name") + F.col("gain"), 6).alias("score"))
    kept = scored.where(F.col("score") > least if by_words else F.col("score") >= least)
    best = kept.groupBy("target").agg(F.min(F.struct((-F.col("score")).alias("less"), "name")).alias("b"))
    return best.select("target", "b.name", (-F.col("b.less")).alias("score"))
