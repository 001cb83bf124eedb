"""Articles that name a company so that they can be about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from .ranking import first_per_key

# Words too common in such prose to name a company, names that are words, words that show a company is meant.
GENERIC = [
    "green", "clean", "climate", "carbon", "energy", "solar", "wind", "water", "earth", "eco", "environment", "environmental", "sustainable", "sustainability", "impact", "future", "better", "world", "worlds", "global", "planet",
    "nature", "natural", "organic", "renewable", "power", "resource", "resources", "chemicals", "materials", "development", "bank", "media", "business", "community", "health", "food", "farm", "forest", "tank", "halo", "map",
    "match", "capital", "partners", "ventures", "industries", "products", "brands", "works", "labs", "studio", "digital",
]
AMBIGUOUS = ["amazon", "shell", "total", "orange", "delta", "gap", "apple", "target", "sun", "eagle", "jaguar", "puma", "columbia", "everest", "alpine"]
CONTEXT = ["inc", "corp", "company", "ceo", "shareholder", "earnings", "revenue", "retailer", "supplier", "employees", "workers", "brand", "store", "warehouse", "logistics", "e-commerce", "cloud", "aws", "plc", "group"]
LEAST_LETTERS, CONTEXT_LETTERS = 6, 400

_WORD = r"[\p{L}\p{N}_]"


def distinctive(name: Column) -> Column:
    """Identifying words of a company's name that aren't generic."""
    return F.filter(N.identifying_tokens(name), lambda w: ~w.isin(GENERIC))


def _place(text: Column, word: Column) -> Column:
    """Place (from 0) of the first whole word; null without one. The word is of letters and digits."""
    at = F.regexp_instr(text, F.concat(F.lit(f"(?<!{_WORD})"), word, F.lit(f"(?!{_WORD})")))
    return F.when(at > 0, at - 1)


def mentioned_at(text: Column, name: Column, words: Column) -> Column:
    """Where a text first names a company by one of its distinctive words, all of which it must have; else null.

    Words count capitalised, or else in capitals. They need LEAST_LETTERS letters in all, but for a name in capitals.
    """
    acronym = (F.upper(name) == name) & (F.lower(name) != name) & (F.length(F.replace(name, F.lit(" "), F.lit(""))) >= 3)
    letters = F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))
    places = F.transform(words, lambda w: F.coalesce(_place(text, F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), _place(text, F.upper(w))))
    whole = (F.size(words) > 0) & (acronym | (letters >= LEAST_LETTERS)) & ~F.exists(places, lambda p: p.isNull())
    return F.when(whole, F.array_min(places))


def in_context(title: Column, body: Column, words: Column) -> Column:
    """False for names that are words, unless the title or the body's beginning speaks of a company."""
    said = F.lower(F.concat(title, F.lit(" "), F.substring(body, 1, CONTEXT_LETTERS)))
    ambiguous = (F.size(words) == 1) & words[0].isin(AMBIGUOUS)
    return ~F.coalesce(ambiguous, F.lit(False)) | said.rlike(rf"(?<!{_WORD})(?:{'|'.join(CONTEXT)})(?!{_WORD})")


def press_mentions(articles: DataFrame, companies: DataFrame, key: str = "article") -> DataFrame:
    """(article, company, at, in_title): articles (key, title, body) that name companies (company, name), and whether in the headline.

    `at` is the first place in the body, null where only the headline names it. A company's rarest distinctive word finds
    the articles to test, so no company meets all of them. Companies without distinctive words and null texts match nothing.
    """
    title, body = F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))
    told = articles.select(F.col(key), title.alias("title"), body.alias("body"))
    words = F.array_distinct(F.filter(F.split(F.lower(F.concat("title", F.lit(" "), "body")), r"[^a-z0-9]+"), lambda w: w != ""))
    index = told.select(key, F.explode(words).alias("word"))
    asked = companies.where("name is not null").select("company", "name", distinctive(F.col("name")).alias("words"))
    sets = asked.select(F.array_sort(F.array_distinct("words")).alias("set")).distinct().select("set", F.explode("set").alias("word"))
    wanted = index.join(sets.select("word").distinct(), "word")
    often = wanted.groupBy("word").agg(F.count("*").alias("n"))
    rare = first_per_key(sets.join(often, "word", "left"), ["set"], F.coalesce("n", F.lit(0)), F.col("word")).select("set", "word")
    hits = asked.withColumn("set", F.array_sort(F.array_distinct("words"))).join(rare, "set").join(wanted, "word").join(told, key)
    at, head = mentioned_at(F.col("body"), F.col("name"), F.col("words")), mentioned_at(F.col("title"), F.col("name"), F.col("words"))
    found = hits.select(key, "company", at.alias("at"), (head.isNotNull() & in_context(F.col("title"), F.col("body"), F.col("words"))).alias("in_title"))
    return found.where(F.col("at").isNotNull() | F.col("in_title"))
