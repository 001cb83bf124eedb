"""Public records matched to companies by rules: which rows, whose names, how recent, what is told, and how much of it.

A rule is data. Rules over one table are compiled into one array of columns, so a table is scanned once for all of them, and
all records then meet the companies in one join by rare words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.text import is_recent
from ..session import checkpointed
from .ranking import first_per_key
from .registers import containing

# Characters told of a company by a source, and of a company's name looked for inside names of records.
MOST_CHARS, NEEDLE = 2200, 40
SEPARATOR, JOINER = " | ", "; "


@dataclass(frozen=True)
class RecordRule:
    """One source of records.

    `names` are SQL expressions of which one must match; `match` is strict (all identifying words, enough letters), neutral
    (all identifying words) or substring (the company's name stands in the record's). `where` keeps rows, `dated` and `since`
    keep those that name a recent year in `dated` or none. `told` are SQL expressions of what is said, joined by "; " where
    they aren't empty, in the order of `order` (unique in the table). `distinct` drops what has been said, `cap` is the most
    records told. `head` and `link` stand around the text.
    """

    tag: str
    table: str
    names: tuple[str, ...]
    match: str
    told: tuple[str, ...]
    order: str
    where: str = "true"
    dated: str | None = None
    since: int = 0
    distinct: bool = False
    cap: int | None = None
    head: str = ""
    link: str = ""
    polarity: str = "negative"


def compiled(rules: list[RecordRule], tables: dict[str, DataFrame], told_of: bool = True) -> DataFrame:
    """tag, match, names (some may be null or equal), body, seq of the records that rules keep: one scan of each table.

    Without `told_of`, match and names alone, of records that tell nothing, too. All this is done for every row, so it has
    no functions over arrays, which Spark doesn't compile.
    """
    parts = []
    for table in dict.fromkeys(r.table for r in rules):
        rows = []
        for r in (r for r in rules if r.table == table):
            told = F.concat_ws(JOINER, *(F.nullif(F.btrim(F.expr(c).cast("string")), F.lit("")) for c in r.told))
            named = F.array(*(F.expr(c).cast("string") for c in r.names))
            more = [F.lit(r.tag).alias("tag"), told.alias("body"), F.expr(r.order).cast("long").alias("seq")] if told_of else []
            record = F.struct(F.lit(r.match).alias("match"), named.alias("names"), *more)
            if r.dated:  # inside, as years are then looked for in kept rows only
                record = F.when(is_recent(F.coalesce(F.expr(r.dated).cast("string"), F.lit("")), r.since), record)
            rows.append(F.when(F.expr(r.where), record))
        found = tables[table].select(F.explode(F.array(*rows)).alias("r")).where("r is not null")
        parts.append(found.select("r.*").where("body <> ''" if told_of else "true"))
    return reduce(DataFrame.unionByName, parts)


def name_matches(records: DataFrame, companies: DataFrame) -> DataFrame:
    """(match, name, company): names of records (match, name) and companies (company, name) that a way of matching pairs.

    Equal names are matched once. By words, a company's rarest identifying word finds the names to test.
    """
    listed = checkpointed(records.select("match", "name").where("name is not null").distinct())
    asked = companies.where("name is not null").select("company", F.col("name").alias("own"), N.identifying_tokens(F.col("name")).alias("tokens"))
    words = F.array_distinct(F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda w: w != ""))
    index = listed.where("match <> 'substring'").select("match", "name", F.explode(words).alias("word"))
    often = index.groupBy("word").agg(F.count("*").alias("n"))
    # Companies of equal words are looked up once.
    sets = asked.select(F.array_sort(F.array_distinct("tokens")).alias("set")).distinct()
    rare = first_per_key(sets.select("set", F.explode("set").alias("word")).join(often, "word", "left"), ["set"], F.coalesce("n", F.lit(0)), F.col("word")).select("set", "word")
    hits = asked.withColumn("set", F.array_sort(F.array_distinct("tokens"))).join(rare, "set").join(index, "word")
    fits = F.when(F.col("match") == "strict", N.strict_match(F.col("name"), F.col("tokens"))).otherwise(N.matches_all(F.col("name"), F.col("tokens")))
    by_words = hits.where(fits).select("match", "name", "company")
    inside = asked.withColumn("needle", F.lower(F.btrim(F.substring("own", 1, NEEDLE))))
    pairs = containing(inside.select("needle"), listed.where("match = 'substring'").select("name"))
    by_part = inside.join(pairs, "needle").select(F.lit("substring").alias("match"), "name", "company")
    return by_words.unionByName(by_part)


def record_signals(rules: list[RecordRule], tables: dict[str, DataFrame], companies: DataFrame) -> DataFrame:
    """(company, tag, polarity, n_records, text): what each source says of each company that it names.

    n_records counts the records told of: those that match, without repeats where the rule drops them. A record that names a
    company twice counts once. The text stops at the rule's cap or at MOST_CHARS. Companies without identifying words match
    by no words; null names match nothing.
    """
    records = compiled(rules, tables).select("tag", "match", "body", "seq", F.explode("names").alias("name")).where("name is not null")
    once = [r.tag for r in rules if r.distinct]
    # What has been said before goes, in sources where that is the rule; elsewhere each record stands for itself.
    own = F.when(~F.col("tag").isin(once), F.col("seq")).alias("own")
    # What is said of one name goes before the names meet the companies, the rest after.
    first = records.groupBy("tag", "match", "name", "body", own).agg(F.min("seq").alias("seq"))
    named = compiled(rules, tables, told_of=False).select("match", F.explode("names").alias("name"))
    met = first.join(name_matches(named, companies), ["match", "name"]).select("company", "tag", "seq", "body").distinct()
    said = met.groupBy("company", "tag", "body", own).agg(F.min("seq").alias("seq"))
    counts = said.groupBy("company", "tag").agg(F.count("*").alias("n_records"))
    caps = F.lit(MOST_CHARS)  # as every record has a letter, no more can be told
    for r in rules:
        if r.cap:
            caps = F.when(F.col("tag") == r.tag, min(r.cap, MOST_CHARS)).otherwise(caps)
    nth = F.row_number().over(W.partitionBy("company", "tag").orderBy("seq", "body"))
    first = said.withColumn("nth", nth).where(F.col("nth") <= MOST_CHARS).where(F.col("nth") <= caps)
    told = first.groupBy("company", "tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "body"))), lambda x: x["body"]), SEPARATOR).alias("body"))
    about = F.create_map(*(x for r in rules for x in (F.lit(r.tag), F.struct(F.lit(r.head).alias("head"), F.lit(r.link).alias("link"), F.lit(r.polarity).alias("polarity")))))
    out = told.join(counts, ["company", "tag"]).withColumn("a", F.element_at(about, F.col("tag")))
    return out.select("company", "tag", F.col("a.polarity").alias("polarity"), "n_records", F.concat("a.head", F.substring("body", 1, MOST_CHARS), "a.link").alias("text"))
