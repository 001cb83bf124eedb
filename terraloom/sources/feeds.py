"""Items of news feeds, rows of HTML tables, and files by the names in their paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Entities as feeds write them, in the order they are replaced.
ENTITIES = {"&amp;": "&", "&#8217;": "'", "&#8216;": "'", "&#8220;": '"', "&#8221;": '"', "&nbsp;": " ", "&#8211;": "-", "&#039;": "'", "&quot;": '"'}
DATE_LENGTH = 16


def plain(raw: Column) -> Column:
    """Text of a piece of XML: CDATA unwrapped, tags to spaces, entities decoded, single spaces."""
    out = F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, c in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(c))
    return F.btrim(F.regexp_replace(out, r"\s+", " "))


def tagged(block: Column, name: str) -> Column:
    """Plain text of the first element of a name; empty without one."""
    return plain(F.regexp_extract(block, rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1))


def feed_items(feeds: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """keys, nth (from 0), title, link, date, body, broken of each item of a feed's text.

    The body is the full content, else the description. An item without either, or that holds the start of another (it was
    never closed), is broken: it is given with what it has, for the caller to keep apart. Feeds without items, empty ones
    and null give none.
    """
    blocks = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))
    items = feeds.select(*keys, F.posexplode(blocks).alias("nth", "__item"))
    body = F.coalesce(F.nullif(tagged(F.col("__item"), "content:encoded"), F.lit("")), tagged(F.col("__item"), "description"))
    parts = items.select(*keys, "nth", tagged(F.col("__item"), "title").alias("title"), tagged(F.col("__item"), "link").alias("link"), F.substring(tagged(F.col("__item"), "pubDate"), 1, DATE_LENGTH).alias("date"), body.alias("body"), F.contains("__item", F.lit("<item>")).alias("__open"))
    return parts.withColumn("broken", (F.col("body") == "") | F.col("__open")).drop("__open")


def table_rows(pages: DataFrame, keys: list[str], html: str, cells: int = 5) -> DataFrame:
    """keys, nth, cells (plain texts) of the table rows that have just so many cells; rows of other widths, such as headings, go."""
    rows = pages.select(*keys, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("nth", "__row"))
    texts = F.transform(F.regexp_extract_all("__row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), plain)
    return rows.select(*keys, "nth", texts.alias("cells")).where(F.size("cells") == cells)


def file_index(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(name, n, paths): the files of a folder by what stands before the first "__" of their names, "_" as spaces, lower-cased.

    Only names and sizes are listed, no file is read. Files without a name before it are left out; a path is listed once.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path")
    name = F.btrim(F.replace(F.split(F.element_at(F.split("path", "/"), -1), "__")[0], F.lit("_"), F.lit(" ")))
    named = files.select(F.lower(name).alias("name"), "path").where("name <> ''")
    return named.groupBy("name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))
