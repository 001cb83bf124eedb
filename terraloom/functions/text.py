"""Text predicates and measures: dates, years, counts, quotes, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def whole_word(words: list[str]) -> str:
    """A pattern for any of the words with no letter, digit or underscore beside it, in any script."""
    return r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")([^\p{L}\p{N}_]|$)"


def years(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)"), F.lit(1)), lambda y: y.cast("int"))


def is_recent(text: Column, since: int) -> Column:
    """Some year is recent enough, or no year is named."""
    found = years(text)
    return (F.size(found) == 0) | F.exists(found, lambda y: y >= since)


def freshness(day: Column, as_of: Column, floor: float = 0.5, missing: float = 0.6) -> Column:
    """exp(-age/365), no less than the floor; future days count as today; a missing day has its own value."""
    age = F.greatest(F.lit(0), F.datediff(as_of, day))
    return F.when(day.isNull(), missing).otherwise(F.greatest(F.lit(floor), F.exp(-age / 365.0)))


def is_negated(text: Column, phrase: str, markers: list[str], window: int = 90) -> Column:
    """A marker stands in the characters before the phrase's first place."""
    at = F.instr(F.lower(text), phrase)
    before = F.substring(F.lower(text), F.greatest(F.lit(1), at - window), F.least(F.lit(window), at - 1))
    return (at > 0) & F.greatest(*[F.contains(before, F.lit(m)) for m in markers])


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def fingerprint(text: Column) -> Column:
    """sha256 of the lower-cased text with white space collapsed."""
    return F.sha2(squeezed(text), 256)


def quote_holds(source: Column, quote: Column, value: Column) -> Column:
    """The quote stands in the source and the value in the quote, white space aside; an empty value passes."""
    tight = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    return F.contains(tight(source), tight(quote)) & ((F.coalesce(value, F.lit("")) == "") | F.contains(tight(quote), tight(value)))


def looks_garbled(text: Column) -> Column:
    """Too few letters or too little white space for prose."""
    n = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    spaces = F.length(F.regexp_replace(text, r"[^ \t\r\n]", ""))
    return (n == 0) | (letters / n < 0.45) | (spaces / n < 0.08)


def visible_text(html: Column) -> Column:
    """Scripts, styles and tags out, common entities decoded, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def money(text: Column) -> Column:
    """A number without currency signs and thousands marks; what isn't one counts as 0."""
    return F.coalesce(F.try_to_number(F.regexp_replace(text, r"[^0-9.]", ""), F.lit("999999999999.99")).cast("double"), F.lit(0.0))


def numeric(text: Column) -> Column:
    """A number without %, $ and commas; null for anything else."""
    return F.regexp_replace(text, "[$,%]", "").try_cast("double")


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")


# Fixed value: an entry of a filing's index, a heading and its page.
INDEX_ENTRY = r"Item\s+[0-9]+[A-Z]?\.\s*[^.]{0,80}?\s[0-9]{1,3}\b"


def table_of_contents(text: Column, least: int = 3) -> Column:
    """Whether a text has index entries enough to be a table of contents."""
    return F.regexp_count(text, F.lit(INDEX_ENTRY)) >= least


MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def dates_in(text: Column) -> Column:
    """All dates of a text as an array: day, month name, year first, then ISO ones; impossible days are left out, null gives null."""
    named = F.regexp_extract_all(text, F.lit(rf"(?i)\b\d{{1,2}}\s+(?:{MONTHS})\w*\s+\d{{4}}\b"), F.lit(0))

    def as_date(x):
        month = F.lower(F.regexp_extract(x, r"^\d+\s+([A-Za-z]{3})", 1))
        number = F.floor((F.instr(F.lit(MONTHS.lower()), month) + 3) / 4).cast("string")
        day = F.regexp_extract(x, r"^(\d+)", 1)
        return F.concat_ws("-", F.regexp_extract(x, r"(\d{4})$", 1), F.lpad(number, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")

    iso = F.regexp_extract_all(text, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0))
    found = F.concat(F.transform(named, as_date), F.transform(iso, lambda x: x.try_cast("date")))
    return F.filter(found, lambda d: d.isNotNull() & (F.year(d) > 0))


def mail_time(header: Column) -> Column:
    """Time of a mail date header, its weekday ignored; without a zone it is UTC, and null if it can't be read."""
    plain = F.trim(F.regexp_replace(header, r"^\s*[A-Za-z]{3},\s*", ""))
    plain = F.regexp_replace(plain, r"\s*(GMT|UTC|UT|Z)$", " +0000")
    zoned = F.when(plain.rlike(r"[+-]\d{4}$"), plain).otherwise(F.concat(plain, F.lit(" +0000")))
    return F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z"))


def section(text: Column, heading: str, window: int = 2000) -> Column:
    """What follows the last match of a heading, cut at the next numbered item unless that is within 100 characters; null without any."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    head = rf"(?is)^.*(?:{heading})"
    body = strip(F.substring(F.regexp_replace(text, head, ""), 1, window))
    before = F.regexp_extract(body, r"(?s)^(.*?)Item\s*\d+[A-Z]?\.", 1)
    return F.when(text.rlike(head), F.nullif(strip(F.when(F.length(before) > 100, before).otherwise(body)), F.lit("")))


def marked_urls(text: Column) -> Column:
    """Addresses that stand in angle brackets, each once, in the order met."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"<(https?://[^>\s]+)>"), F.lit(1)))


def without_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"<(https?://[^>\s]+)>", "")


def segments(text: Column) -> Column:
    """Pieces that end in a closing bracket followed by white space, trimmed, without empty ones."""
    pieces = F.transform(F.split(text, r"(?<=>)\s+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(pieces, lambda x: x != "")


def is_navigation(text: Column) -> Column:
    """Six lines or more, of which 30 % (and four) end in a bare number and 70 % are short: a table of contents."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    n = F.size(lines)
    ending = F.size(F.filter(lines, lambda x: x.rlike(r"\s\d{1,3}$")))
    short = F.size(F.filter(lines, lambda x: F.length(x) < 60))
    return (n >= 6) & (ending >= F.greatest(F.lit(4.0), n * 0.3)) & (short >= n * 0.7)


def off_topic(text: Column, terms: list[str]) -> Column:
    """A text that has none of the terms as words; missing and empty texts can't be judged and aren't off topic."""
    said = text.rlike(r"(?i)(^|[^a-z0-9_])(?:" + "|".join(terms) + r")([^a-z0-9_]|$)")
    return F.coalesce(~said & (text != ""), F.lit(False))
