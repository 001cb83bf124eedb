"""What model answers say: objects with the keys asked for, lists of names, corrections that may be taken.

Answers are text around JSON. What isn't JSON gives null, or an empty list; nothing raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a corrected score must be above it.
UPLIFT_ABOVE = 60.0
REASON_LENGTH = 500


def unfenced(text: Column) -> Column:
    """The text without code fences and space at its ends."""
    return F.btrim(F.regexp_replace(text, "```(?:json)?", ""), F.lit(" \t\n\r"))


def _has(text: Column, keys: list[str]) -> Column:
    """Whether the whole text is one JSON object with all keys; the keys alone are also read from an object that more text follows."""
    return F.coalesce((F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1) & (F.size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(text))) == 0), F.lit(False))


def object_with(text: Column, keys: list[str]) -> Column:
    """JSON text of the answer if it is an object with all keys, else of the last such object in it, the innermost first; else null.

    An object in the text is tried up to its first closing brace, so one that holds others is found only as the whole answer.
    """
    plain = unfenced(text)
    some = F.concat(F.regexp_extract_all(plain, F.lit(r"(?s)\{[^{}]*\}"), F.lit(0)), F.regexp_extract_all(plain, F.lit(r"(?s)\{.*?\}"), F.lit(0)))
    good = F.filter(some, lambda c: _has(c, keys))
    return F.when(_has(plain, keys), plain).otherwise(F.try_element_at(good, F.lit(-1)))


def name_list(text: Column, key: str = "companies") -> Column:
    """Names of an answer that is an object with the key, or a list, else of the first object with the key in it; empty without one.

    Names are trimmed and empty ones left out.
    """
    plain = unfenced(text)
    inner = F.regexp_extract(plain, rf'(?s)\{{.*?"{key}".*?\}}', 0)
    listed = lambda json: F.from_json(F.get_json_object(json, f"$.{key}"), "array<string>")
    found = F.coalesce(F.when(_has(plain, [key]), listed(plain)), F.when(plain.startswith("["), F.from_json(plain, "array<string>")), F.when(_has(inner, [key]), listed(inner)), F.array().cast("array<string>"))
    return F.filter(F.transform(found, lambda n: F.btrim(n)), lambda n: n.isNotNull() & (n != ""))


def correction(text: Column, original: Column) -> Column:
    """applied, corrected and reasoning of an answer about a score: taken only if it is above UPLIFT_ABOVE, 100 at most and an improvement."""
    json = object_with(text, ["corrected_score"])
    new = F.try_to_number(F.get_json_object(json, "$.corrected_score"), F.lit("999.999999")).cast("double")
    fine = F.coalesce((new > UPLIFT_ABOVE) & (new <= 100) & (new > original), F.lit(False))
    why = F.substring(F.btrim(F.coalesce(F.get_json_object(json, "$.reasoning"), F.lit(""))), 1, REASON_LENGTH)
    return F.struct(fine.alias("applied"), F.when(fine, new).alias("corrected"), F.when(fine, F.when(why == "", "(no reasoning given)").otherwise(why)).alias("reasoning"))
