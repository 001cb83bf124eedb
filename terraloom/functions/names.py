"""Company names: normal forms, tokens and match predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal-form tokens that are stripped from the tail of a name.
SUFFIXES = [
    "inc", "incorporated", "corp", "corporation", "ltd", "limited", "llc", "llp", "plc", "co", "company", "group", "holding", "holdings",
    "sa", "sau", "se", "ag", "gmbh", "bv", "nv", "srl", "spa", "sarl", "sas", "ab", "as", "oy", "kk", "pte", "pty", "pvt", "sdn", "bhd",
]
# Words that identify no company.
STOPWORDS = [
    "the", "and", "for", "of", "a", "an", "inc", "inc.", "ltd", "ltd.", "llc", "l.l.c", "plc", "co", "co.", "corp", "corp.", "corporation",
    "company", "group", "holdings", "holding", "limited", "international", "global", "worldwide", "enterprises", "sa", "s.a", "ag", "gmbh",
    "bv", "b.v", "nv", "n.v", "as", "ab", "oy", "spa", "s.p.a", "srl", "s.r.l", "sas", "sarl", "pty", "pte", "kk", "services", "solutions",
    "systems", "technologies", "technology",
]

_TAIL = r"(\s+(" + "|".join(SUFFIXES) + r"))+\s*$"


def normal_form(name: Column) -> Column:
    """Lower case, punctuation to spaces, legal forms off the tail; a name of legal forms only becomes empty."""
    spaced = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_\s]", " ")
    stripped = F.regexp_replace(F.concat(F.lit(" "), F.trim(F.regexp_replace(spaced, r"\s+", " "))), _TAIL, "")
    return F.trim(stripped)


def without_suffixes(name: Column) -> Column:
    """The variant that drops legal forms wherever they stand."""
    words = F.split(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(SUFFIXES)), " ")


def identifying_tokens(name: Column, least: int = 3) -> Column:
    """ASCII tokens of at least `least` letters that aren't stop words."""
    words = F.split(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(STOPWORDS))


def mentions(text: Column, tokens: Column) -> Column:
    """Any token stands in the text; a name without tokens passes."""
    return (F.size(tokens) == 0) | F.exists(tokens, lambda t: F.contains(F.lower(text), t))


def matches_all(text: Column, tokens: Column) -> Column:
    """Every token is a whole word of the text."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "), " ")
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.array_contains(words, t))


def strict_match(text: Column, tokens: Column) -> Column:
    """matches_all, with at least 8 letters of tokens, and 10 if there is one token."""
    letters = F.aggregate(tokens, F.lit(0), lambda a, t: a + F.length(t))
    return matches_all(text, tokens) & (letters >= 8) & ((F.size(tokens) > 1) | (letters >= 10))


def overlap_match(a: Column, b: Column, forward: float = 0.8, backward: float = 0.5) -> Column:
    """Share of a's tokens in b and of b's in a, averaged; null below either floor."""
    common = F.size(F.array_intersect(a, b))
    there, back = common / F.nullif(F.size(a), F.lit(0)), common / F.nullif(F.size(b), F.lit(0))
    return F.when((there >= forward) & (back >= backward), (there + back) / 2)


def stem(word: Column) -> Column:
    """ics to ic, ies to y, and a final s dropped, where enough of the word is left."""
    n = F.length(word)
    return F.when(word.endswith("ics") & (n > 5), F.concat(F.substring(word, 1, n - 3), F.lit("ic"))).when(word.endswith("ies") & (n > 5), F.concat(F.substring(word, 1, n - 3), F.lit("y"))).when(word.endswith("s") & (n > 3), F.substring(word, 1, n - 1)).otherwise(word)
