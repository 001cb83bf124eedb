"""License scans: places of license phrases, and an exact set-similarity join of text blocks with templates.

Only DataFrame functions are used. A block is a line, or a window of as many consecutive words as the template has,
whatever line breaks it holds. Its containment in a template is the share of the
template's distinct words that the block has. Template words are ordered by how many texts of the corpus have them, rarest
first. A block that reaches the threshold must have one of a template's |T| - need + 1 rarest words (prefix), must
have `need` template words at all (length), and enough must be left after the first common word (position); blocks
that pass are verified.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored

# Phrases and labels of the base scan.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Public notice texts of well-known licenses.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
]
# What the license texts themselves say, or ask to be put into files. They are met by windows only.
NOTICES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions:"""),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met:"""),
    ("bsd", """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer."""),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
]
THRESHOLD = 0.8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LINE = r"[\r\n]+"
_ANY = r"(?<= )(?:" + "|".join(PHRASES) + r")(?= )"


def _folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _words(text: Column) -> Column:
    return F.split(_folded(text), GAP)


def _before(prefix: Column) -> Column:
    """Words in a prefix that begins and ends with a space."""
    return (F.length(prefix) - F.length(F.replace(prefix, F.lit(" "), F.lit(""))) - 1).cast("long")


def base_scan(words: Column) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and base (array of labels) of a text's words; the phrases share the word license."""
    maybe = F.array_contains(words, "license")
    spaced = F.when(maybe, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))
    found = maybe & F.regexp_like(spaced, F.lit(_ANY))
    last = F.regexp_extract(spaced, r"(?s)^(.* )(?:" + "|".join(PHRASES) + r")(?= )", 1)
    labels = F.array(*[F.when(F.contains(spaced, F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES.items()])
    return {
        "n_words": F.size(words).cast("long"),
        "n_base": F.when(maybe, F.regexp_count(spaced, F.lit(_ANY))).otherwise(0).cast("long"),
        "first_word": F.when(found, _before(F.split(spaced, _ANY, 2)[0])),
        "last_word": F.when(found, _before(last)),
        "base": F.when(maybe, F.array_compact(labels)).otherwise(F.array().cast("array<string>")),
    }


def template_sets(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    import re

    return [(label, sorted({w for w in re.split(GAP, text.lower()) if w})) for label, text in templates]


def word_places(has: DataFrame, templates: list[tuple[str, str]]) -> dict[str, int]:
    """The places of all template words by how many texts have them, rarest first, then by name; `has` are arrays of a text's distinct ones."""
    vocabulary = sorted({w for _, words in template_sets(templates) for w in words})
    if not vocabulary:
        raise ValueError("no template words")
    counted = has.select(F.explode("has").alias("word")).groupBy("word").count()
    often = {r["word"]: r["count"] for r in counted.collect()}  # a row per template word at most
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}


def template_words(words: Column, templates: list[tuple[str, str]]) -> Column:
    """The distinct template words of a text."""
    vocabulary = sorted({w for _, own in template_sets(templates) for w in own})
    return F.array_distinct(F.filter(words, lambda w: w.isin(vocabulary)))


def may_match(has: Column, templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> Column:
    """Whether a text has enough distinct words of any template, wherever they stand; others hold no match."""
    sets = [(words, math.ceil(threshold * len(words) - 1e-9)) for _, words in template_sets(templates)]
    enough = reduce(lambda a, b: a | b, [F.size(F.array_intersect(has, F.array(*map(F.lit, words)))) >= need for words, need in sets])
    return F.when(F.size(has) >= min(need for _, need in sets), enough).otherwise(F.lit(False))


def template_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, text_col: str = "text", place: dict[str, int] | None = None) -> DataFrame:
    """Every line of every row that meets the threshold with a template: the row's columns, line (from 0), label, containment.

    Null and empty texts match nothing; repeated rows match each for itself. A text column is not returned.
    Columns `line`, `label` and `containment` of docs are replaced. The templates are a short fixed list, so
    their words' order (place; counted over docs if not given) and their index are sent along with the plan.
    """
    sets = template_sets(templates)
    place = place or word_places(docs.select(template_words(_words(F.col(text_col)), templates).alias("has")), templates)
    vocabulary = sorted({w for _, words in sets for w in words})
    need = [math.ceil(threshold * len(words) - 1e-9) for _, words in sets]
    known = lambda words: F.filter(words, lambda w: w.isin(vocabulary))
    index = []
    for (label, words), least in zip(sets, need, strict=True):
        words = sorted(words, key=place.__getitem__)
        for position, word in enumerate(words[: len(words) - least + 1]):
            index.append(F.struct(F.lit(word).alias("__word"), F.lit(label).alias("label"), F.lit(least).alias("__need"), F.lit(position).alias("__at"), F.array(*map(F.lit, words)).alias("__words")))
    prefixes = docs.sparkSession.range(1).select(F.inline(F.array(*index)))
    rank = F.create_map(*[x for w in vocabulary for x in (F.lit(w), F.lit(place[w]))])

    keep = [c for c in docs.columns if c not in (text_col, "line", "label", "containment")]
    lines = docs.select(*keep, F.posexplode(F.split(F.col(text_col), LINE)).alias("line", "__line"))
    lines = lines.select(*keep, "line", F.array_distinct(known(_words(F.col("__line")))).alias("__has")).where(F.size("__has") >= min(need))
    rows = lines.select("*", F.explode("__has").alias("__word")).join(F.broadcast(prefixes), "__word")
    rows = rows.where(F.size("__has") >= F.col("__need"))
    before = F.size(F.filter("__has", lambda w: rank[w] < rank[F.col("__word")]))
    left = 1 + F.least("__at", before) + F.least(F.size("__words") - F.col("__at"), F.size("__has") - before) - 1
    rows = rows.where(left >= F.col("__need"))
    common = F.size(F.array_intersect("__has", "__words"))
    rows = rows.where(common >= F.col("__need"))
    return rows.select(*keep, "line", "label", (common / F.size("__words")).alias("containment"))


def window_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES + NOTICES, threshold: float = THRESHOLD, text_col: str = "text", place: dict[str, int] | None = None) -> DataFrame:
    """Windows that meet the threshold with a template of as many words: the row's columns, word (where it begins, from 0), label, containment.

    Line breaks don't count. Only windows that begin with a template word are given: others hold no more of it. Rows
    are first held against the templates as a whole: one of a template's |T| - need + 1 first words (by place; the
    longest if that isn't given) and `need` words in all must be there. Equal rows and repeated matches are given once; nulls match nothing.
    """
    import re

    sizes = [sum(bool(w) for w in re.split(GAP, text.lower())) for _, text in templates]
    sets = template_sets(templates)
    vocabulary = sorted({w for _, words in sets for w in words})
    scale = 4 * max(sizes) ** 2  # a window of n words spans less than scale - max(sizes) in places of scale // n each, and n + 1 words more
    literal = lambda words: F.array(*map(F.lit, words))
    fitting = []
    for (label, words), size in zip(sets, sizes, strict=True):
        need = math.ceil(threshold * len(words) - 1e-9)
        first = sorted(words, key=(lambda w: (-len(w), w)) if place is None else place.__getitem__)[: len(words) - need + 1]
        near = F.arrays_overlap("__has", literal(first)) & (F.size(F.array_intersect("__has", literal(words))) >= need)
        fitting.append(F.when(near, F.struct(F.lit(label).alias("label"), F.lit(need).alias("need"), F.lit(scale // size).alias("step"), literal(words).alias("words"))))
    keep = [c for c in docs.columns if c not in (text_col, "word", "label", "containment")]
    rows = docs.select(*keep, F.col(text_col).alias("__text"), F.array_distinct(F.filter(_words(F.col(text_col)), lambda w: w.isin(vocabulary))).alias("__has"))
    rows = rows.select(*keep, "__text", F.array_compact(F.array(*fitting)).alias("__fit")).where(F.size("__fit") > 0)
    rows = rows.select(*keep, F.explode("__fit").alias("__t"), F.filter(_words(F.col("__text")), lambda w: w != "").alias("__all"))
    placed = F.filter(F.transform("__all", lambda w, i: F.struct(i.alias("word"), w.alias("w"))), lambda x: F.array_contains(F.col("__t.words"), x["w"]))
    hits = rows.select(*keep, "__t", F.explode(placed).alias("__hit")).select(*keep, "__t", F.col("__hit.word").alias("word"), F.col("__hit.w").alias("__w")).distinct()
    ahead = W.partitionBy(*keep, "__t").orderBy(F.col("word").cast("long") * F.col("__t.step")).rangeBetween(0, scale - max(sizes) - 1)
    common = F.size(F.collect_set("__w").over(ahead))
    found = hits.select(*keep, "word", "__t", common.alias("__common")).where(F.col("__common") >= F.col("__t.need"))
    return found.select(*keep, "word", F.col("__t.label").alias("label"), (F.col("__common") / F.size("__t.words")).alias("containment"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    labels are the base labels and those of matched templates, by lines, and of templates and notices by windows.
    score is 1 where a base phrase stands, else the best containment of a matched template, else 0. Rows without text
    have no words and no labels, and an empty table gives no rows. Rows that agree in id and text share their matches,
    so repeated rows each get them. Texts are split into words once. What they give is written, with the text itself only
    where it has enough words of a template; blocks are made of those texts. Only (id, text hash, label) are shuffled.
    """
    all_ = [*templates, *notices]
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__words", F.array_remove(_words(F.col("__text")), ""))
    rows = rows.withColumn("has", template_words(F.col("__words"), all_))
    read = rows.select("__id", "__hash", "has", *[c.alias(n) for n, c in base_scan(F.col("__words")).items()], F.when(may_match(F.col("has"), all_, threshold), F.col("__text")).alias("__text"))
    read = stored(read, "read")
    place = word_places(read, all_)
    likely = read.where("__text is not null").select("__id", "__hash", "__text")
    found = template_matches(likely, templates, threshold, "__text", place).drop("line").unionByName(window_matches(likely, all_, threshold, "__text", place).drop("word"))
    found = found.groupBy("__id", "__hash").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    found = found.select(F.col("__id").alias("__id2"), F.col("__hash").alias("__hash2"), "more", "best")
    out = read.drop("__text", "has").join(found, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__hash") == F.col("__hash2")), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(F.col("__id").alias(id_col), "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(F.array_union("base", more)).alias("labels"), score.alias("score"))


def oracle_sql() -> str:
    """DuckDB SQL for scan_licenses over documents: every line against every template. It has no windows: texts with wrapped notices get more labels from scan_licenses."""
    gap, phrases = GAP, list(PHRASES)
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    values = ", ".join(f"('{label}', {quoted(words)}, {math.ceil(THRESHOLD * len(words) - 1e-9)})" for label, words in template_sets(TEMPLATES))
    starts = " UNION ALL ".join(f"SELECT k, '{PHRASES[p]}' AS label, unnest(list_filter(range(len(w)), lambda i: {' AND '.join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(p.split()))})) AS pos FROM worded" for p in phrases)
    return rf"""
WITH rowed AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
worded AS (SELECT k, doc_id, t, list_filter(regexp_split_to_array(t, '{gap}'), lambda x: x <> '') AS w FROM rowed),
places AS ({starts}),
base AS (SELECT k, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_distinct(list(label)) AS base FROM places GROUP BY k),
lines AS (SELECT k, unnest(regexp_split_to_array(t, '{LINE}')) AS line FROM rowed),
sets AS (SELECT k, list_distinct(list_filter(regexp_split_to_array(line, '{gap}'), lambda x: x <> '')) AS has FROM lines),
templates(label, words, need) AS (VALUES {values}),
found AS (SELECT k, list_distinct(list(label)) AS more, max(len(list_intersect(has, words)) / len(words)::DOUBLE) AS best
  FROM sets, templates WHERE len(list_intersect(has, words)) >= need GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM worded LEFT JOIN base USING (k) LEFT JOIN found USING (k)
"""
