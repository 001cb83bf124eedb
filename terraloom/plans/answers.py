"""Answers of models, as texts around JSON that events make."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers
from .base import query

_K = "CAST(event_id % 90 + 10 AS string)"
_OBJECT = f"""concat('{{"e_score": ', {_K}, ', "s_score": 1.5, "note": "', event_type, '"}}')"""
_ANSWERS = f"""SELECT event_id, event_type, CASE CAST(event_id % 6 AS int) WHEN 0 THEN concat('```json', chr(10), {_OBJECT}, chr(10), '```') WHEN 1 THEN concat('First {{"e_score": 1, "s_score": 2}} then {{not json}} and ', {_OBJECT}, ' so {{"s_score": 3}}')
  WHEN 2 THEN '{{"e_score": 1}} only' WHEN 3 THEN NULL WHEN 4 THEN concat('{{"e_score": ', {_K}, ', "s_score": {{"low": 1}}}}') ELSE 'none' END AS answer FROM events"""


@query("x53_object_with_keys", f"""SELECT event_id, CASE CAST(event_id % 6 AS int) WHEN 0 THEN {_OBJECT} WHEN 1 THEN {_OBJECT} WHEN 4 THEN answer END AS found FROM ({_ANSWERS})""")
def _(t):
    t.events.createOrReplaceTempView("events")
    return t.spark.sql(_ANSWERS).select("event_id", answers.object_with(F.col("answer"), ["e_score", "s_score"]).alias("found"))


_LISTS = """SELECT event_id, event_type, CASE CAST(event_id % 5 AS int) WHEN 0 THEN concat('{"companies": ["', event_type, ' Co", " ", "B"]}') WHEN 1 THEN concat('["', event_type, '", ""]') WHEN 2 THEN concat('Sure: {"companies": [" ', event_type, '"]} and more') WHEN 3 THEN 'no list' END AS answer FROM events"""


@query("x54_name_lists", f"""SELECT event_id, CASE CAST(event_id % 5 AS int) WHEN 0 THEN concat(event_type, ' Co|B') WHEN 1 THEN event_type WHEN 2 THEN event_type ELSE '' END AS names FROM ({_LISTS})""")
def _(t):
    t.events.createOrReplaceTempView("events")
    return t.spark.sql(_LISTS).select("event_id", F.array_join(answers.name_list(F.col("answer")), "|").alias("names"))


_CORRECTIONS = """SELECT event_id, value, CAST(event_id % 100 AS double) AS original, concat('Well. {"corrected_score": ', CAST(event_id * 7 % 120 AS string), CASE WHEN event_id % 3 = 0 THEN ', "reasoning": " it is big "}' ELSE '}' END) AS answer FROM events"""


@query("m27_corrections", f"""SELECT event_id, fine AS applied, CASE WHEN fine THEN new END AS corrected, CASE WHEN fine THEN CASE WHEN event_id % 3 = 0 THEN 'it is big' ELSE '(no reasoning given)' END END AS reasoning
  FROM (SELECT *, (event_id * 7 % 120)::DOUBLE AS new, event_id * 7 % 120 > 60 AND event_id * 7 % 120 <= 100 AND event_id * 7 % 120 > original AS fine FROM ({_CORRECTIONS}))""")
def _(t):
    t.events.createOrReplaceTempView("events")
    return t.spark.sql(_CORRECTIONS).select("event_id", answers.correction(F.col("answer"), F.col("original")).alias("c")).select("event_id", "c.*")
