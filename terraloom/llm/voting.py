"""Quality by weak supervision: rules vote good or bad or abstain, expectation-maximisation weighs them, a posterior decides.

Only DataFrame functions are used. Texts are read once, into a row of counts each; the model sees how many documents cast
each pattern of votes (3 to the number of rules patterns at most), so its steps don't grow with the documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored

SPACES = r"[\x20\x09-\x0D]"
#: name: (bad if, good if), over the counts of measures(). Neither: the rule abstains; so do all on a text without words.
RULES = {
    "symbols": ("100 * n_symbols > 10 * n_words", "100 * n_symbols <= 2 * n_words"),
    "dup_lines": ("100 * n_dup_lines > 30 * n_lines", "n_dup_lines = 0 AND n_lines >= 3"),
    "repeats": ("100 * n_repeat_words > 15 * n_words", "100 * n_repeat_words <= 5 * n_words AND n_words >= 50"),
    "capitals": ("100 * n_upper > 40 * word_chars", "100 * n_upper <= 15 * word_chars"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 12 * n_words", "word_chars >= 3 * n_words AND word_chars <= 9 * n_words"),
    "plain_words": ("100 * n_plain < 60 * n_words", "100 * n_plain >= 85 * n_words"),
    "letters": ("100 * n_alpha < 70 * n_words", "100 * n_alpha >= 90 * n_words"),
    "sentences": ("(n_words >= 40 AND n_ends = 0) OR 100 * n_ends > 40 * n_words", "n_ends >= 1 AND 100 * n_ends <= 25 * n_words"),
    "shouts": ("100 * n_shouts > 10 * n_words", "100 * n_shouts <= 2 * n_words"),
    "length": ("n_words < 20", "n_words >= 50"),
}
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
WINDOW = 5
#: First guesses: share of good documents, of good votes on good ones, of bad votes on bad ones; and the weight of the last two, in documents.
PRIOR, PASS, CATCH, WEIGHT = 0.85, 0.98, 0.4, 20
ROUNDS = 15
#: Bounds of the share of good votes on good documents.
LEAST_PASS, MOST_PASS = 0.97, 0.999


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, size: int = WINDOW) -> Column:
    """Words in windows of `size` words found twice or more in the text. Windows are told apart by 64-bit hashes."""

    def covered(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), marked))

    def marked(ordered: Column) -> Column:
        return let(F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))), lambda same: lengths(F.sort_array(F.filter(F.zip_with(F.zip_with(same, F.concat(F.array(F.lit(False)), F.slice(same, F.lit(1), F.size(same) - 1)), lambda x, y: x | y), ordered, lambda on, w: F.when(on, w["i"])), lambda i: i.isNotNull()))))

    def lengths(starts: Column) -> Column:
        return let(starts, lambda s: F.aggregate(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.least(F.coalesce(b - a, F.lit(size)), F.lit(size))), F.lit(0), lambda total, k: total + k))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - size + 1), lambda i: F.xxhash64(*(F.element_at(h, i + k) for k in range(size)))))
    return F.when(F.size(words) < size, 0).otherwise(let(windows, covered)).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each whole text, by id; a null text counts as empty, equal rows stay, other columns are left out."""
    split = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    split = split.withColumn("__words", F.filter(F.split("__text", SPACES + "+"), lambda w: w != ""))
    split = split.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    count = lambda pattern: F.regexp_count("__text", F.lit(pattern)).cast("long")
    of = lambda pattern: F.size(F.filter("__words", lambda w: w.rlike(pattern))).cast("long")
    return split.select(
        F.col(f"`{id_col}`"),
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("__words")).alias("n_repeat_words"),
        count(r"\p{Lu}").alias("n_upper"),
        of(r"\p{L}").alias("n_alpha"),
        of(r"\A\p{L}+[.,;:!?]?\z").alias("n_plain"),
        of(r"[.!?]\z").alias("n_ends"),
        count("!").alias("n_shouts"),
    )


def votes() -> Column:
    """The rules' votes in order: -1 is bad, 1 good, 0 abstains."""
    return F.expr("array(%s)" % ", ".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for bad, good in RULES.values()))


@dataclass(frozen=True)
class RuleModel:
    """Share of good documents and, by rule, the share of good votes on good documents and of bad votes on bad ones."""

    prior: float
    passes: list[float]
    catches: list[float]

    def posterior(self, votes: Column) -> Column:
        """Probability that a document with these votes is good, rounded to 6 places."""
        good = F.array(*(F.lit(math.log(a) - math.log(1 - b)) for a, b in zip(self.passes, self.catches, strict=True)))
        bad = F.array(*(F.lit(math.log(1 - a) - math.log(b)) for a, b in zip(self.passes, self.catches, strict=True)))
        odds = F.transform(votes, lambda v, i: F.when(v == 1, F.get(good, i)).when(v == -1, F.get(bad, i)).otherwise(0.0))
        return F.round(1 / (1 + F.exp(-F.aggregate(odds, F.lit(math.log(self.prior) - math.log(1 - self.prior)), lambda total, w: total + w))), 6)


#: Sums over patterns, in millionths of a document: whole numbers, so that no order of adding changes them.
MICRO = 1_000_000
_SUMS = {
    "all_docs": f"docs * {MICRO}",
    "good_docs": "good",
    "passed": "CASE WHEN vote = 1 THEN good END",
    "judged_good": "CASE WHEN vote <> 0 THEN good END",
    "caught": f"CASE WHEN vote = -1 THEN docs * {MICRO} - good END",
    "judged_bad": f"CASE WHEN vote <> 0 THEN docs * {MICRO} - good END",
}


def _share(top: int, of: int, guess: float) -> float:
    return (top / MICRO + WEIGHT * guess) / (of / MICRO + WEIGHT)


FIRST = RuleModel(PRIOR, [PASS] * len(RULES), [CATCH] * len(RULES))


def fit_rules(measured: DataFrame, rounds: int = ROUNDS) -> RuleModel:
    """The model of all documents' votes. An empty table gives the first guesses.

    Expectation: each pattern's share of good documents under the model so far. Maximisation: the shares that they make, with
    WEIGHT documents' worth of the first guess. A rule is bound to be right: it fails few good documents, and catches a bad one
    at least three times as often as it fails a good one; so bad documents are those that the rules can't explain as good.
    """
    patterns = stored(measured.select(votes().alias("votes")).groupBy("votes").agg(F.count("*").alias("docs")), "patterns")
    model = FIRST
    for _ in range(rounds):
        good = F.col("docs") * F.round(model.posterior(F.col("votes")) * MICRO).cast("long")
        split = patterns.select("docs", good.alias("good"), F.posexplode("votes").alias("rule", "vote"))
        rows = split.groupBy("rule").agg(*(F.expr(f"coalesce(sum({e}), 0)").alias(k) for k, e in _SUMS.items())).orderBy("rule").collect()  # a row a rule
        if not rows:
            break
        passes = [min(MOST_PASS, max(LEAST_PASS, _share(r["passed"], r["judged_good"], PASS))) for r in rows]
        catches = [min(0.99, max(3 * (1 - a), _share(r["caught"], r["judged_bad"], CATCH))) for a, r in zip(passes, rows, strict=True)]
        model = RuleModel(min(0.95, max(0.5, _share(rows[0]["good_docs"], rows[0]["all_docs"], PRIOR))), passes, catches)
    discard(patterns)
    return model


def quality_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the counts, the votes, `quality` (posterior probability of being good), `base_failed` and `kept`.

    kept needs a text that doesn't fail the base rules and has quality of at least a half. Null and empty texts fail; null
    ids stay; equal rows get equal results; an empty table gives an empty one; other columns are left out.
    """
    measured = stored(measures(docs, id_col, text_col), "measures")
    model = fit_rules(measured)
    out = measured.withColumn("votes", votes()).withColumn("quality", model.posterior(F.col("votes"))).withColumn("base_failed", F.expr(BASE_FAILED))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def quality_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts of each document, whether it fails the base rules, its quality and whether it is kept."""
    return quality_votes(docs, id_col, text_col).select(f"`{id_col}`", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "quality", "base_failed", "kept")


def oracle_sql() -> str:
    """quality_digest of documents in DuckDB SQL: windows by their words, rounds by a recursive table of parameters."""
    k = len(RULES)
    cast = ", ".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for bad, good in RULES.values())
    share = lambda top, of, guess: f"((sum({top}) / {MICRO}::DOUBLE + {WEIGHT * guess}::DOUBLE) / (sum({of}) / {MICRO}::DOUBLE + {WEIGHT}::DOUBLE))"
    sums = ", ".join(f"coalesce(sum({e}), 0) AS {name}" for name, e in _SUMS.items())
    posterior = f"""round(1 / (1 + exp(-list_sum(list_prepend(ln(prior) - ln(1 - prior), list_transform(range(1, {k + 1}), lambda i: CASE votes[i]
  WHEN 1 THEN ln(passes[i]) - ln(1 - catches[i]) WHEN -1 THEN ln(1 - passes[i]) - ln(catches[i]) ELSE 0 END))))), 6)"""
    return rf"""
WITH RECURSIVE split AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM split)),
again AS (SELECT rid, i FROM windows SEMI JOIN (SELECT rid, win FROM windows GROUP BY ALL HAVING count(*) > 1) USING (rid, win)),
covered AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM again, range({WINDOW}) AS r(j) GROUP BY rid),
measured AS MATERIALIZED (SELECT rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper,
  len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha, len(list_filter(w, lambda x: regexp_matches(x, '\A\p{{L}}+[.,;:!?]?\z'))) AS n_plain,
  len(list_filter(w, lambda x: regexp_matches(x, '[.!?]\z'))) AS n_ends, len(regexp_extract_all(t, '!')) AS n_shouts FROM split LEFT JOIN covered USING (rid)),
voted AS MATERIALIZED (SELECT *, [{cast}] AS votes FROM measured),
patterns AS MATERIALIZED (SELECT votes, count(*) AS docs FROM voted GROUP BY votes),
fitted(round, prior, passes, catches) AS (
  SELECT 0, {PRIOR}::DOUBLE, list_transform(range({k}), lambda i: {PASS}::DOUBLE), list_transform(range({k}), lambda i: {CATCH}::DOUBLE)
  UNION ALL
  SELECT round + 1, max(p), list(a ORDER BY rule), list(least(0.99::DOUBLE, greatest(3 * (1 - a), b)) ORDER BY rule) FROM (
    SELECT round, rule, least(0.95::DOUBLE, greatest(0.5::DOUBLE, {share("good_docs", "all_docs", PRIOR)})) AS p,
      least({MOST_PASS}::DOUBLE, greatest({LEAST_PASS}::DOUBLE, {share("passed", "judged_good", PASS)})) AS a, {share("caught", "judged_bad", CATCH)} AS b FROM (
      SELECT round, rule, {sums} FROM (
        SELECT round, r.rule, votes[r.rule] AS vote, docs, docs * round({posterior} * {MICRO})::BIGINT AS good FROM fitted, patterns, range(1, {k + 1}) AS r(rule) WHERE round < {ROUNDS})
      GROUP BY round, rule)
    GROUP BY round, rule)
  GROUP BY round),
model AS (SELECT * FROM fitted ORDER BY round DESC LIMIT 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, quality, base_failed, NOT base_failed AND quality >= 0.5 AS kept
FROM (SELECT *, {posterior} AS quality, {BASE_FAILED} AS base_failed FROM voted, model)
"""
