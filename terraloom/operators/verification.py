"""Verification of pillar scores by panels of critics: skip, pass, retry once, refute or leave open.

Everything a panel decides on is one row per key: the first verdict of each critic in each round. So the same operators serve
a table and a stream of verdicts (streaming/verification.py); late and repeated verdicts change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The critics in the order they are heard, and ways of claiming that a new reading of a text can't change.
CRITICS = ["evidence_support", "peer_plausibility", "internal_consistency"]
NOT_RETRYABLE = ["peer_anchor", "dataset_lookup", "peer_ratio_fallback", "coarse_bucket"]
ROUNDS = 2


def _none() -> Column:
    return F.array().cast("array<string>")



def heard(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the verdicts as first_1..first_3, second_1..: the earliest by seq of each round and critic, null where there is none.

    verdicts has round (1 or 2), critic, seq, verdict (pass, refute, abstain), flagged and objection; other rounds and critics
    are left out. Partial minima make the shuffle a row a key and task.
    """
    row = F.struct("seq", "verdict", "flagged", "objection")
    slots = [F.min(F.when((F.col("round") == r) & (F.col("critic") == c), row)).alias(f"{name}_{i}") for r, name in ((1, "first"), (2, "second")) for i, c in enumerate(CRITICS, 1)]
    return verdicts.groupBy(*keys).agg(*slots)


def tally(name: str) -> Column:
    """calls, inconclusive, refuted, flagged, objections and text_objections of a round's slots.

    A critic without an answer abstains. Two equal answers of the first two end the round. Two answers are needed, and two
    refutations refute; the factor that two refuters flag first is the one to retry. text_objections are the first critic's.
    """
    answer = lambda i: F.coalesce(F.col(f"{name}_{i}.verdict"), F.lit("abstain"))
    agreed = (answer(1) != "abstain") & (answer(1) == answer(2))
    refutes = [answer(1) == "refute", answer(2) == "refute", (answer(3) == "refute") & ~agreed]
    answers = sum((F.when(c, 1).otherwise(0) for c in (answer(1) != "abstain", answer(2) != "abstain", (answer(3) != "abstain") & ~agreed)), F.lit(0))
    refuted = sum((r.cast("int") for r in refutes), F.lit(0)) >= 2
    flags = [F.when(r & (F.col(f"{name}_{i}.flagged") != ""), F.col(f"{name}_{i}.flagged")) for i, r in enumerate(refutes, 1)]
    flagged = F.when((flags[0] == flags[1]) | (flags[0] == flags[2]), flags[0]).when(flags[1] == flags[2], flags[1])
    said = [F.when(r, F.col(f"{name}_{i}.objection")) for i, r in enumerate(refutes, 1)]
    told = lambda *c: F.when(refuted, F.array_compact(F.array(*c))).otherwise(_none())
    return F.struct(F.when(agreed, 2).otherwise(len(CRITICS)).alias("calls"), (answers < 2).alias("inconclusive"), refuted.alias("refuted"), F.when(refuted, flagged).alias("flagged"), told(*said).alias("objections"), told(said[0]).alias("text_objections"))


def panels(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the tallies of both rounds."""
    return heard(verdicts, keys).select(*keys, tally("first").alias("first"), tally("second").alias("second"))


def _with_panels(scores: DataFrame, panels: DataFrame, methods: DataFrame, keys: list[str]) -> DataFrame:
    """Scores with their panels (a key without any verdict has silent critics), the flagged factor and its winning claim's method.

    Streamed panels lead the join, so keys without verdicts aren't given then.
    """
    silent = F.struct(F.lit(len(CRITICS)).alias("calls"), F.lit(True).alias("inconclusive"), F.lit(False).alias("refuted"), F.lit(None).cast("string").alias("flagged"), _none().alias("objections"), _none().alias("text_objections"))
    met = panels.join(scores, keys) if panels.isStreaming else scores.join(panels, keys, "left")
    out = met.withColumn("first", F.coalesce("first", silent)).withColumn("second", F.coalesce("second", silent))
    out = out.withColumn("factor", F.col("first.flagged"))
    out = out.join(methods.select(*keys, "factor", F.col("method").alias("factor_method")), [*keys, "factor"], "left")
    out = out.withColumn("asked", (F.col("mode") == "point") & ~F.coalesce(F.col("basis") == "prior", F.lit(False)) & (F.col("label") == "medium"))
    fixed = F.coalesce(F.col("factor_method").isin(NOT_RETRYABLE), F.lit(False))
    return out.withColumn("retried", F.col("asked") & ~F.col("first.inconclusive") & F.col("first.refuted") & F.col("factor").isNotNull() & ~fixed)


def retry_requests(scores: DataFrame, panels: DataFrame, methods: DataFrame, keys: list[str]) -> DataFrame:
    """key, factor, objections of the scores whose claims are to be read again; only objections to the cited text go along."""
    return _with_panels(scores, panels, methods, keys).where("retried").select(*keys, "factor", F.col("first.text_objections").alias("objections"))


def verified(scores: DataFrame, panels: DataFrame, methods: DataFrame, rescored: DataFrame, keys: list[str]) -> DataFrame:
    """Per key verdict, mode, score, low, high, label, needs_review, retried, critic_calls, objections and reason.

    scores has mode, basis (or null), label, score, low, high and needs_review; methods the winning claim's method of each key
    and factor; rescored, for requests of retry_requests that were read again, `same` (the flagged factor's claims read as
    before) and the new mode, label, score, low, high and needs_review. A request without such a row has failed.
    """
    columns = ["mode", "label", "score", "low", "high", "needs_review"]
    again = rescored.select(*keys, "same", *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("read"))
    out = _with_panels(scores, panels, methods, keys).join(again, keys, "left")
    first, second = F.col("first"), F.col("second")
    no_change = F.col("read").isNull() | F.coalesce(F.col("same"), F.lit(False))
    moved = (F.col("new_mode") == "range") | (F.col("new_label") != "medium")
    # The states in the order in which they are left; the first that holds is the last one reached.
    state = (
        F.when(~F.col("asked"), "skipped")
        .when(first["inconclusive"], "open")
        .when(~first["refuted"], "passed")
        .when(~F.col("retried"), "refuted")
        .when(F.col("read").isNull(), "unread")
        .when(no_change, "unchanged")
        .when(moved & (F.col("new_mode") == "point"), "rerouted")
        .when(moved, "thinned")
        .when(second["inconclusive"], "open_again")
        .when(~second["refuted"], "passed_again")
        .otherwise("refuted_again")
    )
    out = out.withColumn("state", state)
    is_ = lambda *names: F.col("state").isin(*names)
    new = is_("rerouted", "thinned", "open_again", "passed_again", "refuted_again")
    down = is_("refuted", "unread", "unchanged", "refuted_again")
    pick = lambda c: F.when(new, F.col(f"new_{c}")).otherwise(F.col(c))
    reasons = {
        "skipped": "not sent to the panel", "open": "fewer than two critics answered", "passed": "most critics pass", "refuted": "refuted without a factor to read again", "unread": "reading again failed",
        "unchanged": "the flagged claim was read as before", "rerouted": "new claims settle it", "thinned": "new claims settle it", "open_again": "fewer than two critics answered again", "passed_again": "most critics pass the new claims", "refuted_again": "refuted again",
    }
    reason = F.element_at(F.create_map(*(F.lit(x) for kv in reasons.items() for x in kv)), F.col("state"))
    verdict = F.when(is_("skipped"), "skipped").when(is_("open", "open_again"), "inconclusive").when(is_("passed"), "passed").when(is_("rerouted", "passed_again"), "passed_after_retry").otherwise("refuted")
    review = F.when(is_("skipped"), F.col("needs_review")).when(is_("rerouted", "thinned"), F.col("new_needs_review")).otherwise(~is_("passed", "passed_again"))
    objections = F.when(is_("refuted_again"), F.concat(first["objections"], second["objections"])).when(is_("skipped", "open", "passed"), _none()).otherwise(first["objections"])
    return out.select(
        *keys,
        verdict.alias("verdict"),
        F.when(down, "range").when(is_("open", "passed", "open_again", "passed_again"), "point").otherwise(pick("mode")).alias("mode"),
        *(pick(c).alias(c) for c in ("score", "low", "high")),
        F.when(down | is_("thinned"), "low").otherwise(pick("label")).alias("label"),
        review.alias("needs_review"),
        F.col("retried"),
        F.when(is_("skipped"), 0).when(is_("open_again", "passed_again", "refuted_again"), first["calls"] + second["calls"]).otherwise(first["calls"]).alias("critic_calls"),
        objections.alias("objections"),
        reason.alias("reason"),
    )


def same_reading(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Per key of `before`, whether the claims there read as in `after`, in any order: by their number and the sum of 64-bit hashes."""
    marks = lambda df, name: df.groupBy(*keys).agg(F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("reading").cast("decimal(38,0)")).alias("sum")).alias(name))
    return marks(before, "__old").join(marks(after, "__new"), keys, "left").select(*keys, F.coalesce(F.col("__old") == F.col("__new"), F.lit(False)).alias("same"))
