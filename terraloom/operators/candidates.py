"""Windows of long texts around the terms of each factor, and the best prediction over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import table_of_contents

# Characters kept on each side of a term, texts long enough to be cut, and the length that tells windows apart.
RADIUS, LEAST_LENGTH, SAME_PREFIX = 300, 400, 200
#: Terms of one automaton. More terms make more automata, each of which reads the text once.
MOST_TERMS = 200_000

WINDOWS = "array<struct<factor: string, pillar: string, start: int, end: int, term: string, window: string>>"

Hit = tuple[int, int, int, int]  # place of the term list, start, order of the term in it, end


def folded(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _is_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


class TermFinder:
    """All terms of all lists in one pass over a text: whole words, in any case, no overlaps of a term with itself."""

    def __init__(self, lists: list[list[str]]):
        owners: dict[str, list[tuple[int, int]]] = {}
        for place, terms in enumerate(lists):
            for order, term in enumerate(dict.fromkeys(folded(t) for t in terms if t)):
                owners.setdefault(term, []).append((place, order))
        words = sorted(owners)
        self.automata = []
        for at in range(0, len(words), MOST_TERMS):
            automaton = ahocorasick.Automaton()
            for word in words[at : at + MOST_TERMS]:
                automaton.add_word(word, (word, owners[word]))
            automaton.make_automaton()
            self.automata.append(automaton)

    def hits(self, text: str) -> list[Hit]:
        low, out = folded(text), []
        for automaton in self.automata:
            reached: dict[str, int] = {}
            for last, (word, owners) in automaton.iter(low):
                start, end = last + 1 - len(word), last + 1
                bounded = _is_word(low, start - 1) != _is_word(low, start) and _is_word(low, end - 1) != _is_word(low, end)
                if bounded and start >= reached.get(word, 0):
                    reached[word] = end
                    out += [(place, start, order, end) for place, order in owners]
        return sorted(out)


def windows_of(text: str, hits: list[Hit], radius: int = RADIUS) -> Iterator[tuple[int, int, int, str]]:
    """(list, start, end, first term) of the windows around a list's hits, those that touch merged."""
    open_: list | None = None
    for place, start, _, end in hits:
        low, high = max(0, start - radius), min(len(text), end + radius)
        if open_ and open_[0] == place and low <= open_[2]:
            open_[2] = max(open_[2], high)
            continue
        if open_:
            yield tuple(open_)
        open_ = [place, low, high, text[start:end]]
    if open_:
        yield tuple(open_)


def candidate_windows(text: Column, lists: list[tuple[str, str, list[str]]], least: int = LEAST_LENGTH) -> Column:
    """Windows around terms, in the order of the (factor, pillar, terms) lists, then of the text.

    Of windows that begin with the same 200 characters the first stays. Texts shorter than `least`, empty ones and those
    without a term have none; a null text has null.
    """

    @F.pandas_udf(WINDOWS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = TermFinder([terms for _, _, terms in lists])
        for texts in batches:
            yield texts.map(lambda t: None if t is None else list(cut(finder, t)))

    def cut(finder: TermFinder, t: str) -> Iterator[dict]:
        seen = set()
        for place, start, end, term in windows_of(t, finder.hits(t) if len(t) >= least else []):
            window = t[start:end].strip()
            if window[:SAME_PREFIX] not in seen:
                seen.add(window[:SAME_PREFIX])
                yield {"factor": lists[place][0], "pillar": lists[place][1], "start": start, "end": end, "term": term, "window": window}

    return found(text)


def gated_prediction(docs: DataFrame, text: str, lists: list[tuple[str, str, list[str]]], predict: Callable[[Column], Column]) -> DataFrame:
    """docs with `prediction` (label, probability, abstained, factor).

    predict makes a struct of label, probability and abstained of a text. The most probable window that doesn't abstain
    wins, the earliest of equals; the whole text is the floor, and wins a tie (its factor is null). A table of contents is
    no evidence, whatever its words are.
    """
    cut = docs.withColumn("__windows", candidate_windows(F.col(text), lists))
    row = lambda p, order, factor: F.struct((~p["abstained"]).alias("sure"), p["probability"].alias("probability"), order.cast("int").alias("order"), p["label"].alias("label"), factor.alias("factor"))
    tried = F.transform(F.coalesce("__windows", F.array().cast(WINDOWS)), lambda w, i: row(predict(w["window"]), -1 - i, w["factor"]))
    whole = row(predict(F.coalesce(text, F.lit(""))), F.lit(0), F.lit(None).cast("string"))
    best = F.array_max(F.concat(F.filter(tried, lambda p: p["sure"]), F.array(whole)))
    prose = cut.withColumn("__best", best)
    listed = F.coalesce(table_of_contents(F.col(text)), F.lit(False))
    given = F.struct(F.when(listed, "no_evidence").otherwise(F.col("__best.label")).alias("label"), F.when(listed, 1.0).otherwise(F.col("__best.probability")).alias("probability"), (listed | ~F.col("__best.sure")).alias("abstained"), F.when(~listed, F.col("__best.factor")).alias("factor"))
    return prose.withColumn("prediction", given).drop("__windows", "__best")
