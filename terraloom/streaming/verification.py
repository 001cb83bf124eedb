"""Verification over a stream of verdicts: the batch operators, run in update mode.

The state of a key is its six verdict slots (two rounds of three critics), so it doesn't grow with repeated verdicts. Each
batch gives the present outcome of the keys it touches; the last one given for a key is what the batch operators give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import verification


def verified_stream(scores: DataFrame, verdicts: DataFrame, methods: DataFrame, rescored: DataFrame, keys: list[str]) -> DataFrame:
    """verification.verified of scores (a table) and of the verdicts that have come in so far (a stream), for keys with verdicts.

    Start it in update mode. rescored may hold rows of requests that haven't been made: they wait for theirs.
    """
    return verification.verified(scores, verification.panels(verdicts, keys), methods, rescored, keys)
