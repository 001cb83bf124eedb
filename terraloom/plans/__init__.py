"""Named queries over the given tables, each with the SQL that its result must equal."""

from . import anchors, answers, calibration, clustering, places, press, public_records, records, registers, relational, reports, review, rules, scores, texts, validation, windows  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
