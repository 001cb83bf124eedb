"""Units, currencies, value coercion and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import by_key

# Multipliers of unit words, and US dollars per unit of a currency.
UNITS = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "kt": 1e3, "mt": 1e6, "t": 1.0}
DOLLARS = {"USD": 1.0, "EUR": 1.08, "GBP": 1.27, "JPY": 0.0067, "CHF": 1.12}


def with_unit(value: Column, unit: Column) -> Column:
    """The value in base units; unchanged without a unit, null for an unknown one."""
    return F.when(unit.isNull(), value).otherwise(value * by_key(F.lower(unit), UNITS, None))


def in_dollars(value: Column, currency: Column) -> Column:
    return F.when(currency.isNull(), value).otherwise(value * by_key(F.upper(currency), DOLLARS, None))


def coerced_value(value: Column, percent: Column) -> Column:
    """Not below 0, and not over 100 for a percentage; what isn't finite is null."""
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(ok, F.when(percent, F.least(F.lit(100.0), F.greatest(F.lit(0.0), value))).otherwise(F.greatest(F.lit(0.0), value)))


def ordered_range(low: Column, high: Column) -> tuple[Column, Column]:
    return F.least(low, high), F.greatest(low, high)
