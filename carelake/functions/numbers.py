"""Rounding and percentages as the domain defines them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def percent(part: Column, whole: Column) -> Column:
    """A whole percentage from 0 to 100; 0 where there is nothing to count."""
    share = F.least(F.lit(100), half_up(part * 100.0 / whole))
    return F.when((whole > 0) & (part > 0), share).otherwise(0).cast("long")


def at_places(x: Column, places: int) -> Column:
    """Rounded to so many decimals, halves towards plus infinity."""
    return half_up(x * 10.0**places) / 10.0**places
