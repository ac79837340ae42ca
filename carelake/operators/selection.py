"""Filters, set operations, orders and pages that many features share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def in_optional_range(rows: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows within a range whose ends are texts; an end that is no date is left out, it isn't an error."""
    lo, hi = (F.to_timestamp_ntz(F.lit(x)) if x and _is_date(x) else None for x in (start, end))
    if lo is not None:
        rows = rows.where(F.col(column) >= lo)
    return rows.where(F.col(column) <= hi) if hi is not None else rows


def _is_date(text: str) -> bool:
    from datetime import datetime

    try:
        datetime.fromisoformat(text)
    except ValueError:
        return False
    return True


def checked_range(start: str, end: str, most_days: int = 92) -> str | None:
    """Why a range of dates is refused: `invalid`, `reversed` or `too long`; null where it is fine."""
    from datetime import date

    try:
        lo, hi = date.fromisoformat(start), date.fromisoformat(end)
    except ValueError:
        return "invalid"
    return "reversed" if lo > hi else "too long" if (hi - lo).days > most_days else None


def clamped(value: int | None, least: int, most: int, default: int) -> int:
    return default if value is None else min(max(value, least), most)


def found_in(columns: list[str], needle: str, least_infix: int = 4) -> Column:
    """Whether any column equals or starts with a needle, or holds it where it has least_infix letters; case is ignored."""
    low = needle.lower()
    clauses = [F.lower(c).startswith(low) for c in columns]
    if len(low) >= least_infix:
        clauses += [F.lower(c).contains(low) for c in columns]
    return reduce(Column.__or__, clauses)


def not_expired(column: str, now: Column) -> Column:
    return F.col(column).isNull() | (F.col(column) > now)


def after_cursor(rows: DataFrame, key: str, cursor, n: int) -> DataFrame:
    """The next n rows behind a cursor in order of a unique key."""
    return rows.where(F.col(key) > cursor).orderBy(key).limit(n)


def first_place_last_value(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, with the values of its last row and `place`, the order of its first one."""
    values = [c for c in rows.columns if c not in (key, order)]
    last = [F.max_by(c, order).alias(c) for c in values]
    return rows.groupBy(key).agg(F.min(order).alias("place"), *last)


def nearest_by_prefix(rows: DataFrame, name: str, distance: str, tie: str, letters: int = 16) -> DataFrame:
    """Of rows whose names start with the same letters and digits, the nearest one."""
    key = F.substring(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), 1, letters)
    best = rows.groupBy(key.alias("prefix")).agg(F.min_by(F.struct(*rows.columns), F.struct(distance, tie)).alias("best"))
    return best.select("prefix", "best.*")


def two_lists(rows: DataFrame, group: str, first: Column, order: list, k: int) -> DataFrame:
    """The k first rows of each group: those of the first list in order, then the others."""
    lead = F.when(first, 0).otherwise(1)
    position = F.row_number().over(W.Window.partitionBy(group).orderBy(lead, *order)).cast("long")
    return rows.withColumn("position", position).where(F.col("position") <= k)


def reading_order(rows: DataFrame, page: str, line: str, x: str, tolerance: Column) -> DataFrame:
    """Rows numbered by page in reading order: lines within a tolerance count as one, halves rounding to even."""
    place = F.row_number().over(W.Window.partitionBy(page).orderBy(F.bround(F.col(line) / tolerance), x, line))
    return rows.withColumn("place", place.cast("long"))
