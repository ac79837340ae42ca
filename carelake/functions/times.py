"""Calendar and time-zone functions. Timestamps are UTC instants; every function is pure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60
#: Bounds of a grace period in minutes, and its default.
GRACE_LEAST, GRACE_MOST, GRACE_DEFAULT = 15, 1440, 60


def plus_minutes(ts: Column, minutes: Column | int) -> Column:
    minutes = F.lit(minutes) if isinstance(minutes, int) else minutes
    return F.timestamp_seconds(F.unix_micros(ts) / 1e6 + minutes.cast("double") * MINUTE)


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 6e7


def to_instant(wall: Column, zone: Column) -> Column:
    """The instant of a wall time in a zone; null for a wall time that a clock change skips."""
    instant = F.to_utc_timestamp(wall, zone)
    return F.when(F.from_utc_timestamp(instant, zone) == wall, instant)


def local_date(instant: Column, zone: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def day_bounds(day: Column, zone: Column) -> tuple[Column, Column]:
    """First and last millisecond of a local day, of 23, 24 or 25 hours."""
    start = F.to_utc_timestamp(day.cast("timestamp"), zone)
    following = F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)
    return start, F.timestamp_millis(F.unix_millis(following) - 1)


def offset_date(instant: Column, minutes: Column) -> Column:
    """The date at a fixed offset from UTC."""
    return F.to_date(plus_minutes(instant, minutes))


def iso_week(day: Column) -> Column:
    """2026-W09: year and week by the Thursday rule."""
    year = F.extract(F.lit("YEAROFWEEK"), day)
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def sunday_of(day: Column) -> Column:
    return F.date_sub(day, F.dayofweek(day) - 1)


def age_on(born: Column, day: Column) -> Column:
    """Whole years, birthday-aware."""
    early = F.date_format(day, "MMdd") < F.date_format(born, "MMdd")
    return (F.year(day) - F.year(born) - early.cast("int")).cast("long")


def miss_deadline(scheduled: Column, grace: Column, snoozed_until: Column) -> Column:
    """When a dose counts as missed: after a clamped grace period, or later if it is snoozed beyond that."""
    clamped = F.least(F.lit(GRACE_MOST), F.greatest(F.lit(GRACE_LEAST), F.coalesce(grace, F.lit(GRACE_DEFAULT))))
    return F.greatest(plus_minutes(scheduled, clamped), snoozed_until)


def dose_state(status: Column, scheduled: Column, grace: Column, snoozed_until: Column, now: Column) -> Column:
    """Final states stay; then SNOOZED while the snooze lasts, OVERDUE from the deadline, DUE from 15 minutes ahead."""
    deadline = miss_deadline(scheduled, grace, snoozed_until)
    return (
        F.when(status.isin("TAKEN", "MISSED", "SKIPPED"), status)
        .when(now >= deadline, F.lit("OVERDUE"))
        .when((status == "SNOOZED") & (snoozed_until > now), F.lit("SNOOZED"))
        .when(plus_minutes(now, 15) >= scheduled, F.lit("DUE"))
        .otherwise(F.lit("UPCOMING"))
    )


def reminder_state(status: Column, scheduled: Column, grace: Column, now: Column) -> Column:
    """By an unclamped grace period: OVERDUE past it, DUE_NOW within five minutes, else UPCOMING; final states stay."""
    late = minutes_between(scheduled, now)
    return (
        F.when(status != "PENDING", status)
        .when(late > grace, F.lit("OVERDUE"))
        .when(F.abs(late) <= 5, F.lit("DUE_NOW"))
        .otherwise(F.lit("UPCOMING"))
    )


def urgency(days: Column) -> Column:
    return (
        F.when(days <= 0, F.lit("overdue")).when(days <= 2, F.lit("urgent")).when(days <= 5, F.lit("soon")).otherwise(F.lit("upcoming"))
    )


def backoff_minutes(attempts: Column) -> Column:
    """Minutes to wait before the next attempt: doubling, an hour at most."""
    return F.least(F.lit(60.0), F.pow(F.lit(2.0), attempts)).cast("long")


def expiry_boundary(text: Column) -> Column:
    """MM/YY or MM/YYYY to the first day of the month after it; null for anything else."""
    month = F.regexp_extract(text, r"^(0?[1-9]|1[0-2])[/-](\d{4}|\d{2})$", 1)
    year = F.regexp_extract(text, r"^(0?[1-9]|1[0-2])[/-](\d{4}|\d{2})$", 2)
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    first = F.make_date(F.nullif(full, F.lit("")).cast("int"), F.nullif(month, F.lit("")).cast("int"), F.lit(1))
    return F.add_months(first, 1)
