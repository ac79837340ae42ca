"""Expansion of recurring schedules into occurrences, and reminder plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions.times import miss_deadline, plus_minutes, to_instant


def occurrences(schedules: DataFrame, first: str, days: int) -> DataFrame:
    """Occurrences of active schedules on the local days from first on: (schedule_id, user_id, local_day, time, at).

    schedules holds (schedule_id, user_id, times array<HH:MM>, days array<int, 0 = Sunday>, zone, start_date,
    end_date, is_active, frequency). No listed day means every day; AS_NEEDED schedules have no occurrences, nor
    do wall times that a clock change skips.
    """
    start = F.lit(first).cast("date")
    spine = schedules.where("is_active and frequency != 'AS_NEEDED'").withColumn(
        "local_day", F.explode(F.sequence(start, F.date_add(start, days - 1)))
    )
    weekday = F.dayofweek("local_day") - 1
    wanted = (F.size("days") == 0) | F.array_contains("days", weekday)
    inside = (F.col("local_day") >= F.col("start_date")) & F.coalesce(F.col("local_day") <= F.col("end_date"), F.lit(True))
    each = spine.where(wanted & inside).withColumn("time", F.explode(F.array_distinct("times")))
    wall = F.to_timestamp(F.concat(F.col("local_day").cast("string"), F.lit(" "), "time"), "yyyy-MM-dd HH:mm")
    out = each.withColumn("at", to_instant(wall, F.col("zone"))).where("at is not null")
    return out.select("schedule_id", "user_id", "local_day", "time", "at")


def new_occurrences(made: DataFrame, existing: DataFrame) -> DataFrame:
    """Insert-ignore: what existing doesn't hold for (schedule_id, at)."""
    return made.join(existing.select("schedule_id", "at").distinct(), ["schedule_id", "at"], "left_anti")


def reminder_plan(doses: DataFrame, now: str) -> DataFrame:
    """A primary reminder for each open dose, and a follow-up 15 minutes later unless it is late or past."""
    at = F.lit(now).cast("timestamp")
    follow = plus_minutes(F.col("scheduled_at"), 15)
    deadline = miss_deadline(F.col("scheduled_at"), F.col("grace"), F.lit(None).cast("timestamp"))
    plan = F.array_compact(
        F.array(
            F.when(F.col("scheduled_at") > at, F.struct(F.lit("PRIMARY").alias("kind"), F.col("scheduled_at").alias("at"))),
            F.when((follow > at) & (follow < deadline), F.struct(F.lit("FOLLOW_UP").alias("kind"), follow.alias("at"))),
        )
    )
    return doses.where("status = 'PENDING'").select("id", F.explode(plan).alias("p")).select("id", "p.kind", "p.at")


def daily_usage(schedules: DataFrame) -> DataFrame:
    """Units a user's schedules of a medicine use a day, to two places; null where none counts."""
    valid = F.array_distinct(F.filter("days", lambda d: (d >= 0) & (d <= 6)))
    share = F.when(F.size("days") == 0, F.lit(1.0)).otherwise(F.size(valid) / 7.0)
    rate = F.when(
        F.col("is_active") & (F.col("frequency") != "AS_NEEDED"), F.size("times") * F.col("doses_per_intake") * share
    )
    out = schedules.groupBy("user_id", "medicine_id").agg(F.sum(rate).alias("r"))
    return out.select("user_id", "medicine_id", (F.floor(F.col("r") * 100 + 0.5) / 100.0).alias("daily"))
