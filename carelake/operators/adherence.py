"""Adherence analytics over dose events: (id, user_id, medicine_id, scheduled_at, status)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from carelake.functions.numbers import half_up, percent
from carelake.functions.times import iso_week, plus_minutes, sunday_of

FINAL = ("TAKEN", "MISSED", "SNOOZED", "SKIPPED")


def count_status(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def _four() -> list[Column]:
    return [count_status(s).alias(s.lower()) for s in FINAL]


def _finalized() -> Column:
    return F.col("taken") + F.col("missed") + F.col("snoozed") + F.col("skipped")


def band(share: Column) -> Column:
    """The names of adherence bands and where they start."""
    return (
        F.when(share >= 90, F.lit("Excellent")).when(share >= 75, F.lit("Good")).when(share >= 50, F.lit("Needs Attention")).otherwise(F.lit("Low"))
    )


def risk(share: Column) -> Column:
    return F.when(share >= 75, F.lit("LOW")).when(share >= 50, F.lit("MEDIUM")).otherwise(F.lit("HIGH"))


def status_counts(doses: DataFrame, *keys: str) -> DataFrame:
    """All counts by status in one pass; the total holds pending doses, the percentage does not."""
    out = doses.groupBy(*keys).agg(F.count("*").alias("total"), *_four(), count_status("PENDING").alias("pending"))
    return out.withColumn("adherence", percent(F.col("taken"), _finalized()))


def daily(doses: DataFrame) -> DataFrame:
    """Per user and UTC day; pending doses don't count and days without others are absent."""
    out = doses.where("status != 'PENDING'").groupBy("user_id", F.to_date("scheduled_at").alias("day")).agg(*_four())
    return out.withColumn("adherence", percent(F.col("taken"), _finalized()))


def by_medicine(doses: DataFrame, medicines: DataFrame) -> DataFrame:
    """Per medicine, with its name where the catalogue knows it."""
    out = doses.where("status != 'PENDING'").groupBy("medicine_id").agg(*_four())
    share = percent(F.col("taken"), _finalized())
    return out.join(medicines, "medicine_id", "left").select(
        "medicine_id",
        F.coalesce("name", F.lit("Unknown")).alias("medicine_name"),
        F.coalesce("form", F.lit("TABLET")).alias("medicine_form"),
        _finalized().alias("total_doses"),
        *[s.lower() for s in FINAL],
        share.alias("adherence"),
        band(share).alias("band"),
        risk(share).alias("risk"),
    )


def weekly(doses: DataFrame) -> DataFrame:
    """Per user and ISO week; the week's start is the Sunday before its first dose."""
    day = F.to_date("scheduled_at")
    out = (
        doses.where("status != 'PENDING'")
        .groupBy("user_id", iso_week(day).alias("week"))
        .agg(F.min(sunday_of(day)).alias("week_start"), *_four())
    )
    return out.withColumn("adherence", percent(F.col("taken"), _finalized()))


def monthly_trend(doses: DataFrame) -> DataFrame:
    """Per user and month, with the change from the month before it that has doses."""
    month = F.to_date(F.trunc(F.to_date("scheduled_at"), "MM"))
    out = doses.where("status != 'PENDING'").groupBy("user_id", month.alias("month")).agg(*_four())
    out = out.withColumn("adherence", percent(F.col("taken"), _finalized()))
    before = F.lag("adherence").over(W.Window.partitionBy("user_id").orderBy("month"))
    change = F.col("adherence") - F.coalesce(before, F.lit(0))
    trend = F.when(change > 0, F.lit("improving")).when(change < 0, F.lit("declining")).otherwise(F.lit("stable"))
    note = F.when(change >= 5, F.lit("up")).when(change <= -5, F.lit("down")).otherwise(F.lit("steady"))
    return out.select("user_id", "month", "adherence", change.alias("change"), trend.alias("trend"), note.alias("note"))


def snapshots(doses: DataFrame) -> DataFrame:
    """A user's snapshot of each day; the scheduled total counts pending doses."""
    out = doses.groupBy("user_id", F.to_date("scheduled_at").alias("day")).agg(F.count("*").alias("scheduled"), *_four())
    return out.withColumn("adherence", percent(F.col("taken"), _finalized()))


def snapshot_average(snaps: DataFrame, since: str) -> DataFrame:
    out = snaps.where(F.col("day") >= F.lit(since).cast("date")).groupBy("user_id").agg(
        F.sum("adherence").alias("s"), F.count("*").alias("days")
    )
    return out.select("user_id", "days", half_up(F.col("s") / F.col("days")).cast("long").alias("average"))


def reasons(doses: DataFrame, reason: Column, top: int = 3) -> DataFrame:
    """Most frequent reasons of missed and skipped doses per user, and how many such doses name one."""
    rows = doses.where("status in ('MISSED', 'SKIPPED')").withColumn("reason", reason)
    totals = rows.groupBy("user_id").agg(F.count("*").alias("eligible"), F.count("reason").alias("recorded"))
    counts = rows.where("reason is not null").groupBy("user_id", "reason").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.Window.partitionBy("user_id").orderBy(F.desc("n"), "reason"))
    best = counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "user_id").select(
        "user_id", "rank", "reason", "n", percent(F.col("recorded"), F.col("eligible")).alias("coverage")
    )


def calendar(doses: DataFrame, first: str, days: int) -> DataFrame:
    """Every user and day from first on, whether it has doses or not."""
    start = F.lit(first).cast("date")
    spine = (
        doses.select("user_id")
        .distinct()
        .withColumn("day", F.explode(F.sequence(start, F.date_add(start, days - 1))))
    )
    counts = doses.groupBy("user_id", F.to_date("scheduled_at").alias("day")).agg(
        F.count("*").alias("total"), count_status("TAKEN").alias("taken")
    )
    zero = F.lit(0).cast("long")
    out = spine.join(counts, ["user_id", "day"], "left").select(
        "user_id", "day", F.coalesce("total", zero).alias("total"), F.coalesce("taken", zero).alias("taken")
    )
    state = (
        F.when(F.col("total") == 0, F.lit("no_doses"))
        .when(F.col("taken") == F.col("total"), F.lit("full"))
        .when(F.col("taken") > 0, F.lit("partial"))
        .otherwise(F.lit("none"))
    )
    return out.withColumn("state", state)


def timeline(doses: DataFrame, day: str) -> DataFrame:
    """A day's summary; here snoozed doses are not final."""
    out = doses.where(F.to_date("scheduled_at") == F.lit(day).cast("date")).groupBy("user_id").agg(
        F.count("*").alias("total"), *_four(), count_status("PENDING").alias("pending")
    )
    done = F.col("taken") + F.col("missed") + F.col("skipped")
    return out.withColumn("finalized", done).withColumn("adherence", percent(F.col("taken"), done))


def report(doses: DataFrame) -> DataFrame:
    """Doctor's report per medicine: snoozed doses are scheduled, not recorded; null where nothing is recorded."""
    out = doses.groupBy("user_id", "medicine_id").agg(
        F.count("*").alias("scheduled"),
        count_status("TAKEN").alias("taken"),
        F.count_if(F.col("status").isin("TAKEN", "MISSED", "SKIPPED")).alias("recorded"),
        F.max("scheduled_at").alias("latest"),
    )
    share = half_up(F.col("taken") * 10000.0 / F.col("recorded")) / 100.0
    return out.withColumn("adherence", F.when(F.col("recorded") > 0, share))


def streaks(doses: DataFrame, today: str, days: int = 90, compat: bool = False) -> DataFrame:
    """Runs of days with a taken dose within the last days: the current one and the best one of each user.

    The current run ends today or yesterday. With compat it has to end today.
    """
    now = F.lit(today).cast("date")
    taken = (
        doses.where("status = 'TAKEN'")
        .select("user_id", F.to_date("scheduled_at").alias("day"))
        .where((F.col("day") <= now) & (F.col("day") > F.date_sub(now, days)))
        .distinct()
    )
    order = W.Window.partitionBy("user_id").orderBy("day")
    runs = (
        taken.withColumn("island", F.date_sub("day", F.row_number().over(order)))
        .groupBy("user_id", "island")
        .agg(F.count("*").alias("n"), F.max("day").alias("last"))
    )
    open_from = now if compat else F.date_sub(now, 1)
    current = F.max(F.when(F.col("last") >= open_from, F.col("n")).otherwise(0))
    return runs.groupBy("user_id").agg(current.cast("long").alias("current"), F.max("n").alias("best"))


def missed_digest(doses: DataFrame, day: str) -> DataFrame:
    """One line for each user with missed doses on a day: the first one and how many others."""
    missed = doses.where((F.col("status") == "MISSED") & (F.to_date("scheduled_at") == F.lit(day).cast("date")))
    out = missed.groupBy("user_id").agg(
        F.count("*").alias("missed"), F.min_by("medicine_id", F.struct("scheduled_at", "id")).alias("first")
    )
    others = F.col("missed") - 1
    label = F.when(others == 0, F.col("first").cast("string")).otherwise(
        F.concat(F.col("first").cast("string"), F.lit(" and "), others.cast("string"), F.when(others == 1, F.lit(" other")).otherwise(F.lit(" others")))
    )
    return out.withColumn("label", label)


def dedupe_by_state(doses: DataFrame, keys: list[str]) -> DataFrame:
    """One dose for each occurrence: the most final state, then the latest, then the smallest id."""
    rank = F.when(F.col("status") == "TAKEN", 5).when(F.col("status") == "SNOOZED", 4).when(F.col("status") == "SKIPPED", 3)
    rank = rank.when(F.col("status") == "MISSED", 2).otherwise(1)
    order = W.Window.partitionBy(*keys).orderBy(rank.desc(), F.col("scheduled_at").desc_nulls_last(), "id")
    return doses.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def overdue_page(doses: DataFrame, now: str, grace: Column, newest: int = 50) -> DataFrame:
    """Of the newest pending doses before now, those past their grace: the limit applies before the filter."""
    at = F.lit(now).cast("timestamp")
    page = doses.where((F.col("status") == "PENDING") & (F.col("scheduled_at") < at))
    page = page.orderBy(F.desc("scheduled_at"), "id").limit(newest)
    return page.where(plus_minutes(F.col("scheduled_at"), grace) < at)


def page(rows: DataFrame, order: list, number: int, size: int, most: int = 100) -> DataFrame:
    """A page of rows with the total number of rows and of pages."""
    size = min(size, most)
    total = rows.agg(F.count("*").alias("total"))
    out = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return out.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))
