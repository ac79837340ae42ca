"""Structured Streaming twins of the vitals rules: idempotent ingest, daily trends and alert cooldowns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ingest(readings: DataFrame, now: Column, late: str = "1 day", tolerance_minutes: int = 5) -> DataFrame:
    """Readings that are not of the future, each idempotency key of a user once within the watermark.

    readings is a stream with recorded_at, user_id and key; rows without a key are told apart by their id. A key that
    comes again later than `late` behind the newest reading counts as new, which bounds the state.
    """
    limit = now + F.make_dt_interval(mins=F.lit(tolerance_minutes))
    known = readings.where(F.col("recorded_at") <= limit)
    known = known.withColumn("once", F.coalesce(F.concat(F.lit("k"), F.col("key").cast("string")), F.concat(F.lit("i"), F.col("id").cast("string"))))
    return known.withWatermark("recorded_at", late).dropDuplicatesWithinWatermark(["user_id", "once"]).drop("once")


def daily_counts(readings: DataFrame, late: str = "1 day") -> DataFrame:
    """Count, questionable count, least and most of each user, metric and UTC day; a day is told once it is over."""
    day = F.window("recorded_at", "1 day")
    out = readings.withWatermark("recorded_at", late).groupBy("user_id", "metric", day.alias("day")).agg(
        F.count("*").alias("n"), F.count_if("questionable").alias("questionable"), F.min("value").alias("least"), F.max("value").alias("most")
    )
    return out.withColumn("day", F.to_date("day.start"))


def cooldown(alerts: DataFrame, critical_minutes: int = 5, other_minutes: int = 30) -> DataFrame:
    """(id, sent) of each alert (id, user_id, metric, critical, at): none until a quiet time after the last one sent.

    The state of a user and metric is the time of the last alert that was sent. Within a batch alerts are taken in
    order of time; batches have to follow each other in time, as those of one device do.
    """

    def decide(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us", tz="UTC") if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        sent = []
        for at, critical in zip(pd.to_datetime(rows["at"], utc=True), rows["critical"]):
            quiet = pd.Timedelta(minutes=critical_minutes if critical else other_minutes)
            ok = last is None or at - last > quiet
            last = at if ok else last
            sent.append(ok)
        state.update((int(last.value // 1000),))
        yield pd.DataFrame({"id": rows["id"].to_numpy(), "sent": sent})

    return alerts.groupBy("user_id", "metric").applyInPandasWithState(
        decide, "id long, sent boolean", "last long", "append", GroupStateTimeout.NoTimeout
    )
