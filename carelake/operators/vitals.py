"""Vitals: daily trends, safety rules, early-warning scores, alert cooldowns and idempotent ingest."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from carelake.functions.numbers import at_places, half_up
from carelake.functions.times import offset_date
from carelake.operators.folds import folded


def daily_trend(readings: DataFrame) -> DataFrame:
    """Per user, metric and local day: count, questionable count, mean to one place, least and most.

    readings holds (user_id, metric, value, recorded_at, offset_minutes, questionable); null values are skipped. Values
    are added up in the order of time, so a mean half-way between two places is rounded alike however rows are dealt.
    """
    rows = readings.where("value is not null").withColumn("day", offset_date(F.col("recorded_at"), F.col("offset_minutes")))
    order = W.Window.partitionBy("user_id", "metric", "day").orderBy("recorded_at", "value")
    so_far = order.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    rows = rows.withColumns({"_place": F.row_number().over(order), "_sum": F.sum(F.col("value").cast("double")).over(so_far)})
    out = rows.groupBy("user_id", "metric", "day").agg(
        F.count("*").alias("n"),
        F.count_if("questionable").alias("questionable"),
        (F.max_by("_sum", "_place") / F.count("*")).alias("mean"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
    )
    return out.withColumn("mean", at_places(F.col("mean"), 1))


def direction(trend: DataFrame, least_points: int = 3, share: float = 0.03) -> DataFrame:
    """Whether a metric rises or falls from its first day to its last one, beyond a share of the first."""
    out = trend.groupBy("user_id", "metric").agg(
        F.count("*").alias("points"), F.min_by("mean", "day").alias("first"), F.max_by("mean", "day").alias("last")
    )
    change = F.col("last") - F.col("first")
    margin = F.greatest(F.abs("first") * share, F.lit(1.0))
    told = (
        F.when(F.col("points") < least_points, F.lit("INSUFFICIENT_DATA"))
        .when(change > margin, F.lit("RISING"))
        .when(change < -margin, F.lit("FALLING"))
        .otherwise(F.lit("STABLE"))
    )
    return out.withColumn("direction", told)


def latest(readings: DataFrame, newest: int = 25) -> DataFrame:
    """The newest reading of each metric among a user's newest readings of all metrics."""
    order = W.Window.partitionBy("user_id").orderBy(F.desc("recorded_at"), "id")
    near = readings.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= newest)
    return near.groupBy("user_id", "metric").agg(F.min_by("value", "rn").alias("value"), F.min_by("id", "rn").alias("id"))


#: Upper ends of the bands of each early-warning measure and their scores; what no band holds scores 0.
NEWS2 = {
    "respiration": [(None, 8, 3), (9, 11, 1), (12, 20, 0), (21, 24, 2), (25, None, 3)],
    "spo2": [(None, 91, 3), (92, 93, 2), (94, 95, 1), (96, None, 0)],
    "systolic": [(None, 90, 3), (91, 100, 2), (101, 110, 1), (111, 219, 0), (220, None, 3)],
    "pulse": [(None, 40, 3), (41, 50, 1), (51, 90, 0), (91, 110, 1), (111, 130, 2), (131, None, 3)],
    "temperature": [(None, 35.0, 3), (35.1, 36.0, 1), (36.1, 38.0, 0), (38.1, 39.0, 1), (39.1, None, 2)],
}


def banded(x: Column, bands) -> Column:
    out = None
    for lo, hi, score in bands:
        inside = F.lit(True)
        inside = inside & (x >= lo) if lo is not None else inside
        inside = inside & (x <= hi) if hi is not None else inside
        out = F.when(inside, score) if out is None else out.when(inside, score)
    return out.otherwise(0)


def news2(rows: DataFrame) -> DataFrame:
    """Early-warning score of rows with the five measures, `oxygen` and `alert` (booleans), and its risk."""
    scores = {name: banded(F.col(name), bands) for name, bands in NEWS2.items()}
    scores["oxygen"] = F.when(F.col("oxygen"), 2).otherwise(0)
    scores["alert"] = F.when(F.col("alert"), 0).otherwise(3)
    total = sum(scores.values(), F.lit(0))
    any_three = F.greatest(*scores.values()) == 3
    risk = F.when(total >= 7, F.lit("HIGH")).when((total >= 5) | any_three, F.lit("MEDIUM")).otherwise(F.lit("LOW"))
    return rows.select("id", total.cast("long").alias("score"), risk.alias("risk"))


def wbgt(temperature: Column, humidity: Column) -> Column:
    vapour = humidity / 100 * 6.105 * F.exp(17.27 * temperature / (237.7 + temperature))
    return 0.567 * temperature + 0.393 * vapour + 3.94


def alarm(sos: Column, heat: Column, pm25: Column, spo2: Column) -> Column:
    return (
        F.when(sos, F.lit("SOS")).when(heat >= 32, F.lit("HEAT")).when(pm25 >= 350, F.lit("SMOG")).when(spo2 < 90, F.lit("HYPOXIA")).otherwise(F.lit("NORMAL"))
    )


def to_mg_dl(mmol: Column) -> Column:
    return half_up(mmol * 180.182) / 10


def ingest(readings: DataFrame, now: str, tolerance_minutes: int = 5) -> DataFrame:
    """Readings that are not of the future, each idempotency key of a user once; null keys never collide."""
    limit = F.lit(now).cast("timestamp") + F.make_dt_interval(mins=F.lit(tolerance_minutes))
    rows = readings.where(F.col("recorded_at") <= limit)
    order = W.Window.partitionBy("user_id", "key").orderBy("recorded_at", "id")
    once = rows.where("key is not null").withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
    return once.unionByName(rows.where("key is null"))


class _Quiet:
    """The last alert that was sent of a user's metric."""

    def __init__(self, critical_minutes: int, other_minutes: int):
        self.last, self.quiet = None, {True: timedelta(minutes=critical_minutes), False: timedelta(minutes=other_minutes)}

    def add(self, id, user_id, metric, critical, at):
        sent = self.last is None or at - self.last > self.quiet[bool(critical)]
        self.last = at if sent else self.last
        return [(id, sent)]

    def done(self):
        return ()


def cooldown(alerts: DataFrame, critical_minutes: int = 5, other_minutes: int = 30) -> DataFrame:
    """Which alerts are sent: none up to and at the end of a quiet time after the last one *sent* for its user and metric.

    alerts holds (id, user_id, metric, critical, at). Each decision rests on the one before, so a user's alerts of one
    metric are folded in order, of which only the last one's time is held.
    """
    rows = alerts.select("id", "user_id", "metric", "critical", "at")
    start = lambda *_: _Quiet(critical_minutes, other_minutes)
    return folded(rows, ["user_id", "metric"], [F.col("at"), F.col("id")], start, "id long, sent boolean")


def safety(metric: Column, value: Column, second: Column, context: Column, questionable: Column) -> Column:
    """A struct of status, severity and reason; the first rule that holds counts, and null values trigger none.

    second is the diastolic pressure, context the meal status of glucose or the activity of a heart rate. A
    questionable reading is never judged. The limits and names are fixed values.
    """

    def told(status: str, severity: str, reason: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(severity).alias("severity"), F.lit(reason).alias("reason"))

    pressure, glucose = metric == "BLOOD_PRESSURE", metric == "BLOOD_GLUCOSE"
    heart, oxygen = metric == "HEART_RATE", metric == "OXYGEN_SATURATION"
    fasting, resting = context == "FASTING", context == "RESTING"
    rules = (
        (questionable, ("VERIFY_READING", "MEDIUM", "UNVERIFIED_SOURCE")),
        (pressure & ((value >= 180) | (second >= 120)), ("URGENT_HELP", "CRITICAL", "BP_VERY_HIGH")),
        (pressure & ((value >= 140) | (second >= 90)), ("RECHECK", "HIGH", "BP_ELEVATED")),
        (pressure & ((value < 90) | (second < 60)), ("RECHECK", "MEDIUM", "BP_LOW")),
        (glucose & (value < 54), ("URGENT_HELP", "CRITICAL", "GLUCOSE_VERY_LOW")),
        (glucose & (value < 70), ("RECHECK", "HIGH", "GLUCOSE_LOW")),
        (glucose & (value >= 300), ("CONTACT_CLINICIAN", "CRITICAL", "GLUCOSE_VERY_HIGH")),
        (glucose & ((fasting & (value >= 126)) | (value >= 200)), ("RECHECK", "HIGH", "GLUCOSE_ELEVATED")),
        (heart & ((value < 40) | (value > 150)), ("URGENT_HELP", "CRITICAL", "HEART_RATE_EXTREME")),
        (heart & resting & ((value < 50) | (value > 100)), ("RECHECK", "MEDIUM", "RESTING_HEART_RATE_OUTSIDE_RANGE")),
        (oxygen & (value <= 88), ("URGENT_HELP", "CRITICAL", "OXYGEN_SATURATION_VERY_LOW")),
        (oxygen & (value <= 92), ("CONTACT_CLINICIAN", "HIGH", "OXYGEN_SATURATION_LOW")),
    )
    out = F.when(rules[0][0], told(*rules[0][1]))
    for holds, names in rules[1:]:
        out = out.when(holds, told(*names))
    return out.otherwise(told("NORMAL", "INFO", "NO_RULE_TRIGGERED"))
