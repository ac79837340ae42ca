"""Report snapshots: what is saved about each patient, section by section, as one document for each."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from carelake.functions.numbers import half_up

SECTIONS = ("medications", "adherence", "allergies", "safety", "refills", "vitals")
#: The most items that a report lists; a section that has more says so. A section that is asked for with
#: `whole` lists all.
MEDICINES, DOSES, ALLERGIES, FINDINGS, VITALS, SCHEDULES, LINKED = 200, 20_000, 100, 100, 5_000, 20, 20
DAYS = 366
SEVERITY = ("LOW", "MODERATE", "HIGH", "CRITICAL")


def clean(c: Column, limit: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, limit)


def optional(c: Column, limit: int) -> Column:
    return F.when(F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")) != "", clean(c, limit))


def iso(c: Column) -> Column:
    """A point in time as text, in UTC with milliseconds."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_range(start: str, end: str) -> tuple[Column, Column]:
    """The first and the last millisecond of a range of UTC days; reversed and too long ones raise."""
    from datetime import date

    first, last = date.fromisoformat(start), date.fromisoformat(end)
    if first > last:
        raise ValueError("Start date must be before end date.")
    if (last - first).days + 1 > DAYS:
        raise ValueError(f"Report date range cannot exceed {DAYS} days.")
    return F.lit(f"{start} 00:00:00").cast("timestamp"), F.lit(f"{end} 23:59:59.999").cast("timestamp")


def listed(rows: DataFrame, order: list[Column], most: int | None, item: Column, latest: Column, name: str) -> DataFrame:
    """(user_id, name) with the first items of each user, how many they are, whether there are more, and the latest time.

    Only the first `most` rows of a user are brought together, so a user with very many has no larger group; without
    `most` all are. The latest time is of the rows that are read, which is one more than are listed.
    """
    most = sys.maxsize - 1 if most is None else most
    place = F.row_number().over(W.Window.partitionBy("user_id").orderBy(*order))
    read = rows.withColumns({"_place": place, "_item": item, "_latest": latest}).where(F.col("_place") <= most + 1)
    within = F.when(F.col("_place") <= most, F.struct("_place", "_item"))
    held = F.transform(F.array_sort(F.collect_list(within)), lambda x: x["_item"])
    sums = read.groupBy("user_id").agg(held.alias("items"), F.max("_place").alias("n"), iso(F.max("_latest")).alias("last"))
    told = F.struct(
        F.col("items"), F.size("items").alias("total"), (F.col("n") > most).alias("truncated"), F.col("last").alias("lastUpdatedAt")
    )
    return sums.select("user_id", told.alias(name))


def medications(medicines: DataFrame, schedules: DataFrame, whole: bool = False) -> DataFrame:
    """medicines: user_id, medicine_id, name, generic, composition, form, strength, instructions, is_active, updated_at;
    schedules: medicine_id, schedule_id, frequency, times, days, doses, unit, start, end, timezone, is_active."""
    plan = F.struct(
        "frequency", F.slice("times", 1, 12).alias("timesOfDay"), F.slice("days", 1, 7).alias("daysOfWeek"), F.col("doses").alias("dosesPerIntake"), clean(F.col("unit"), 40).alias("unit"),
        iso(F.col("start")).alias("startDate"), iso(F.col("end")).alias("endDate"), clean(F.col("timezone"), 80).alias("timezone"),
    )
    place = F.row_number().over(W.Window.partitionBy("medicine_id").orderBy("start", "schedule_id"))
    first = schedules.where("is_active").withColumn("_place", place).where(F.col("_place") <= SCHEDULES)
    plans = first.groupBy("medicine_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", plan.alias("plan")))), lambda x: x["plan"]).alias("plans"))
    rows = medicines.where("is_active").join(plans, "medicine_id", "left")
    none = F.array().cast(dict(plans.dtypes)["plans"])
    item = F.struct(
        clean(F.col("name"), 160).alias("name"), optional(F.col("generic"), 240).alias("genericName"), optional(F.col("composition"), 500).alias("composition"), F.col("form"),
        optional(F.col("strength"), 80).alias("strength"), optional(F.col("instructions"), 2000).alias("instructions"), F.coalesce("plans", none).alias("schedules"), iso(F.col("updated_at")).alias("lastUpdatedAt"),
    )
    return listed(rows, [F.col("name"), F.col("medicine_id")], None if whole else MEDICINES, item, F.col("updated_at"), "medications")


def _counts() -> list[Column]:
    status = F.col("status")
    return [F.count_if(status == s.upper()).alias(s) for s in ("taken", "missed", "skipped", "snoozed", "pending")]


def _percent() -> Column:
    n = F.col("taken") + F.col("missed") + F.col("skipped")
    return F.when(n > 0, half_up(F.col("taken") / n * 10_000) / 100)


def adherence(doses: DataFrame, start: Column, end: Column, whole: bool = False) -> DataFrame:
    """doses: user_id, dose_id, name, status, scheduled_at, updated_at. Medicines stand in the order of their first dose.

    Taken doses count against taken, missed and skipped ones; snoozed and pending ones are told beside it.
    """
    most = sys.maxsize - 1 if whole else DOSES
    rows = doses.where(F.col("scheduled_at").between(start, end))
    place = F.row_number().over(W.Window.partitionBy("user_id").orderBy("scheduled_at", "dose_id"))
    rows = rows.withColumn("_place", place).where(F.col("_place") <= most + 1)
    listed_rows = rows.where(F.col("_place") <= most)
    each = listed_rows.groupBy("user_id", "name").agg(*_counts(), F.min("_place").alias("first"))
    item = F.struct(
        "first", clean(F.col("name"), 160).alias("name"), "taken", "missed", "skipped", (F.col("taken") + F.col("missed") + F.col("skipped")).alias("recordedDoses"), _percent().alias("adherencePercent")
    )
    by = each.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("first")).alias("byMedicine"))
    sums = listed_rows.groupBy("user_id").agg(F.count("*").alias("totalScheduled"), *_counts(), iso(F.max("updated_at")).alias("last"))
    more = rows.groupBy("user_id").agg((F.max("_place") > most).alias("truncated"))
    told = F.struct(
        "totalScheduled", "taken", "missed", "skipped", "snoozed", "pending", (F.col("taken") + F.col("missed") + F.col("skipped")).alias("recordedDoses"), _percent().alias("adherencePercent"),
        "byMedicine", "truncated", F.col("last").alias("lastUpdatedAt"),
    )
    return sums.join(by, "user_id").join(more, "user_id").select("user_id", told.alias("adherence"))


def allergies(rows: DataFrame, whole: bool = False) -> DataFrame:
    """rows: user_id, allergy_id, substance, category, criticality, reaction, verification, source, clinical, updated_at."""
    item = F.struct(
        clean(F.col("substance"), 200).alias("substance"), "category", "criticality", optional(F.col("reaction"), 500).alias("reaction"), F.col("verification").alias("verificationStatus"), "source",
        iso(F.col("updated_at")).alias("lastUpdatedAt"),
    )
    return listed(rows.where("clinical = 'ACTIVE'"), [F.col("substance"), F.col("allergy_id")], None if whole else ALLERGIES, item, F.col("updated_at"), "allergies")


def safety(findings: DataFrame, whole: bool = False) -> DataFrame:
    """findings: user_id, finding_id, severity, status, title, summary, medicines, detected_at; the most severe first."""
    rows = findings.where(F.col("status").isin("OPEN", "ACKNOWLEDGED"))
    names = F.transform(F.slice("medicines", 1, LINKED), lambda m: clean(m, 160))
    item = F.struct("severity", "status", clean(F.col("title"), 200).alias("title"), clean(F.col("summary"), 2000).alias("summary"), names.alias("medicines"), iso(F.col("detected_at")).alias("lastDetectedAt"))
    grade = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("severity"))
    return listed(rows, [F.desc(grade), F.desc("detected_at"), F.asc("finding_id")], None if whole else FINDINGS, item, F.col("detected_at"), "safety")


def refills(medicines: DataFrame, logs: DataFrame, whole: bool = False) -> DataFrame:
    """medicines also with unit, remaining, threshold; logs: medicine_id, created_at, finish, reminder, updated_at."""
    last = logs.groupBy("medicine_id").agg(F.max_by(F.struct("finish", "reminder", "updated_at"), "created_at").alias("log"))
    rows = medicines.where("is_active").join(last, "medicine_id", "left")
    left, threshold = F.col("remaining"), F.col("threshold")
    status = F.when(left.isNull(), "UNKNOWN").when(left <= 0, "OUT").when(left <= threshold, "LOW").otherwise("ADEQUATE")
    changed = F.greatest("updated_at", F.col("log.updated_at"))
    item = F.struct(
        clean(F.col("name"), 160).alias("medicineName"), optional(F.col("strength"), 80).alias("strength"), left.alias("remainingQuantity"), optional(F.col("unit"), 40).alias("unit"),
        threshold.alias("refillThreshold"), status.alias("status"), iso(F.col("log.finish")).alias("expectedFinishDate"), iso(F.col("log.reminder")).alias("refillReminderDate"), iso(changed).alias("lastUpdatedAt"),
    )
    place = F.row_number().over(W.Window.partitionBy("user_id").orderBy("name", "medicine_id"))
    # The latest time is of the listed medicines alone here.
    shown = rows.withColumn("_shown", F.lit(True) if whole else place <= MEDICINES)
    return listed(shown, [F.col("name"), F.col("medicine_id")], None if whole else MEDICINES, item, F.when(F.col("_shown"), changed), "refills")


def vitals(readings: DataFrame, start: Column, end: Column, whole: bool = False) -> DataFrame:
    """readings: user_id, reading_id, metric, value, unit, recorded_at, received_at, source, quality, flags; newest first."""
    rows = readings.where(F.col("recorded_at").between(start, end))
    item = F.struct(
        F.col("metric").alias("metricType"), "value", clean(F.col("unit"), 30).alias("unit"), iso(F.col("recorded_at")).alias("recordedAt"), iso(F.col("received_at")).alias("receivedAt"), "source", "quality",
        F.slice("flags", 1, 20).alias("qualityFlags"),
    )
    return listed(rows, [F.desc("recorded_at"), F.asc("reading_id")], None if whole else VITALS, item, F.col("received_at"), "vitals")


def compose(patients: DataFrame, sections: list[DataFrame], start: Column, end: Column) -> DataFrame:
    """(user_id, snapshot): one JSON document for each active patient, with the given sections in their fixed order.

    patients: user_id, email, first_name, last_name, birth, blood, conditions, has_profile, is_active. A patient without
    rows in a section has an empty one; sections that aren't given aren't there. Each section joins on the patient, with
    one row on both sides.
    """
    named = optional(F.concat_ws(" ", F.coalesce("first_name", F.lit("")), F.coalesce("last_name", F.lit(""))), 120)
    email = clean(F.col("email"), 254)
    shown = F.coalesce(F.when(F.col("has_profile"), F.coalesce(named, F.lit(""))), email, F.lit("Patient"))
    conditions = F.transform(F.slice(F.coalesce("conditions", F.array().cast("array<string>")), 1, 50), lambda c: clean(c, 120))
    patient = F.struct(shown.alias("displayName"), email.alias("contactEmail"), iso(F.col("birth")).alias("dateOfBirth"), F.col("blood").alias("bloodGroup"), conditions.alias("conditions"))
    rows = patients.where("is_active").select("user_id", patient.alias("patient"))
    given = {s.columns[1]: s for s in sections}
    wanted = [n for n in SECTIONS if n in given]
    for name in wanted:
        section = given[name]
        empty = _empty(section.schema[name].dataType)
        rows = rows.join(section, "user_id", "left").withColumn(name, F.coalesce(F.col(name), empty))
    whole = F.struct(
        F.lit(1).alias("version"), F.struct(iso(start).alias("start"), iso(end).alias("end")).alias("range"), F.array(*[F.lit(n.upper()) for n in wanted]).cast("array<string>").alias("sections"), "patient", *wanted
    )
    return rows.select("user_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("snapshot"))


def _empty(kind) -> Column:
    """A section of a patient without rows: no items, counts of 0, nothing truncated, no time."""
    def zero(field) -> Column:
        told = field.dataType.simpleString()
        if told.startswith("array"):
            return F.array().cast(field.dataType)
        if told == "boolean":
            return F.lit(False)
        return F.lit(0).cast(field.dataType) if told in ("int", "bigint") else F.lit(None).cast(field.dataType)

    return F.struct(*[zero(f).alias(f.name) for f in kind.fields])
