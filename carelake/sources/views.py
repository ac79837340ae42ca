"""Domain views of the driver tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"

STATUS = {"purchase": "TAKEN", "error": "MISSED", "click": "SNOOZED", "signup": "SKIPPED", "view": "PENDING"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all cores by a key, before steps that take much work a row; a small file is read by one task."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, key)


def doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dose logs: (id, user_id, medicine_id, scheduled_at, status, value)."""
    events = table(spark, sf_dir, "events")
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("event_type")]
    return events.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("medicine_id"),
        F.col("ts").cast("timestamp").alias("scheduled_at"),
        status.alias("status"),
        "value",
    )


def medicines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a catalogue: (medicine_id, name, form, brand)."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("medicine_id"), F.col("p_name").alias("name"), F.col("p_type").alias("form"), F.col("p_brand").alias("brand")
    )


def grace() -> Column:
    """A grace period for each dose, in minutes, from its id."""
    return F.col("id") % 120


DOSES = """doses AS (
    SELECT event_id AS id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS medicine_id,
           ts AS scheduled_at, CAST(ts AS DATE) AS day,
           CASE event_type WHEN 'purchase' THEN 'TAKEN' WHEN 'error' THEN 'MISSED' WHEN 'click' THEN 'SNOOZED'
                           WHEN 'signup' THEN 'SKIPPED' ELSE 'PENDING' END AS status, value
    FROM events)"""

FOUR = """count(*) FILTER (status = 'TAKEN') AS taken, count(*) FILTER (status = 'MISSED') AS missed,
          count(*) FILTER (status = 'SNOOZED') AS snoozed, count(*) FILTER (status = 'SKIPPED') AS skipped"""


def pct(part: str, whole: str) -> str:
    return (
        f"CAST(CASE WHEN ({whole}) > 0 AND ({part}) > 0 "
        f"THEN least(100, floor(({part}) * 100.0::DOUBLE / ({whole}) + 0.5)) ELSE 0 END AS BIGINT)"
    )


FINAL = "taken + missed + snoozed + skipped"
