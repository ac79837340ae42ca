"""Queries of sources and sinks: reading by pages with caps, upserts by batches, archive flags."""

import uuid

from pyspark.sql import functions as F

from carelake.lineage import shared_folder
from carelake.plans.registry import query
from carelake.sources import paged as P
from carelake.sources.views import DOSES, doses, table
from carelake.streaming.sinks import VersionedTable


@query("""WITH r AS (SELECT CAST(user_id AS VARCHAR) AS resource, event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4 AS items FROM events),
    o AS (SELECT *, row_number() OVER w AS n, sum(items) OVER w AS total FROM r WINDOW w AS (PARTITION BY resource ORDER BY event_id)),
    s AS (SELECT resource, count(*) AS all_rows, min(n) FILTER (total >= 40 AND n <= 28) AS n, min(total) FILTER (total >= 40 AND n <= 28) AS total, sum(items) FILTER (n <= 28) AS taken FROM o GROUP BY 1)
    SELECT resource, CASE WHEN n IS NOT NULL THEN 40 ELSE CAST(taken AS BIGINT) END AS items, coalesce(n, least(all_rows, 28)) AS source_records,
      CAST(CASE WHEN n IS NOT NULL THEN ceil(n / 7.0) ELSE least(ceil(all_rows / 7.0), 4) END AS BIGINT) AS pages,
      (n IS NOT NULL AND (total > 40 OR all_rows > n)) OR (n IS NULL AND ceil(all_rows / 7.0) > 4) AS truncated,
      CASE WHEN n IS NOT NULL AND (total > 40 OR all_rows > n) THEN 'ITEM_LIMIT_REACHED' WHEN n IS NULL AND ceil(all_rows / 7.0) > 4 THEN 'PAGE_LIMIT_REACHED' END AS stop_reason FROM s""")
def paged_reads(spark, sf_dir):
    """What reading each user's events by pages of 7 gives, up to 40 readings and 4 pages; caps are the feature."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("resource"), "event_id", (F.get_json_object("props", "$.k").cast("long") % 4).alias("items"))
    return P.collected(rows, [F.col("event_id")], F.col("items"), 7, 40, 4)


_STATS = "count(*) AS total, count(*) FILTER (status = 'TAKEN') AS taken, count(*) FILTER (status = 'MISSED') AS missed"


@query(f"""WITH {DOSES} SELECT user_id, day, {_STATS}, CASE WHEN max(scheduled_at) >= TIMESTAMP '2024-01-12 12:00:00' AND min(scheduled_at) < TIMESTAMP '2024-01-12 12:00:00' THEN 'second'
      WHEN min(scheduled_at) < TIMESTAMP '2024-01-12 12:00:00' THEN 'first' ELSE 'second' END AS batch, CASE WHEN min(scheduled_at) < TIMESTAMP '2024-01-12 12:00:00' THEN 'first' ELSE 'second' END AS created_in FROM doses GROUP BY 1, 2""")
def snapshot_upserts(spark, sf_dir):
    """Daily snapshots, merged in two batches of which the second comes twice; its days update those of the first."""
    rows = doses(spark, sf_dir).withColumn("day", F.to_date("scheduled_at"))
    limit = F.lit("2024-01-12 12:00:00").cast("timestamp")

    def snapshot(of, batch):
        taken, missed = F.count_if(F.col("status") == "TAKEN"), F.count_if(F.col("status") == "MISSED")
        sums = of.groupBy("user_id", "day").agg(F.count("*").alias("total"), taken.alias("taken"), missed.alias("missed"))
        return sums.withColumns({"batch": F.lit(batch), "created_in": F.lit(batch)})

    schema = "user_id long, day date, total long, taken long, missed long, batch string, created_in string"
    held = VersionedTable(spark, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}", schema, ["user_id", "day"], 16)
    write = held.writer("daily", update=["total", "taken", "missed", "batch"])
    write(snapshot(rows.where(F.col("scheduled_at") < limit), "first"), 0)
    later = snapshot(rows, "second").join(rows.where(F.col("scheduled_at") >= limit).select("user_id", "day").distinct(), ["user_id", "day"], "left_semi")
    for batch in (1, 1):
        write(later, batch)
    return held.read()


@query("""SELECT p_partkey AS id, p_name AS name, p_type AS kind FROM part WHERE p_size > 10""")
def unarchived(spark, sf_dir):
    """What is left of a catalogue in which some rows have got an archive flag."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.lit(False).alias("archived"))
    held = VersionedTable(spark, f"{shared_folder(spark)}/catalogue-{uuid.uuid4().hex}", "id long, name string, kind string, archived boolean", ["id"], 16)
    held.merge(rows, 0)
    held.archive(part.where("p_size <= 10").select(F.col("p_partkey").alias("id")), 0)
    return held.live().drop("archived")
