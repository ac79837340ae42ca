"""Schedule and calendar queries."""

from pyspark.sql import functions as F

from carelake.functions import text as X
from carelake.functions import times as T
from carelake.operators import schedules as S
from carelake.plans.registry import query
from carelake.sources.views import DOSES, doses, grace, table

_ZONES = ["Asia/Kolkata", "America/New_York", "UTC", "Europe/Berlin"]
_SQL_ZONES = "['Asia/Kolkata', 'America/New_York', 'UTC', 'Europe/Berlin']"


def _schedules(spark, sf_dir):
    """Customers as schedules: two or three times a day, on all days or three of them, in four zones."""
    key = F.col("c_custkey")
    zones = F.array(*[F.lit(z) for z in _ZONES])
    return table(spark, sf_dir, "customer").select(
        key.alias("schedule_id"),
        key.alias("user_id"),
        (key % 50).alias("medicine_id"),
        F.when(key % 2 == 0, F.array(F.lit("08:00"), F.lit("20:00"))).otherwise(F.array(F.lit("02:30"), F.lit("08:00"), F.lit("13:15"))).alias("times"),
        F.when(key % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(0), F.lit(2), F.lit(5))).alias("days"),
        F.element_at(zones, (key % 4 + 1).cast("int")).alias("zone"),
        F.lit("2026-03-01").cast("date").alias("start_date"),
        F.when(key % 5 == 0, F.lit("2026-03-09").cast("date")).alias("end_date"),
        (key % 11 != 0).alias("is_active"),
        F.when(key % 13 == 0, F.lit("AS_NEEDED")).otherwise(F.lit("DAILY")).alias("frequency"),
        F.when(key % 7 == 0, F.lit(2.0)).otherwise(F.lit(1.0)).alias("doses_per_intake"),
    )


_SCHEDULES = f"""sched AS (SELECT c_custkey AS schedule_id, c_custkey AS user_id, c_custkey % 50 AS medicine_id,
    CASE WHEN c_custkey % 2 = 0 THEN ['08:00', '20:00'] ELSE ['02:30', '08:00', '13:15'] END AS times,
    CASE WHEN c_custkey % 3 = 0 THEN CAST([] AS INTEGER[]) ELSE [0, 2, 5] END AS days,
    {_SQL_ZONES}[c_custkey % 4 + 1] AS zone, CASE WHEN c_custkey % 5 = 0 THEN DATE '2026-03-09' END AS end_date,
    c_custkey % 11 != 0 AS is_active, CASE WHEN c_custkey % 13 = 0 THEN 'AS_NEEDED' ELSE 'DAILY' END AS frequency,
    CASE WHEN c_custkey % 7 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS per FROM customer)"""


@query(f"""WITH {_SCHEDULES}, d AS (SELECT *, CAST(DATE '2026-03-05' + CAST(i AS INTEGER) AS DATE) AS local_day
    FROM sched, range(7) AS r(i) WHERE is_active AND frequency != 'AS_NEEDED'),
    e AS (SELECT schedule_id, user_id, zone, local_day, unnest(times) AS time FROM d
          WHERE (len(days) = 0 OR list_contains(days, CAST(dayofweek(local_day) AS INTEGER))) AND coalesce(local_day <= end_date, true)),
    w AS (SELECT *, CAST(CAST(local_day AS VARCHAR) || ' ' || time || ':00' AS TIMESTAMP) AS wall FROM e)
    SELECT schedule_id, user_id, local_day, time, timezone('UTC', timezone(zone, wall)) AS at FROM w
    WHERE timezone(zone, timezone(zone, wall)) = wall""")
def schedule_expansion(spark, sf_dir):
    return S.occurrences(_schedules(spark, sf_dir), "2026-03-05", 7)


@query(f"""WITH {_SCHEDULES}, r AS (SELECT user_id, medicine_id, CASE WHEN is_active AND frequency != 'AS_NEEDED' THEN len(times) * per *
    (CASE WHEN len(days) = 0 THEN 1.0::DOUBLE ELSE len(days) / 7.0::DOUBLE END) END AS rate FROM sched)
    SELECT user_id, medicine_id, floor(sum(rate) * 100 + 0.5) / 100.0::DOUBLE AS daily FROM r GROUP BY 1, 2""")
def scheduled_daily_usage(spark, sf_dir):
    return S.daily_usage(_schedules(spark, sf_dir))


_NOW = "2024-01-15 12:00:00"


@query(f"""WITH {DOSES}, d AS (SELECT id, status, scheduled_at, CASE WHEN status = 'SNOOZED' THEN scheduled_at + INTERVAL 600 MINUTE END AS until,
    greatest(scheduled_at + to_minutes(CAST(least(1440, greatest(15, id % 120)) AS INTEGER)), CASE WHEN status = 'SNOOZED' THEN scheduled_at + INTERVAL 600 MINUTE END) AS deadline FROM doses)
    SELECT id, deadline, CASE WHEN status IN ('TAKEN', 'MISSED', 'SKIPPED') THEN status WHEN TIMESTAMP '{_NOW}' >= deadline THEN 'OVERDUE'
           WHEN status = 'SNOOZED' AND until > TIMESTAMP '{_NOW}' THEN 'SNOOZED'
           WHEN TIMESTAMP '{_NOW}' + INTERVAL 15 MINUTE >= scheduled_at THEN 'DUE' ELSE 'UPCOMING' END AS state FROM d""")
def dose_states(spark, sf_dir):
    rows = doses(spark, sf_dir)
    until = F.when(F.col("status") == "SNOOZED", T.plus_minutes(F.col("scheduled_at"), 600))
    args = (F.col("scheduled_at"), grace(), until)
    now = F.lit(_NOW).cast("timestamp")
    return rows.select("id", T.miss_deadline(*args).alias("deadline"), T.dose_state(F.col("status"), *args, now).alias("state"))


@query(f"""WITH {DOSES}, d AS (SELECT *, epoch_us(TIMESTAMP '{_NOW}') - epoch_us(scheduled_at) AS late FROM doses)
    SELECT id, CASE WHEN status != 'PENDING' THEN status WHEN late / 6e7 > id % 120 THEN 'OVERDUE'
           WHEN abs(late / 6e7) <= 5 THEN 'DUE_NOW' ELSE 'UPCOMING' END AS state FROM d""")
def reminder_states(spark, sf_dir):
    now = F.lit(_NOW).cast("timestamp")
    return doses(spark, sf_dir).select("id", T.reminder_state(F.col("status"), F.col("scheduled_at"), grace(), now).alias("state"))


@query(f"""WITH {DOSES}, d AS (SELECT id, scheduled_at AS a, scheduled_at + INTERVAL 15 MINUTE AS f,
    scheduled_at + to_minutes(CAST(least(1440, greatest(15, id % 120)) AS INTEGER)) AS deadline FROM doses WHERE status = 'PENDING')
    SELECT id, 'PRIMARY' AS kind, a AS at FROM d WHERE a > TIMESTAMP '{_NOW}'
    UNION ALL SELECT id, 'FOLLOW_UP', f FROM d WHERE f > TIMESTAMP '{_NOW}' AND f < deadline""")
def mobile_reminder_plan(spark, sf_dir):
    return S.reminder_plan(doses(spark, sf_dir).withColumn("grace", grace()), _NOW)


@query("""SELECT o_orderkey AS id, CAST(ceil((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-06-17 06:00:00')) / 8.64e10) AS BIGINT) AS days,
    CASE WHEN days <= 0 THEN 'overdue' WHEN days <= 2 THEN 'urgent' WHEN days <= 5 THEN 'soon' ELSE 'upcoming' END AS urgency FROM orders""")
def refill_urgency(spark, sf_dir):
    now = F.lit("1995-06-17 06:00:00").cast("timestamp")
    days = F.ceil(T.minutes_between(now, F.col("o_orderdate").cast("timestamp")) / 1440).cast("long")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), days.alias("days"))
    return rows.withColumn("urgency", T.urgency(F.col("days")))


@query("""SELECT o_orderkey AS id, CAST(2024 - year(o_orderdate) - (CASE WHEN strftime(o_orderdate, '%m%d') > '0229' THEN 1 ELSE 0 END) AS BIGINT) AS age,
    CAST(greatest(0, 2024 - year(o_orderdate)) AS BIGINT) AS passport_age FROM orders""")
def ages(spark, sf_dir):
    born = F.to_date("o_orderdate")
    today = F.lit("2024-02-29").cast("date")
    plain = F.greatest(F.lit(0), F.year(today) - F.year(born)).cast("long")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), T.age_on(born, today).alias("age"), plain.alias("passport_age")
    )


@query(f"""SELECT event_id AS id, CAST(timezone({_SQL_ZONES}[event_id % 4 + 1], timezone('UTC', ts)) AS DATE) AS local_day,
    CAST(ts + to_minutes(CAST(event_id % 1440 - 720 AS INTEGER)) AS DATE) AS offset_day,
    CAST(least(60.0, pow(2.0, event_id % 9)) AS BIGINT) AS backoff FROM events""")
def zoned_days(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    zone = F.element_at(F.array(*[F.lit(z) for z in _ZONES]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        T.local_date(ts, zone).alias("local_day"),
        T.offset_date(ts, F.col("event_id") % 1440 - 720).alias("offset_day"),
        T.backoff_minutes(F.col("event_id") % 9).alias("backoff"),
    )


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
    SELECT day, timezone('UTC', timezone('America/New_York', day::TIMESTAMP)) AS start,
           timezone('UTC', timezone('America/New_York', CAST(day + 1 AS TIMESTAMP))) - INTERVAL 1 MILLISECOND AS finish FROM d""")
def zoned_day_bounds(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    start, finish = T.day_bounds(F.col("day"), F.lit("America/New_York"))
    return days.select("day", start.alias("start"), finish.alias("finish"))


_PRINTED = """p AS (SELECT o_orderkey AS id, month(o_orderdate) AS m, year(o_orderdate) AS y, o_orderkey % 7 AS kind, o_orderpriority AS word FROM orders),
    t AS (SELECT id, CASE kind WHEN 0 THEN printf('%02d/%02d', m, y % 100) WHEN 1 THEN printf('%d-%d', m, y) WHEN 2 THEN printf('%d/%02d', m + 12, y % 100) WHEN 3 THEN '' WHEN 4 THEN printf('%02d-%02d', m, y % 100) WHEN 5 THEN word END AS t,
      CASE kind WHEN 0 THEN '(01)089(10) ML-' || CAST(id AS VARCHAR) || ' (17)' || printf('%02d%02d', y % 100, m) || '28 Mfg Date: ' || printf('%02d/%d', m, y - 2) WHEN 1 THEN 'B.No: X_' || CAST(id AS VARCHAR) || ' Exp. Date: ' || printf('%02d/%d', m, y)
        WHEN 2 THEN 'Lot No. L' || CAST(id AS VARCHAR) || ' EXPIRY ' || printf('%d-%02d', y, m) WHEN 3 THEN 'batch no ' || CAST(id AS VARCHAR) || ' mfg. ' || printf('%d-%02d', y, m) WHEN 4 THEN word WHEN 5 THEN '(17) 2812 exp:1/27' END AS pack FROM p)"""


def _printed(spark, sf_dir):
    """Dates and packs as they are printed, some of them wrong, from each order."""
    m, y, kind, key = F.month("o_orderdate"), F.year("o_orderdate"), F.col("o_orderkey") % 7, F.col("o_orderkey").cast("string")
    date = (
        F.when(kind == 0, F.format_string("%02d/%02d", m, y % 100)).when(kind == 1, F.format_string("%d-%d", m, y)).when(kind == 2, F.format_string("%d/%02d", m + 12, y % 100)).when(kind == 3, F.lit(""))
        .when(kind == 4, F.format_string("%02d-%02d", m, y % 100)).when(kind == 5, F.col("o_orderpriority"))
    )
    pack = (
        F.when(kind == 0, F.concat(F.lit("(01)089(10) ML-"), key, F.format_string(" (17)%02d%02d28 Mfg Date: %02d/%d", y % 100, m, m, y - 2)))
        .when(kind == 1, F.concat(F.lit("B.No: X_"), key, F.format_string(" Exp. Date: %02d/%d", m, y)))
        .when(kind == 2, F.concat(F.lit("Lot No. L"), key, F.format_string(" EXPIRY %d-%02d", y, m)))
        .when(kind == 3, F.concat(F.lit("batch no "), key, F.format_string(" mfg. %d-%02d", y, m))).when(kind == 4, F.col("o_orderpriority")).when(kind == 5, F.lit("(17) 2812 exp:1/27"))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), date.alias("t"), pack.alias("pack"))


@query(f"""WITH {_PRINTED} SELECT id, coalesce(CASE WHEN regexp_matches(t, '^(0?[1-9]|1[0-2])[/-]([0-9]{{4}}|[0-9]{{2}})$') THEN
    CAST(make_date(CAST(CASE WHEN length(regexp_extract(t, '[0-9]+$')) = 2 THEN '20' ELSE '' END || regexp_extract(t, '[0-9]+$') AS BIGINT),
    CAST(regexp_extract(t, '^[0-9]+') AS BIGINT), 1) + INTERVAL 1 MONTH AS DATE) END, DATE '1970-01-01') AS boundary FROM t""")
def expiry_boundaries(spark, sf_dir):
    """The first day on which what is printed has expired; what can't be read is long over."""
    return _printed(spark, sf_dir).select("id", F.coalesce(T.expiry_boundary(F.col("t")), F.lit("1970-01-01").cast("date")).alias("boundary"))


@query(f"""WITH {_PRINTED}, f AS (SELECT id, nullif(regexp_extract(pack, '\\(10\\)\\s*([A-Za-z0-9_-]+)', 1), '') AS a, nullif(regexp_extract(pack, '\\(17\\)\\s*(\\d{{6}})', 1), '') AS d,
      nullif(regexp_extract(pack, '(?:b(?:atch)?\\.?\\s*no\\.?|lot\\.?\\s*no\\.?|b\\.no\\.?)\\s*[:.-]?\\s*([A-Za-z0-9_-]+)', 1, 'i'), '') AS b,
      nullif(regexp_extract(pack, '(?:exp(?:iry)?\\.?\\s*(?:date)?)\\s*[:.-]?\\s*(\\d{{1,2}}[/-]\\d{{2,4}}|\\d{{4}}[/-]\\d{{1,2}})', 1, 'i'), '') AS e,
      nullif(regexp_extract(pack, '(?:mfg\\.?\\s*(?:date)?)\\s*[:.-]?\\s*(\\d{{1,2}}[/-]\\d{{2,4}}|\\d{{4}}[/-]\\d{{1,2}})', 1, 'i'), '') AS m FROM t)
    SELECT id, coalesce(a, b) AS batch, coalesce('20' || d[1:2] || '-' || d[3:4] || '-' || d[5:6], e) AS expiry, m AS made FROM f""")
def packaging_data(spark, sf_dir):
    """Batches and dates out of codes and print."""
    return _printed(spark, sf_dir).select("id", X.packaging(F.col("pack")).alias("p")).select("id", "p.*")
