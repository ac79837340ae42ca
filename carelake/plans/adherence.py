"""Adherence queries over events as dose logs."""

from pyspark.sql import functions as F

from carelake.operators import adherence as A
from carelake.plans.registry import query
from carelake.sources.views import DOSES, FINAL, FOUR, NOW, doses, grace, medicines, pct, table

_TODAY = "2024-01-30"


@query(f"""WITH {DOSES}, g AS (SELECT user_id, count(*) AS total, {FOUR},
    count(*) FILTER (status = 'PENDING') AS pending FROM doses GROUP BY user_id)
    SELECT *, {pct("taken", FINAL)} AS adherence FROM g""")
def dose_status_counts(spark, sf_dir):
    return A.status_counts(doses(spark, sf_dir), "user_id")


@query(f"""WITH {DOSES}, g AS (SELECT user_id, day, {FOUR} FROM doses WHERE status != 'PENDING' GROUP BY user_id, day)
    SELECT *, {pct("taken", FINAL)} AS adherence FROM g""")
def adherence_daily(spark, sf_dir):
    return A.daily(doses(spark, sf_dir))


@query(f"""WITH {DOSES}, g AS (SELECT medicine_id, {FOUR} FROM doses WHERE status != 'PENDING' GROUP BY 1),
    h AS (SELECT *, {pct("taken", FINAL)} AS adherence FROM g)
    SELECT medicine_id, coalesce(p_name, 'Unknown') AS medicine_name, coalesce(p_type, 'TABLET') AS medicine_form,
           {FINAL} AS total_doses, taken, missed, snoozed, skipped, adherence,
           CASE WHEN adherence >= 90 THEN 'Excellent' WHEN adherence >= 75 THEN 'Good'
                WHEN adherence >= 50 THEN 'Needs Attention' ELSE 'Low' END AS band,
           CASE WHEN adherence >= 75 THEN 'LOW' WHEN adherence >= 50 THEN 'MEDIUM' ELSE 'HIGH' END AS risk
    FROM h LEFT JOIN part ON p_partkey = medicine_id""")
def adherence_by_medicine(spark, sf_dir):
    return A.by_medicine(doses(spark, sf_dir), medicines(spark, sf_dir))


_WEEK = "CAST(isoyear(day) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(day) AS VARCHAR), 2, '0')"


@query(f"""WITH {DOSES}, g AS (SELECT user_id, {_WEEK} AS week,
    min(CAST(day - CAST(dayofweek(day) AS INTEGER) AS DATE)) AS week_start, {FOUR}
    FROM doses WHERE status != 'PENDING' GROUP BY 1, 2) SELECT *, {pct("taken", FINAL)} AS adherence FROM g""")
def adherence_weekly(spark, sf_dir):
    return A.weekly(doses(spark, sf_dir))


@query(f"""WITH {DOSES}, g AS (SELECT user_id, CAST(date_trunc('month', day) AS DATE) AS month, {FOUR}
    FROM doses WHERE status != 'PENDING' GROUP BY 1, 2), h AS (SELECT *, {pct("taken", FINAL)} AS adherence FROM g),
    d AS (SELECT user_id, month, adherence,
          adherence - coalesce(lag(adherence) OVER (PARTITION BY user_id ORDER BY month), 0) AS change FROM h)
    SELECT *, CASE WHEN change > 0 THEN 'improving' WHEN change < 0 THEN 'declining' ELSE 'stable' END AS trend,
           CASE WHEN change >= 5 THEN 'up' WHEN change <= -5 THEN 'down' ELSE 'steady' END AS note FROM d""")
def adherence_monthly_trend(spark, sf_dir):
    return A.monthly_trend(doses(spark, sf_dir))


@query(f"""WITH {DOSES}, g AS (SELECT user_id, day, {FOUR} FROM doses GROUP BY user_id, day),
    s AS (SELECT *, {pct("taken", FINAL)} AS adherence FROM g WHERE day >= DATE '2024-01-15')
    SELECT user_id, count(*) AS days, CAST(floor(sum(adherence) / count(*)::DOUBLE + 0.5) AS BIGINT) AS average
    FROM s GROUP BY user_id""")
def snapshot_averages(spark, sf_dir):
    return A.snapshot_average(A.snapshots(doses(spark, sf_dir)), "2024-01-15")


@query(f"""WITH {DOSES}, r AS (SELECT *, CASE medicine_id % 4 WHEN 0 THEN 'FORGOT' WHEN 1 THEN 'SIDE_EFFECT' WHEN 2 THEN 'COST' END AS reason
    FROM doses WHERE status IN ('MISSED', 'SKIPPED')),
    t AS (SELECT user_id, count(*) AS eligible, count(reason) AS recorded FROM r GROUP BY 1),
    c AS (SELECT user_id, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, reason) AS rank FROM c)
    SELECT user_id, rank, reason, n, {pct("recorded", "eligible")} AS coverage FROM k JOIN t USING (user_id) WHERE rank <= 2""")
def barrier_summary(spark, sf_dir):
    reason = F.when(F.col("medicine_id") % 4 == 0, F.lit("FORGOT")).when(F.col("medicine_id") % 4 == 1, F.lit("SIDE_EFFECT"))
    return A.reasons(doses(spark, sf_dir), reason.when(F.col("medicine_id") % 4 == 2, F.lit("COST")), 2)


@query(f"""WITH {DOSES}, u AS (SELECT DISTINCT user_id FROM doses),
    s AS (SELECT user_id, CAST(DATE '2024-01-08' + CAST(i AS INTEGER) AS DATE) AS day FROM u, range(7) AS r(i)),
    c AS (SELECT user_id, day, count(*) AS total, count(*) FILTER (status = 'TAKEN') AS taken FROM doses GROUP BY 1, 2),
    j AS (SELECT user_id, day, coalesce(total, 0) AS total, coalesce(taken, 0) AS taken FROM s LEFT JOIN c USING (user_id, day))
    SELECT *, CASE WHEN total = 0 THEN 'no_doses' WHEN taken = total THEN 'full' WHEN taken > 0 THEN 'partial' ELSE 'none' END AS state FROM j""")
def weekly_calendar_filled(spark, sf_dir):
    return A.calendar(doses(spark, sf_dir), "2024-01-08", 7)


@query(f"""WITH {DOSES}, g AS (SELECT user_id, count(*) AS total, {FOUR}, count(*) FILTER (status = 'PENDING') AS pending
    FROM doses WHERE day = DATE '{_TODAY}' GROUP BY 1)
    SELECT *, taken + missed + skipped AS finalized, {pct("taken", "taken + missed + skipped")} AS adherence FROM g""")
def today_summary(spark, sf_dir):
    return A.timeline(doses(spark, sf_dir), _TODAY)


@query(f"""WITH {DOSES}, g AS (SELECT user_id, medicine_id, count(*) AS scheduled, count(*) FILTER (status = 'TAKEN') AS taken,
    count(*) FILTER (status IN ('TAKEN', 'MISSED', 'SKIPPED')) AS recorded, max(scheduled_at) AS latest FROM doses GROUP BY 1, 2)
    SELECT *, CASE WHEN recorded > 0 THEN floor(taken * 10000.0::DOUBLE / recorded + 0.5) / 100.0::DOUBLE END AS adherence FROM g""")
def report_adherence(spark, sf_dir):
    return A.report(doses(spark, sf_dir))


@query(f"WITH {DOSES} SELECT DISTINCT user_id FROM doses WHERE day = DATE '{_TODAY}'")
def active_users(spark, sf_dir):
    found = doses(spark, sf_dir).where(F.to_date("scheduled_at") == F.lit(_TODAY).cast("date"))
    return found.select("user_id").distinct()


@query(f"""WITH {DOSES}, c AS (SELECT medicine_id, count(*) AS n FROM doses GROUP BY 1)
    SELECT p_partkey AS medicine_id, coalesce(n, 0) AS doses FROM part LEFT JOIN c ON medicine_id = p_partkey""")
def child_counts(spark, sf_dir):
    counts = doses(spark, sf_dir).groupBy("medicine_id").agg(F.count("*").alias("n"))
    catalogue = medicines(spark, sf_dir).join(counts, "medicine_id", "left")
    return catalogue.select("medicine_id", F.coalesce("n", F.lit(0)).alias("doses"))


def _streak_sql(open_days: int) -> str:
    return f"""WITH {DOSES}, t AS (SELECT DISTINCT user_id, day FROM doses WHERE status = 'TAKEN' AND day <= DATE '{_TODAY}'
        AND day > DATE '{_TODAY}' - 90), i AS (SELECT user_id, day,
        CAST(day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS DATE) AS island FROM t),
        r AS (SELECT user_id, island, count(*) AS n, max(day) AS last FROM i GROUP BY 1, 2)
        SELECT user_id, CAST(max(CASE WHEN last >= DATE '{_TODAY}' - {open_days} THEN n ELSE 0 END) AS BIGINT) AS current,
               max(n) AS best FROM r GROUP BY 1"""


@query(_streak_sql(1))
def streaks(spark, sf_dir):
    return A.streaks(doses(spark, sf_dir), _TODAY)


@query(_streak_sql(0))
def streaks_compat(spark, sf_dir):
    return A.streaks(doses(spark, sf_dir), _TODAY, compat=True)


@query(f"""WITH {DOSES}, g AS (SELECT user_id, count(*) AS missed, arg_min(medicine_id, (scheduled_at, id)) AS first
    FROM doses WHERE status = 'MISSED' AND day = DATE '{_TODAY}' GROUP BY 1)
    SELECT *, CASE WHEN missed = 1 THEN CAST(first AS VARCHAR) ELSE CAST(first AS VARCHAR) || ' and ' || CAST(missed - 1 AS VARCHAR)
           || CASE WHEN missed = 2 THEN ' other' ELSE ' others' END END AS label FROM g""")
def missed_digest(spark, sf_dir):
    return A.missed_digest(doses(spark, sf_dir), _TODAY)


@query(f"""WITH {DOSES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, medicine_id ORDER BY
    CASE status WHEN 'TAKEN' THEN 5 WHEN 'SNOOZED' THEN 4 WHEN 'SKIPPED' THEN 3 WHEN 'MISSED' THEN 2 ELSE 1 END DESC,
    scheduled_at DESC NULLS LAST, id) AS rn FROM doses)
    SELECT id, user_id, medicine_id, scheduled_at, status FROM r WHERE rn = 1""")
def dedupe_by_state(spark, sf_dir):
    return A.dedupe_by_state(doses(spark, sf_dir), ["user_id", "medicine_id"]).drop("value")


@query(f"""WITH {DOSES}, p AS (SELECT * FROM doses WHERE status = 'PENDING' AND scheduled_at < TIMESTAMP '{_TODAY}'
    ORDER BY scheduled_at DESC, id LIMIT 50)
    SELECT id, user_id FROM p WHERE scheduled_at + to_minutes(id % 120) < TIMESTAMP '{_TODAY}'""")
def limit_before_filter(spark, sf_dir):
    return A.overdue_page(doses(spark, sf_dir), _TODAY, grace()).select("id", "user_id")


@query(f"""WITH {DOSES}, p AS (SELECT id, user_id, status FROM doses WHERE status IN ('TAKEN', 'MISSED')),
    t AS (SELECT count(*) AS total FROM p)
    SELECT id, user_id, status, total, CAST(ceil(total / 20.0) AS BIGINT) AS pages
    FROM (SELECT * FROM p ORDER BY id LIMIT 20 OFFSET 40), t""")
def paged_history(spark, sf_dir):
    rows = doses(spark, sf_dir).where(F.col("status").isin("TAKEN", "MISSED")).select("id", "user_id", "status")
    return A.page(rows, ["id"], 3, 20)


@query(f"""WITH {DOSES}, p AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY scheduled_at DESC, id) AS rn FROM doses)
    SELECT user_id, count(*) FILTER (rn <= 10) AS shown, max(rn) > 10 AS truncated FROM p WHERE rn <= 11 GROUP BY 1""")
def truncated_history(spark, sf_dir):
    order = "row_number() over (partition by user_id order by scheduled_at desc, id)"
    rows = doses(spark, sf_dir).withColumn("rn", F.expr(order)).where("rn <= 11")
    return rows.groupBy("user_id").agg(F.count_if(F.col("rn") <= 10).alias("shown"), (F.max("rn") > 10).alias("truncated"))


@query(f"""WITH {DOSES} SELECT c_custkey AS user_id, c_name AS name FROM customer
    WHERE EXISTS (SELECT 1 FROM doses WHERE user_id = c_custkey AND status = 'TAKEN')""")
def semi_active_patients(spark, sf_dir):
    taken = doses(spark, sf_dir).where("status = 'TAKEN'")
    patients = table(spark, sf_dir, "customer")
    return patients.join(taken, F.col("c_custkey") == taken.user_id, "left_semi").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")
    )


@query(f"""WITH {DOSES} SELECT c_custkey AS user_id FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM doses WHERE user_id = c_custkey AND scheduled_at >= TIMESTAMP '{NOW}' - INTERVAL 2 DAY)""")
def anti_silent_patients(spark, sf_dir):
    recent = doses(spark, sf_dir).where(F.col("scheduled_at") >= F.lit(NOW).cast("timestamp") - F.expr("interval 2 days"))
    patients = table(spark, sf_dir, "customer")
    return patients.join(recent, F.col("c_custkey") == recent.user_id, "left_anti").select(F.col("c_custkey").alias("user_id"))
