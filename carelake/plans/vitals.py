"""Vitals queries over events as readings."""

from pyspark.sql import functions as F

from carelake.operators import vitals as V
from carelake.plans.registry import query
from carelake.shipping import ship
from carelake.sources.views import table

_READINGS = """r AS (SELECT event_id AS id, user_id, event_type AS metric, value, ts AS recorded_at,
    CAST(event_id % 3 * 330 - 300 AS INTEGER) AS off, event_type = 'error' AS q, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"""


def readings(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("event_type").alias("metric"),
        "value",
        F.col("ts").cast("timestamp").alias("recorded_at"),
        (F.col("event_id") % 3 * 330 - 300).alias("offset_minutes"),
        (F.col("event_type") == "error").alias("questionable"),
        F.from_json("props", "k long")["k"].alias("k"),
    )


_TREND = f"""WITH {_READINGS}, t AS (SELECT user_id, metric, CAST(recorded_at + to_minutes(off) AS DATE) AS day, count(*) AS n,
    count(*) FILTER (q) AS questionable, floor(avg(value) * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE AS mean, min(value) AS least, max(value) AS most
    FROM r WHERE value IS NOT NULL GROUP BY 1, 2, 3)"""


@query(_TREND + " SELECT * FROM t")
def vital_daily_trend(spark, sf_dir):
    return V.daily_trend(readings(spark, sf_dir))


@query(_TREND + """, g AS (SELECT user_id, metric, count(*) AS points, arg_min(mean, day) AS first, arg_max(mean, day) AS last FROM t GROUP BY 1, 2)
    SELECT *, CASE WHEN points < 3 THEN 'INSUFFICIENT_DATA' WHEN last - first > greatest(abs(first) * 0.03::DOUBLE, 1.0) THEN 'RISING'
           WHEN last - first < -greatest(abs(first) * 0.03::DOUBLE, 1.0) THEN 'FALLING' ELSE 'STABLE' END AS direction FROM g""")
def vital_trend_direction(spark, sf_dir):
    return V.direction(V.daily_trend(readings(spark, sf_dir)))


@query(f"""WITH {_READINGS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY recorded_at DESC, id) AS rn FROM r)
    SELECT user_id, metric, arg_min(value, rn) AS value, arg_min(id, rn) AS id FROM k WHERE rn <= 25 GROUP BY 1, 2""")
def latest_vitals(spark, sf_dir):
    return V.latest(readings(spark, sf_dir))


def _bands(name: str, x: str) -> str:
    cases = []
    for lo, hi, score in V.NEWS2[name]:
        parts = [f"{x} >= {lo}"] * (lo is not None) + [f"{x} <= {hi}"] * (hi is not None)
        cases.append(f"WHEN {' AND '.join(parts)} THEN {score}")
    return f"CASE {' '.join(cases)} ELSE 0 END"


@query(f"""WITH {_READINGS}, s AS (SELECT id, {_bands("respiration", "(k % 30)")} AS a, {_bands("spo2", "(85 + k % 15)")} AS b,
    {_bands("systolic", "(80 + k + 50 * (id % 3))")} AS c, {_bands("pulse", "(30 + k + 10 * (id % 4))")} AS d,
    {_bands("temperature", "(34 + k / 16.0::DOUBLE)")} AS e, CASE WHEN id % 10 = 0 THEN 2 ELSE 0 END AS f, CASE WHEN id % 17 = 0 THEN 3 ELSE 0 END AS g FROM r)
    SELECT id, CAST(a + b + c + d + e + f + g AS BIGINT) AS score, CASE WHEN a + b + c + d + e + f + g >= 7 THEN 'HIGH'
           WHEN a + b + c + d + e + f + g >= 5 OR greatest(a, b, c, d, e, f, g) = 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM s""")
def news2(spark, sf_dir):
    k, i = F.col("k"), F.col("id")
    rows = readings(spark, sf_dir).select(
        "id",
        (k % 30).alias("respiration"),
        (85 + k % 15).alias("spo2"),
        (80 + k + 50 * (i % 3)).alias("systolic"),
        (30 + k + 10 * (i % 4)).alias("pulse"),
        (34 + k / 16.0).alias("temperature"),
        (i % 10 == 0).alias("oxygen"),
        (i % 17 != 0).alias("alert"),
    )
    return V.news2(rows)


@query(f"""WITH {_READINGS}, w AS (SELECT id, 20 + k % 25 AS t, k AS h, k * 4 AS pm, 85 + k % 15 AS o FROM r),
    x AS (SELECT *, 0.567::DOUBLE * t + 0.393::DOUBLE * (h / 100::DOUBLE * 6.105::DOUBLE * exp(17.27::DOUBLE * t / (237.7::DOUBLE + t))) + 3.94::DOUBLE AS heat FROM w)
    SELECT id, round(heat, 6) AS heat, CASE WHEN id % 97 = 0 THEN 'SOS' WHEN heat >= 32 THEN 'HEAT' WHEN pm >= 350 THEN 'SMOG' WHEN o < 90 THEN 'HYPOXIA' ELSE 'NORMAL' END AS alarm FROM x""")
def wearable_alarms(spark, sf_dir):
    k = F.col("k")
    rows = readings(spark, sf_dir).withColumn("heat", V.wbgt(20 + k % 25, k))
    told = V.alarm(F.col("id") % 97 == 0, F.col("heat"), k * 4, 85 + k % 15)
    return rows.select("id", F.round("heat", 6).alias("heat"), told.alias("alarm"))


@query(f"WITH {_READINGS} SELECT id, floor(k / 5.0::DOUBLE * 180.182::DOUBLE + 0.5) / 10 AS mg_dl FROM r")
def glucose_units(spark, sf_dir):
    return readings(spark, sf_dir).select("id", V.to_mg_dl(F.col("k") / 5.0).alias("mg_dl"))


@query(f"""WITH {_READINGS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY recorded_at, id) AS rn FROM r WHERE recorded_at <= TIMESTAMP '2024-01-20 00:05:00')
    SELECT id, user_id, k % 10 != 0 AS keyed FROM o WHERE rn = 1 OR k % 10 = 0""")
def idempotent_ingest(spark, sf_dir):
    rows = readings(spark, sf_dir).withColumn("key", F.when(F.col("k") % 10 != 0, F.col("k")))
    return V.ingest(rows, "2024-01-20 00:00:00").select("id", "user_id", F.col("key").isNotNull().alias("keyed"))


@query(f"""WITH {_READINGS}, m AS (SELECT id, q, k, CASE metric WHEN 'view' THEN 'HEART_RATE' WHEN 'click' THEN 'OXYGEN_SATURATION' WHEN 'purchase' THEN 'BLOOD_GLUCOSE' WHEN 'signup' THEN 'BLOOD_PRESSURE' ELSE 'SLEEP_HOURS' END AS m,
    CASE metric WHEN 'view' THEN 30 + 2 * k WHEN 'click' THEN 80 + k % 21 WHEN 'purchase' THEN 40 + 3 * k ELSE 80 + 2 * k END AS v, 50 + k AS v2, id % 2 = 0 AS c FROM r),
    t AS (SELECT id, CASE WHEN q THEN 'VERIFY_READING|MEDIUM|UNVERIFIED_SOURCE'
      WHEN m = 'BLOOD_PRESSURE' THEN CASE WHEN v >= 180 OR v2 >= 120 THEN 'URGENT_HELP|CRITICAL|BP_VERY_HIGH' WHEN v >= 140 OR v2 >= 90 THEN 'RECHECK|HIGH|BP_ELEVATED' WHEN v < 90 OR v2 < 60 THEN 'RECHECK|MEDIUM|BP_LOW' ELSE 'NORMAL|INFO|NO_RULE_TRIGGERED' END
      WHEN m = 'BLOOD_GLUCOSE' THEN CASE WHEN v < 54 THEN 'URGENT_HELP|CRITICAL|GLUCOSE_VERY_LOW' WHEN v < 70 THEN 'RECHECK|HIGH|GLUCOSE_LOW' WHEN v >= 300 THEN 'CONTACT_CLINICIAN|CRITICAL|GLUCOSE_VERY_HIGH' WHEN (c AND v >= 126) OR v >= 200 THEN 'RECHECK|HIGH|GLUCOSE_ELEVATED' ELSE 'NORMAL|INFO|NO_RULE_TRIGGERED' END
      WHEN m = 'HEART_RATE' THEN CASE WHEN v < 40 OR v > 150 THEN 'URGENT_HELP|CRITICAL|HEART_RATE_EXTREME' WHEN c AND (v < 50 OR v > 100) THEN 'RECHECK|MEDIUM|RESTING_HEART_RATE_OUTSIDE_RANGE' ELSE 'NORMAL|INFO|NO_RULE_TRIGGERED' END
      WHEN m = 'OXYGEN_SATURATION' THEN CASE WHEN v <= 88 THEN 'URGENT_HELP|CRITICAL|OXYGEN_SATURATION_VERY_LOW' WHEN v <= 92 THEN 'CONTACT_CLINICIAN|HIGH|OXYGEN_SATURATION_LOW' ELSE 'NORMAL|INFO|NO_RULE_TRIGGERED' END
      ELSE 'NORMAL|INFO|NO_RULE_TRIGGERED' END AS told FROM m)
    SELECT id, split_part(told, '|', 1) AS status, split_part(told, '|', 2) AS severity, split_part(told, '|', 3) AS reason FROM t""")
def vital_safety(spark, sf_dir):
    k, m = F.col("k"), F.col("metric")
    names = {"view": "HEART_RATE", "click": "OXYGEN_SATURATION", "purchase": "BLOOD_GLUCOSE", "signup": "BLOOD_PRESSURE"}
    metric = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[m], F.lit("SLEEP_HOURS"))
    value = F.when(m == "view", 30 + 2 * k).when(m == "click", 80 + k % 21).when(m == "purchase", 40 + 3 * k).otherwise(80 + 2 * k)
    even = F.col("id") % 2 == 0
    context = F.when(even & (m == "purchase"), F.lit("FASTING")).when(even & (m == "view"), F.lit("RESTING")).otherwise(F.lit("OTHER"))
    told = V.safety(metric, value, 50 + k, context, F.col("questionable"))
    return readings(spark, sf_dir).select("id", told.alias("t")).select("id", "t.*")


@query(f"""WITH RECURSIVE {_READINGS}, o AS (SELECT id, user_id, metric, coalesce(value > 100, false) AS critical, recorded_at AS moment, row_number() OVER (PARTITION BY user_id, metric ORDER BY recorded_at, id) AS n FROM r),
    f AS (SELECT id, user_id, metric, n, true AS sent, moment AS last FROM o WHERE n = 1 UNION ALL
          SELECT o.id, o.user_id, o.metric, o.n, o.moment - f.last > CASE WHEN o.critical THEN INTERVAL 5 MINUTE ELSE INTERVAL 30 MINUTE END,
                 CASE WHEN o.moment - f.last > CASE WHEN o.critical THEN INTERVAL 5 MINUTE ELSE INTERVAL 30 MINUTE END THEN o.moment ELSE f.last END
          FROM f JOIN o ON o.user_id = f.user_id AND o.metric = f.metric AND o.n = f.n + 1)
    SELECT id, sent FROM f""")
def alert_cooldown(spark, sf_dir):
    ship(spark)
    rows = readings(spark, sf_dir).withColumn("critical", F.coalesce(F.col("value") > 100, F.lit(False)))
    return V.cooldown(rows.select("id", "user_id", "metric", "critical", F.col("recorded_at").alias("at")))


@query(f"""WITH {_READINGS} SELECT id, 'HEART_RATE' AS metric, CAST(k AS DOUBLE) AS value FROM r WHERE k % 2 = 0
    UNION ALL SELECT id, 'SPO2', 85.0 + k % 15 FROM r WHERE k % 3 = 0 UNION ALL SELECT id, 'SLEEP_HOURS', CAST(k AS DOUBLE) / 10 FROM r WHERE k % 5 = 0""")
def watch_fanout(spark, sf_dir):
    """One payload to up to three readings."""
    k = F.col("k").cast("double")

    def one(name, value, wanted):
        return F.when(wanted, F.struct(F.lit(name).alias("metric"), value.alias("value")))

    made = F.array_compact(
        F.array(
            one("HEART_RATE", k, F.col("k") % 2 == 0),
            one("SPO2", 85.0 + F.col("k") % 15, F.col("k") % 3 == 0),
            one("SLEEP_HOURS", k / 10, F.col("k") % 5 == 0),
        )
    )
    return readings(spark, sf_dir).select("id", F.explode(made).alias("x")).select("id", "x.metric", "x.value")
