"""Queries of health observations: which payloads are taken, and how they are stored."""

from pyspark.sql import functions as F

from carelake.operators import observations as O
from carelake.plans.registry import query
from carelake.sources.views import table

_PAYLOAD = """e AS (SELECT event_id AS id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type FROM events),
    c AS (SELECT id, k, CASE event_type WHEN 'view' THEN 'HEART_RATE' WHEN 'click' THEN 'OXYGEN_SATURATION' WHEN 'purchase' THEN 'BLOOD_GLUCOSE' WHEN 'signup' THEN 'BLOOD_PRESSURE' WHEN 'error' THEN CASE WHEN k % 10 = 0 THEN 'STEPS' ELSE 'SLEEP_HOURS' END END AS metric,
      CAST(k * 4 AS VARCHAR) AS v FROM e),
    p AS (SELECT id, metric, CASE WHEN k % 13 = 0 THEN '[1]' ELSE '{' || CASE metric WHEN 'HEART_RATE' THEN '"heartRate":' || CASE WHEN k % 11 = 0 THEN '"' || v || '"' ELSE v END || CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN ',"context":" active"' ELSE ',"context":"running"' END
        WHEN 'OXYGEN_SATURATION' THEN CASE WHEN k % 2 = 0 THEN '"spo2":' ELSE '"oxygenSaturation":' END || v || CASE WHEN k % 5 = 0 THEN ',"pulse":300' WHEN k % 5 = 1 THEN ',"pulse":61.5' ELSE '' END
        WHEN 'BLOOD_GLUCOSE' THEN '"glucose":' || CAST(k AS VARCHAR) || '.5' || CASE WHEN k % 4 = 0 THEN ',"mealStatus":"fasting"' WHEN k % 4 = 1 THEN ',"mealStatus":7' WHEN k % 4 = 2 THEN ',"mealStatus":null' ELSE '' END
        WHEN 'BLOOD_PRESSURE' THEN '"systolic":' || v || ',"diastolic":' || CAST(k % 7 * 30 AS VARCHAR) || CASE WHEN k % 3 = 0 THEN ',"bodyPosition":"Sitting"' ELSE '' END
        ELSE '"sleepHours":' || CAST(k % 30 AS VARCHAR) END || CASE WHEN k % 17 = 0 THEN ',"other":1,"extra":2' ELSE '' END || '}' END AS payload,
      CASE WHEN k % 9 = 0 THEN 'kg' WHEN k % 9 = 1 THEN ' MMOL/L ' WHEN k % 9 = 2 THEN '' END AS unit FROM c)"""


def _refused(field, low, high):
    x = f"json_extract(payload, '$.{field}')"
    return f"CASE WHEN coalesce(json_type({x}), '') NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN '{field} must be a finite number.' WHEN CAST({x} AS DOUBLE) NOT BETWEEN {low} AND {high} THEN '{field} is outside the supported measurement range.' END"


def _chosen(field, away):
    x, choices = f"json_extract(payload, '$.{field}')", O.CHOICES[field]
    quoted = ", ".join(f"'{c}'" for c in choices)
    return f"CASE WHEN {away.format(x)} THEN NULL WHEN json_type({x}) != 'VARCHAR' THEN '{field} must be a string.' WHEN upper(trim(payload ->> '$.{field}')) NOT IN ({quoted}) THEN '{field} must be one of: {', '.join(choices)}.' END"


_NULL = "coalesce(json_type({}), 'NULL') = 'NULL'"
_REASONS = f"""CASE metric
    WHEN 'HEART_RATE' THEN coalesce({_refused("heartRate", 20, 300)}, {_chosen("context", _NULL)})
    WHEN 'OXYGEN_SATURATION' THEN coalesce(replace(CASE WHEN json_extract(payload, '$.oxygenSaturation') IS NULL THEN {_refused("spo2", 1, 100)} ELSE {_refused("oxygenSaturation", 1, 100)} END, 'spo2', 'oxygenSaturation'),
        CASE WHEN json_extract(payload, '$.pulse') IS NOT NULL THEN {_refused("pulse", 20, 250)} END)
    WHEN 'BLOOD_GLUCOSE' THEN coalesce(CASE WHEN lower(asked) = 'mmol/l' THEN {_refused("glucose", 0.6, 55.5)} ELSE {_refused("glucose", 10, 1000)} END, {_chosen("mealStatus", _NULL)})
    WHEN 'BLOOD_PRESSURE' THEN coalesce({_refused("systolic", 40, 300)}, {_refused("diastolic", 20, 200)},
        CASE WHEN CAST(payload ->> '$.systolic' AS DOUBLE) <= CAST(payload ->> '$.diastolic' AS DOUBLE) THEN 'Systolic pressure must be greater than diastolic pressure.' END, {_chosen("bodyPosition", "{} IS NULL")})
    ELSE {_refused("sleepHours", 0, 24)} END"""
_ALLOWED = "CASE metric " + " ".join(f"WHEN '{m}' THEN {list(f)}" for m, f in O.FIELDS.items()) + " END"
_UNIT = "CASE metric " + " ".join(f"WHEN '{m}' THEN {list(u)}" for m, u in O.UNITS.items()) + " END"


@query(f"""WITH {_PAYLOAD}, r AS (SELECT *, json_type(payload) = 'OBJECT' AS ok, CASE WHEN json_type(payload) = 'OBJECT' THEN list_filter(json_keys(payload), lambda x: NOT list_contains({_ALLOWED}, x)) END AS extra, nullif(trim(unit), '') AS asked FROM p),
    x AS (SELECT *, CASE WHEN metric IS NULL OR metric = 'STEPS' THEN 'Unsupported health metric type.' WHEN NOT ok THEN 'The payload is no object.' WHEN len(extra) > 0 THEN 'Unexpected health metric fields: ' || array_to_string(extra, ', ') || '.'
      WHEN asked IS NOT NULL AND NOT list_contains(list_transform({_UNIT}, lambda u: lower(u)), lower(asked)) THEN 'Unsupported unit ''' || asked || '''. Expected ' || array_to_string({_UNIT}, ' or ') || '.' ELSE {_REASONS} END AS error FROM r)
    SELECT id, error, CASE WHEN error IS NULL THEN ({_UNIT})[1] END AS unit, CASE WHEN error IS NULL THEN CASE metric WHEN 'HEART_RATE' THEN CAST(payload ->> '$.heartRate' AS DOUBLE) WHEN 'OXYGEN_SATURATION' THEN CAST(coalesce(payload ->> '$.oxygenSaturation', payload ->> '$.spo2') AS DOUBLE)
      WHEN 'BLOOD_PRESSURE' THEN CAST(payload ->> '$.systolic' AS DOUBLE) WHEN 'SLEEP_HOURS' THEN CAST(payload ->> '$.sleepHours' AS DOUBLE) WHEN 'BLOOD_GLUCOSE' THEN CASE WHEN lower(asked) = 'mmol/l' THEN floor(CAST(payload ->> '$.glucose' AS DOUBLE) * 180.182::DOUBLE + 0.5::DOUBLE) / 10 ELSE CAST(payload ->> '$.glucose' AS DOUBLE) END END END AS value,
      CASE WHEN error IS NULL THEN CASE metric WHEN 'HEART_RATE' THEN coalesce(upper(trim(payload ->> '$.context')), 'UNKNOWN') WHEN 'BLOOD_GLUCOSE' THEN coalesce(upper(trim(payload ->> '$.mealStatus')), 'UNKNOWN') WHEN 'BLOOD_PRESSURE' THEN upper(payload ->> '$.bodyPosition') END END AS choice FROM x""")
def payload_checks(spark, sf_dir):
    """Payloads of five metrics with strings for numbers, wrong units, unknown choices and unexpected fields."""
    k, kind = F.col("k"), F.col("event_type")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    names = {"view": "HEART_RATE", "click": "OXYGEN_SATURATION", "purchase": "BLOOD_GLUCOSE", "signup": "BLOOD_PRESSURE", "error": "SLEEP_HOURS"}
    metric = F.when((kind == "error") & (k % 10 == 0), F.lit("STEPS")).otherwise(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[kind])
    rows = rows.withColumn("metric", metric).withColumn("v", (k * 4).cast("string"))
    v, empty = F.col("v"), F.lit("")

    def joined(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    fields = {
        "HEART_RATE": joined('"heartRate":', F.when(k % 11 == 0, joined('"', v, '"')).otherwise(v), F.when(k % 3 == 0, empty).when(k % 3 == 1, F.lit(',"context":" active"')).otherwise(F.lit(',"context":"running"'))),
        "OXYGEN_SATURATION": joined(F.when(k % 2 == 0, F.lit('"spo2":')).otherwise(F.lit('"oxygenSaturation":')), v, F.when(k % 5 == 0, F.lit(',"pulse":300')).when(k % 5 == 1, F.lit(',"pulse":61.5')).otherwise(empty)),
        "BLOOD_GLUCOSE": joined('"glucose":', k.cast("string"), ".5", F.when(k % 4 == 0, F.lit(',"mealStatus":"fasting"')).when(k % 4 == 1, F.lit(',"mealStatus":7')).when(k % 4 == 2, F.lit(',"mealStatus":null')).otherwise(empty)),
        "BLOOD_PRESSURE": joined('"systolic":', v, ',"diastolic":', (k % 7 * 30).cast("string"), F.when(k % 3 == 0, F.lit(',"bodyPosition":"Sitting"')).otherwise(empty)),
    }
    inner = joined('"sleepHours":', (k % 30).cast("string"))
    for name, text in fields.items():
        inner = F.when(F.col("metric") == name, text).otherwise(inner)
    extra = F.when(k % 17 == 0, F.lit(',"other":1,"extra":2')).otherwise(empty)
    payload = F.when(k % 13 == 0, F.lit("[1]")).otherwise(joined("{", inner, extra, "}"))
    unit = F.when(k % 9 == 0, F.lit("kg")).when(k % 9 == 1, F.lit(" MMOL/L ")).when(k % 9 == 2, empty)
    rows = rows.select("id", O.normalized(F.col("metric"), payload, unit).alias("n"))
    value = F.coalesce(*[F.get_json_object("n.value", f"$.{c}").cast("double") for c in ("heartRate", "oxygenSaturation", "glucose", "systolic", "sleepHours")])
    choice = F.coalesce(*[F.get_json_object("n.value", f"$.{c}") for c in ("context", "mealStatus", "bodyPosition")])
    return rows.select("id", "n.error", "n.unit", value.alias("value"), choice.alias("choice"))
