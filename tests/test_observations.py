"""Health observations in their canonical form, and identifiers of texts."""

import json

import pytest
from pyspark.sql import functions as F

from carelake.functions.similarity import fnv_id
from carelake.operators import observations as O

GOOD = [
    ("BLOOD_GLUCOSE", '{"glucose": 5.5, "mealStatus": "fasting"}', "mmol/L", {"glucose": 99.1, "mealStatus": "FASTING"}, "mg/dL"),
    ("BLOOD_GLUCOSE", '{"glucose": 15}', None, {"glucose": 15, "mealStatus": "UNKNOWN"}, "mg/dL"),
    ("OXYGEN_SATURATION", '{"spo2": 97}', None, {"oxygenSaturation": 97}, "%"),
    ("OXYGEN_SATURATION", '{"oxygenSaturation": null, "spo2": 95, "pulse": 61}', " ", {"oxygenSaturation": 95, "pulse": 61}, "%"),
    ("HEART_RATE", '{"heartRate": 280, "context": null}', "BPM", {"heartRate": 280, "context": "UNKNOWN"}, "bpm"),
    ("BLOOD_PRESSURE", '{"systolic": 120, "diastolic": 80, "bodyPosition": " sitting "}', "mmhg", {"systolic": 120, "diastolic": 80, "bodyPosition": "SITTING"}, "mmHg"),
    ("SLEEP_HOURS", '{"sleepHours": 0}', "h", {"sleepHours": 0}, "h"),
]
BAD = [
    ("HEART_RATE", '{"heartRate": 72, "diagnosis": "normal"}', None, "Unexpected health metric fields: diagnosis."),
    ("BLOOD_PRESSURE", '{"systolic": 70, "diastolic": 90}', None, "Systolic pressure must be greater than diastolic pressure."),
    ("BLOOD_PRESSURE", '{"systolic": 120, "diastolic": 80, "bodyPosition": null}', None, "bodyPosition must be a string."),
    ("BLOOD_PRESSURE", '{"systolic": 120, "diastolic": 80, "pulse": null}', None, "pulse must be a finite number."),
    ("HEART_RATE", '{"heartRate": "72"}', None, "heartRate must be a finite number."),
    ("HEART_RATE", '{"heartRate": 301}', None, "heartRate is outside the supported measurement range."),
    ("HEART_RATE", '{"heartRate": 80, "context": "RUNNING"}', None, "context must be one of: RESTING, ACTIVE, SLEEPING, UNKNOWN."),
    ("BLOOD_GLUCOSE", '{"glucose": 56}', "mmol/L", "glucose is outside the supported measurement range."),
    ("SLEEP_HOURS", '{"sleepHours": 8}', "min", "Unsupported unit 'min'. Expected h."),
    ("STEPS", "{}", None, "Unsupported health metric type."),
    (None, "{}", None, "Unsupported health metric type."),
    ("SLEEP_HOURS", "[8]", None, "The payload is no object."),
    ("SLEEP_HOURS", None, None, "The payload is no object."),
    ("SLEEP_HOURS", "{", None, "The payload is no object."),
]


@pytest.fixture(scope="module")
def told(spark):
    rows = [(i, *r[:3]) for i, r in enumerate(GOOD + BAD)]
    df = spark.createDataFrame(rows, "i long, metric string, payload string, unit string")
    return [r["n"] for r in df.select("i", O.normalized(F.col("metric"), F.col("payload"), F.col("unit")).alias("n")).orderBy("i").collect()]


def test_good_payloads_have_one_canonical_form(told):
    assert [(n["error"], json.loads(n["value"]), n["unit"]) for n in told[: len(GOOD)]] == [(None, *g[3:]) for g in GOOD]


def test_bad_payloads_are_refused_for_their_first_reason(told):
    assert [tuple(n) for n in told[len(GOOD) :]] == [(b[3], None, None) for b in BAD]


def test_identifiers_hash_code_units(spark):
    def expected(units):
        h = 0x811C9DC5
        for u in units:
            h = ((h ^ u) * 0x01000193) % 2**32
        return abs(h - 2**32 if h >= 2**31 else h) % 2147483647 or 1

    texts = {"a": [97], "": [], "é": [0xE9], "\U0001f48a": [0xD83D, 0xDC8A]}
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    found = dict(df.select("t", fnv_id("t")).collect())
    assert found == {t: expected(u) for t, u in texts.items()} | {None: None}
