"""Report snapshots: adherence by outcomes, ranges, caps, empty sections."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from carelake.operators import reports as R

PATIENT = "user_id long, email string, first_name string, last_name string, birth timestamp, blood string, conditions array<string>, has_profile boolean, is_active boolean"
DOSE = "user_id long, dose_id long, name string, status string, scheduled_at timestamp, updated_at timestamp"


def _at(day, hour=8):
    return dt.datetime(2026, 8, day, hour, 1)


@pytest.fixture(scope="module")
def patients(spark):
    rows = [
        (1, "asha@example.com", "Asha", " Rao ", dt.datetime(1990, 1, 2), "O+", ["Hypertension"], True, True),
        (2, None, None, None, None, None, None, False, True),
        (3, "x@y.z", None, None, None, None, None, None, True),
        (4, "gone@y.z", None, None, None, None, None, False, False),
    ]
    return spark.createDataFrame(rows, PATIENT)


def _doses(spark, rows):
    return spark.createDataFrame([(u, i, n, s, _at(d), _at(d)) for i, (u, n, s, d) in enumerate(rows)], DOSE)


def test_adherence_counts_completed_outcomes_of_each_patient_alone(spark, patients):
    start, end = R.day_range("2026-08-01", "2026-08-10")
    doses = _doses(spark, [(1, "Medicine A", "TAKEN", 1), (1, "Medicine A", "MISSED", 2), (1, "Medicine A", "SNOOZED", 3), (1, "Medicine A", "TAKEN", 11), (2, "B", "PENDING", 1), (9, "C", "TAKEN", 1)])
    rows = {r["user_id"]: json.loads(r["snapshot"]) for r in R.compose(patients, [R.adherence(doses, start, end)], start, end).collect()}
    assert set(rows) == {1, 2, 3}
    told = rows[1]["adherence"]
    assert {k: told[k] for k in ("totalScheduled", "taken", "missed", "snoozed", "recordedDoses", "adherencePercent")} == dict(totalScheduled=3, taken=1, missed=1, snoozed=1, recordedDoses=2, adherencePercent=50.0)
    assert told["lastUpdatedAt"] == "2026-08-03T08:01:00.000Z" and "medications" not in rows[1] and rows[1]["sections"] == ["ADHERENCE"]
    assert rows[1]["patient"] == {"displayName": "Asha Rao", "contactEmail": "asha@example.com", "dateOfBirth": "1990-01-02T00:00:00.000Z", "bloodGroup": "O+", "conditions": ["Hypertension"]}
    assert rows[2]["adherence"]["adherencePercent"] is None and rows[2]["adherence"]["pending"] == 1 and rows[2]["patient"]["displayName"] == "Patient"
    assert rows[3]["adherence"] == {**dict.fromkeys(("totalScheduled", "taken", "missed", "skipped", "snoozed", "pending", "recordedDoses"), 0), "adherencePercent": None, "byMedicine": [], "truncated": False, "lastUpdatedAt": None}
    assert rows[3]["patient"]["displayName"] == "x@y.z" and rows[1]["range"]["end"] == "2026-08-10T23:59:59.999Z"


def test_reversed_and_long_ranges_are_refused():
    with pytest.raises(ValueError, match="before"):
        R.day_range("2026-08-10", "2026-08-01")
    with pytest.raises(ValueError, match="366"):
        R.day_range("2025-01-01", "2026-01-02")


def test_capped_sections_say_that_more_is_there(spark, monkeypatch):
    monkeypatch.setattr(R, "DOSES", 3)
    start, end = R.day_range("2026-08-01", "2026-08-10")
    doses = _doses(spark, [(1, "A", "TAKEN", 1), (1, "B", "TAKEN", 2), (1, "A", "MISSED", 3), (1, "A", "MISSED", 4), (1, "A", "MISSED", 5), (2, "A", "TAKEN", 1)])
    found = {r["user_id"]: r["adherence"] for r in R.adherence(doses, start, end).collect()}
    assert (found[1]["totalScheduled"], found[1]["missed"], found[1]["truncated"]) == (3, 1, True) and not found[2]["truncated"]
    assert [m["name"] for m in found[1]["byMedicine"]] == ["A", "B"]
    rows = spark.createDataFrame([(1, i, _at(1 + i)) for i in range(6)] + [(2, 0, _at(1))], "user_id long, i int, at timestamp")
    listed = {r["user_id"]: r["x"] for r in R.listed(rows, [F.col("i")], 4, F.struct("i"), F.col("at"), "x").collect()}
    assert [x["i"] for x in listed[1]["items"]] == [0, 1, 2, 3] and listed[1]["truncated"] and listed[1]["lastUpdatedAt"] == "2026-08-05T08:01:00.000Z"
    assert (listed[2]["total"], listed[2]["truncated"]) == (1, False)


def test_refills_have_a_status_and_the_newest_log(spark):
    schema = "user_id long, medicine_id long, name string, generic string, composition string, form string, strength string, instructions string, is_active boolean, updated_at timestamp, unit string, remaining int, threshold int"
    stock = [(None, 5), (0, 5), (5, 5), (6, 5), (6, None)]
    rows = [(1, i, f"n{i}", None, None, "TAB", " ", None, True, _at(2), " ", n, t) for i, (n, t) in enumerate(stock)]
    logs = spark.createDataFrame([(3, _at(1), _at(9), _at(8), _at(3)), (3, _at(2), _at(19), _at(18), _at(1))], "medicine_id long, created_at timestamp, finish timestamp, reminder timestamp, updated_at timestamp")
    (row,) = R.refills(spark.createDataFrame(rows, schema), logs).collect()
    items = row["refills"]["items"]
    assert [i["status"] for i in items] == ["UNKNOWN", "OUT", "LOW", "ADEQUATE", "ADEQUATE"] and items[0]["strength"] is None
    assert items[3]["expectedFinishDate"] == "2026-08-19T08:01:00.000Z" and items[3]["lastUpdatedAt"] == "2026-08-02T08:01:00.000Z"


def test_the_query_lists_all_that_a_patient_has_whatever_a_report_would_hold(spark, sf_dir, monkeypatch):
    from carelake.plans.reports import report_snapshots

    for limit in ("MEDICINES", "DOSES", "ALLERGIES", "FINDINGS", "VITALS"):
        monkeypatch.setattr(R, limit, 1)
    told = [json.loads(r["snapshot"]) for r in report_snapshots(spark, sf_dir).collect()]
    assert not any(r[s]["truncated"] for r in told for s in R.SECTIONS)
    assert all(len(r["medications"]["items"]) == r["medications"]["total"] for r in told) and max(r["medications"]["total"] for r in told) > 1
