"""Operators on small fixtures: nulls, ties, empty tables and rounding."""

from pyspark.sql import functions as F

from carelake.functions.numbers import half_up, percent
from carelake.functions.times import iso_week
from carelake.operators import adherence as A

DOSES = "id long, user_id long, medicine_id long, scheduled_at timestamp, status string"


def _doses(spark, rows):
    df = spark.createDataFrame(rows, DOSES.replace("scheduled_at timestamp", "scheduled_at string"))
    return df.withColumn("scheduled_at", F.to_timestamp("scheduled_at"))


def test_halves_round_up(spark):
    row = spark.range(1).select(*[half_up(F.lit(x)).alias(str(i)) for i, x in enumerate((0.5, 1.5, 2.4, -2.5))]).first()
    assert [int(x) for x in row] == [1, 2, 2, -2]


def test_percent_of_nothing_is_zero(spark):
    row = spark.range(1).select(percent(F.lit(0), F.lit(0)).alias("a"), percent(F.lit(1), F.lit(3)).alias("b")).first()
    assert (row["a"], row["b"]) == (0, 33)


def test_iso_week_belongs_to_the_year_of_its_thursday(spark):
    days = [("2024-12-30",), ("2021-01-03",), ("2020-12-31",)]
    found = spark.createDataFrame(days, "d string").select(iso_week(F.to_date("d")).alias("w")).collect()
    assert [r["w"] for r in found] == ["2025-W01", "2020-W53", "2020-W53"]


def test_pending_doses_count_in_the_total_only(spark):
    rows = [(i, 1, 1, "2024-01-01 10:00:00", s) for i, s in enumerate(("TAKEN", "MISSED", "PENDING", "TAKEN"))]
    found = A.status_counts(_doses(spark, rows), "user_id").first()
    assert (found["total"], found["taken"], found["missed"], found["pending"], found["adherence"]) == (4, 2, 1, 1, 67)


def test_days_with_pending_doses_alone_are_absent(spark):
    rows = [(1, 1, 1, "2024-01-01 10:00:00", "PENDING"), (2, 1, 1, "2024-01-02 23:59:59", "TAKEN")]
    assert [str(r["day"]) for r in A.daily(_doses(spark, rows)).collect()] == ["2024-01-02"]


def test_unknown_medicines_keep_their_counts(spark):
    doses = _doses(spark, [(1, 1, 9, "2024-01-01 10:00:00", "TAKEN"), (2, 1, None, "2024-01-01 10:00:00", "MISSED")])
    medicines = spark.createDataFrame([(1, "known", "SYRUP", "b")], "medicine_id long, name string, form string, brand string")
    found = A.by_medicine(doses, medicines).collect()
    assert {r["medicine_name"] for r in found} == {"Unknown"} and len(found) == 2


def test_empty_tables(spark):
    doses = _doses(spark, [])
    assert A.status_counts(doses, "user_id").count() == A.daily(doses).count() == 0
