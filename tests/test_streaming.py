"""Streams over files give what the batch rules give."""

import itertools

import pytest
from pyspark.sql import functions as F

from carelake.operators import vitals as V
from carelake.shipping import ship
from carelake.streaming import vitals as S

SCHEMA = "id long, user_id long, metric string, value double, key long, questionable boolean, critical boolean, recorded_at timestamp"


@pytest.fixture(scope="module")
def readings(spark, tmp_path_factory):
    """Three files of readings in order of time, with repeated keys; and the same rows as a batch."""
    ship(spark)
    rows = []
    for i in range(240):
        at = f"2024-01-{1 + i // 40:02d} {i % 40 // 2:02d}:{i * 7 % 60:02d}:00"
        rows.append((i, i % 3, "HR" if i % 2 else "SPO2", float(i % 50), None if i % 5 == 0 else i % 40, i % 11 == 0, i % 4 == 0, at))
    frame = spark.createDataFrame(rows, SCHEMA.replace("recorded_at timestamp", "recorded_at string")).withColumn("recorded_at", F.to_timestamp("recorded_at"))
    path = str(tmp_path_factory.mktemp("readings"))
    for lo, hi in ((0, 80), (80, 160), (160, 240)):
        frame.where(f"id >= {lo} and id < {hi}").coalesce(1).write.mode("append").parquet(path)
    return path, frame


_NAMES = itertools.count()


def _run(spark, df, tmp_path, mode="append"):
    name = f"stream{next(_NAMES)}"
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.table(name)


def _stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_ingest_is_that_of_the_batch(spark, readings, tmp_path):
    path, frame = readings
    now = "2024-01-05 00:00:00"
    got = _run(spark, S.ingest(_stream(spark, path), F.lit(now).cast("timestamp"), late="30 days"), tmp_path)
    want = V.ingest(frame, now)
    for both in (lambda d: d.groupBy("user_id").count(), lambda d: d.where("key is not null").select("user_id", "key").distinct()):
        assert sorted(map(tuple, both(got).collect())) == sorted(map(tuple, both(want).collect()))


def test_cooldown_is_that_of_the_batch(spark, readings, tmp_path):
    path, frame = readings
    at = F.col("recorded_at").alias("at")
    got = _run(spark, S.cooldown(_stream(spark, path).select("id", "user_id", "metric", "critical", at)), tmp_path)
    want = V.cooldown(frame.select("id", "user_id", "metric", "critical", at))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_days_that_are_over_are_counted(spark, readings, tmp_path):
    path, frame = readings
    got = {tuple(r) for r in _run(spark, S.daily_counts(_stream(spark, path), "1 hour"), tmp_path).collect()}
    want = frame.groupBy("user_id", "metric", F.to_date("recorded_at").alias("day")).agg(
        F.count("*"), F.count_if("questionable"), F.min("value"), F.max("value")
    )
    want = {tuple(r) for r in want.collect()}
    assert got and got <= want and {r[2].day for r in got} == {1, 2, 3, 4, 5}
