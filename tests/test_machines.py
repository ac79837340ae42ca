"""Dose actions, reminders and deliveries: rules, and streams against batches over shuffled micro-batches and a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from carelake.operators import machines as M
from carelake.plans import transitions as T
from carelake.streaming import machines as S

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ACTION = "action_id long, user_id long, schedule_id long, scheduled_at timestamp, status string, snooze_until timestamp, client_action_id string, at timestamp"


def _at(minute):
    return dt.datetime(2026, 7, 24, 8, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)


@pytest.fixture()
def act(spark):
    """Outcomes of a list of (status, snooze minutes or None, client id) on one dose, one a minute."""
    schedules = spark.createDataFrame([(1, 1, 5, 2)], "schedule_id long, owner long, medicine_id long, doses_per_intake long")

    def run(actions, status="PENDING", snoozes=0, user=1, schedule=1):
        rows = [(i, user, schedule, _at(0), a, None if s is None else _at(i + s), c, _at(i)) for i, (a, s, c) in enumerate(actions)]
        doses = spark.createDataFrame([(1, _at(0), 1, status, snoozes)], "schedule_id long, scheduled_at timestamp, user_id long, status string, snooze_count long")
        found = M.dose_actions(spark.createDataFrame(rows, ACTION), schedules, doses)
        stock = M.stock_after(found, schedules, spark.createDataFrame([(5, 3), (6, None)], "medicine_id long, remaining long"))
        return [(r["outcome"], r["status"], r["snooze_count"], r["changed"]) for r in found.orderBy("action_id").collect()], dict(map(tuple, stock.collect()))

    return run


def test_stock_goes_down_once_when_a_dose_becomes_taken(act):
    found, stock = act([("TAKEN", None, None), ("TAKEN", None, None), ("TAKEN", None, "other")])
    assert found == [("APPLIED", "TAKEN", 0, True), ("REPLAYED", "TAKEN", 0, False), ("ALREADY_TAKEN", "TAKEN", 0, False)]
    assert stock == {5: 1, 6: None}


def test_a_taken_dose_is_not_rewritten_but_replays_are_told_again(act):
    found, stock = act([("MISSED", None, "a"), ("TAKEN", None, "b"), ("MISSED", None, "a"), ("MISSED", None, "c"), ("MISSED", None, "c")])
    assert [f[0] for f in found] == ["APPLIED", "APPLIED", "REPLAYED", "TAKEN_IS_FINAL", "TAKEN_IS_FINAL"] and stock[5] == 1
    assert act([("SKIPPED", None, None)], status="TAKEN") == ([("TAKEN_IS_FINAL", "TAKEN", 0, False)], {5: 3, 6: None})


def test_at_most_three_snoozes_of_up_to_twelve_hours_ahead(act):
    found, _ = act([("SNOOZED", 10, None), ("SNOOZED", 720, None), ("SNOOZED", 721, None), ("SNOOZED", 0, None), ("SNOOZED", None, None), ("SNOOZED", 11, None), ("TAKEN", None, None)], snoozes=1)
    assert [f[0] for f in found] == ["APPLIED", "APPLIED", "SNOOZE_UNTIL_INVALID", "SNOOZE_UNTIL_INVALID", "SNOOZE_UNTIL_REQUIRED", "SNOOZE_LIMIT", "APPLIED"]
    assert found[-1][2] == 3


def test_unknown_and_foreign_schedules_are_refused(act):
    assert act([("TAKEN", None, None)], schedule=2)[0][0][0] == "SCHEDULE_NOT_FOUND"
    assert act([("TAKEN", None, None)], user=2)[0][0][0] == "FORBIDDEN"


def _simulated(created, answers, until):
    """Deliveries minute by minute, with answers at their own times."""
    out = []
    for i, at in created.items():
        clock, state, tries, nxt = at, "PENDING", 0, at
        out.append((i, clock, state, tries, nxt))
        told = sorted((a, ok, allowed) for j, a, ok, allowed in answers if j == i)
        while True:
            answer = told[0][0] if told else None
            wake = nxt if nxt is not None and tries < 5 else None
            if answer is None and wake is None:
                break
            if wake is None or (answer is not None and answer <= wake):
                a, ok, allowed = told.pop(0)
                if state != "PROCESSING":
                    continue
                clock, state = a, "SENT" if ok else "FAILED"
                nxt = a + min(60, 2**tries) * 60_000_000 if not ok and allowed and tries < 5 else None
            else:
                clock, state, tries = wake, "PROCESSING", tries + 1
                nxt = wake + 600_000_000
            out.append((i, clock, state, tries, nxt))
    return sorted(out, key=repr)


def _micros(t):
    return None if t is None else int(t.replace(tzinfo=t.tzinfo or dt.timezone.utc).timestamp() * 1_000_000)


def test_deliveries_are_those_of_a_simulation_on_a_whole_table(spark, sf_dir):
    created, answers = T.messages(spark, sf_dir)
    rows = M.outbox_history(created, answers, 4_000_000_000_000_000)
    found = [tuple(r) for r in rows.select("message_id", M.micros(F.col("at")), "state", "tries", M.micros(F.col("next_at"))).collect()]
    told = [tuple(r) for r in answers.select("message_id", M.micros(F.col("at")), "ok", "allowed").collect()]
    new = {r[0]: r[1] for r in created.select("message_id", M.micros(F.col("at"))).collect()}
    assert sorted(found, key=repr) == _simulated(new, told, None)
    assert {"SENT", "FAILED", "PROCESSING"} <= {f[2] for f in found} and max(f[3] for f in found) == 5


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    yield
    spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)


def _streamed(spark, tmp_path, parts, build, rounds=2):
    """Rows of a stream over files of rows in shuffled order, run in several starts from one checkpoint."""
    schema, home = parts[0].schema, tmp_path
    per_round = -(-len(parts) // rounds)
    for i in range(rounds):
        for n, part in enumerate(parts[i * per_round : (i + 1) * per_round]):
            part.coalesce(1).write.parquet(str(home / f"part-{i:02d}-{n:02d}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(home / "part-*"))
        out = build(stream).writeStream.format("parquet").option("path", str(home / "out")).option("checkpointLocation", str(home / "checkpoint"))
        query = out.trigger(availableNow=True).start()
        assert query.awaitTermination(240)
    return spark.read.parquet(str(home / "out"))


def _shuffled(df, at, key, n=4):
    """df in n parts of mixed order, then a row of another key far ahead, which moves the watermark past all others."""
    rows = [r.asDict() for r in df.collect()]
    random.Random(5).shuffle(rows)
    last = dict(rows[0]) | {at: dt.datetime(2030, 1, 1), **key}
    groups = [rows[i::n] for i in range(n)] + [[last], [last | {at: dt.datetime(2031, 1, 1)}]]
    spark = df.sparkSession
    return [spark.createDataFrame([tuple(r[c] for c in df.columns) for r in g], df.schema) for g in groups]


def test_streamed_actions_are_those_of_the_batch(spark, sf_dir, tmp_path, rocks):
    actions, schedules, doses = T.actions(spark, sf_dir)
    actions, doses = actions.where("user_id < 30"), doses.cache()
    want = M.dose_actions(actions, schedules, doses).where("status is not null")
    parts = _shuffled(actions, "at", {"action_id": -1, "schedule_id": -1, "user_id": -1, "status": "TAKEN", "snooze_until": None})
    ends = spark.createDataFrame([(-1, t, -1, "PENDING", 0) for t in (dt.datetime(2024, 1, 20, 8), dt.datetime(2024, 1, 20, 20))], doses.schema)
    plans = schedules.union(spark.createDataFrame([(-1, -1, 0, 1)], schedules.schema))
    got = _streamed(spark, tmp_path, parts, lambda s: S.dose_actions(s, plans, doses.union(ends), late="400 days"))
    found = sorted(map(tuple, M.times(got, "scheduled_at", "at", "snooze_until").where("action_id >= 0").select(want.columns).collect()), key=repr)
    assert found == sorted(map(tuple, want.collect()), key=repr) and len(found) > 100


def test_streamed_reminders_are_those_of_the_windows(spark, sf_dir, tmp_path, rocks):
    changes = T.changes(spark, sf_dir).where("dose_id < 3000")
    want = M.reminder_history(changes)
    parts = _shuffled(changes, "at", {"dose_id": -1})
    got = M.times(_streamed(spark, tmp_path, parts, lambda s: S.reminders(s, late="400 days")), "due")
    found = sorted(map(tuple, got.where("dose_id >= 0").select(want.columns).collect()), key=repr)
    assert found == sorted(map(tuple, want.collect()), key=repr) and len(found) > 30


def test_streamed_deliveries_are_those_of_the_batch(spark, sf_dir, tmp_path, rocks):
    created, answers = (df.where("message_id < 60") for df in T.messages(spark, sf_dir))
    want = M.outbox_history(created, answers, 1_800_000_000_000_000)
    rows = M.outbox_events(created, answers).withColumn("at", F.timestamp_micros("at"))
    parts = _shuffled(rows, "at", {"message_id": -1, "ok": None})
    build = lambda s: S.kept(s.withColumn("at", M.micros(F.col("at"))), ["message_id"], ["ok"], M.Outbox, M.DELIVERY, "4000 days")
    got = M.times(_streamed(spark, tmp_path, parts, build), "at", "next_at")
    found = sorted(map(tuple, got.where("message_id >= 0").select(want.columns).collect()), key=repr)
    assert found == sorted(map(tuple, want.collect()), key=repr) and len(found) > 100
