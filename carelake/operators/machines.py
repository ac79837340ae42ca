"""State machines of single records, which batch folds and streams run alike.

A machine takes what happens to one record in order of time, all times being whole microseconds, and may ask to be woken
at a later time. Its state is a dict of plain values, so that a stream can keep it between batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.operators.folds import folded

MINUTE = 60_000_000
HOUR = 60 * MINUTE


class Machine:
    """Base: what happens changes `state`; results are tuples."""

    def __init__(self, state: dict | None = None):
        self.state = self.fresh() if state is None else state

    def fresh(self) -> dict:
        return {}

    def take(self, row: dict) -> list[tuple]:
        """What a row with `at` does."""
        raise NotImplementedError

    def due(self) -> int | None:
        """When the machine next does something by itself."""
        return None

    def wake(self, at: int) -> list[tuple]:
        """What it does then; due() is another time or None behind it."""
        return []

    def over(self) -> int | None:
        """When its state may be forgotten, if that is known yet."""
        return None

    def until(self, at: int, included: bool) -> list[tuple]:
        """What it does by itself before a time, or up to and with it."""
        out = []
        while (due := self.due()) is not None and (due <= at if included else due < at):
            out += self.wake(due)
        return out


class _Run:
    """A fold of a machine: rows in order, with what the machine does between them."""

    def __init__(self, machine: type[Machine], names: list[str], end: int | None):
        self.machine, self.names, self.end = machine(), names, end

    def add(self, *values):
        row = dict(zip(self.names, values))
        return [*self.machine.until(row["at"], False), *self.machine.take(row)]

    def done(self):
        return self.machine.until(self.end, True) if self.end is not None else []


def run(rows: DataFrame, keys: list[str], order: list[str], machine: type[Machine], schema: str, until: int | None = None) -> DataFrame:
    """The results of a machine for each key, over rows with `at`; with until, of what it does by itself up to then too."""
    names = list(rows.columns)
    return folded(rows, keys, [F.col("at"), *[F.col(c) for c in order]], lambda *_: _Run(machine, names, until), schema)


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def times(df: DataFrame, *columns: str) -> DataFrame:
    """df with columns of microseconds as timestamps."""
    return df.withColumns({c: F.timestamp_micros(c) for c in columns})


#: The most snoozes of a dose, and how far ahead one may be.
MOST_SNOOZES, SNOOZE_HOURS = 3, 12
ACTION_RESULT = "action_id long, schedule_id long, scheduled_at long, at long, outcome string, status string, snooze_count long, snooze_until long, changed boolean"


class DoseActions(Machine):
    """A scheduled dose: replays change nothing, TAKEN is final, snoozes are counted.

    What a client's id did before is told again for it; without an id one is made of the request, so that a repeated
    request is a replay. Ids count within their dose. State is forgotten some days after the last action.
    """

    KEEP = 30 * 24 * HOUR

    def fresh(self) -> dict:
        return {"status": None, "snoozes": 0, "until": None, "seen": [], "last": 0}

    def take(self, row: dict) -> list[tuple]:
        s = self.state
        if s["status"] is None:
            s["status"], s["snoozes"] = row["dose_status"], row["dose_snoozes"]
        s["last"] = row["at"]
        wanted, client = row["status"], row["client_id"]
        if client in s["seen"]:
            outcome = "REPLAYED"
        elif s["status"] == "TAKEN":
            outcome = "ALREADY_TAKEN" if wanted == "TAKEN" else "TAKEN_IS_FINAL"
        elif wanted == "SNOOZED" and s["snoozes"] >= MOST_SNOOZES:
            outcome = "SNOOZE_LIMIT"
        else:
            outcome = "APPLIED"
            s["status"], s["until"] = wanted, row["snooze_until"] if wanted == "SNOOZED" else None
            s["snoozes"] += wanted == "SNOOZED"
        if outcome in ("APPLIED", "ALREADY_TAKEN"):
            s["seen"] = [*s["seen"], client]
        return [(row["action_id"], row["schedule_id"], row["scheduled_at"], row["at"], outcome, s["status"], s["snoozes"], s["until"], outcome == "APPLIED")]

    def over(self) -> int | None:
        return self.state["last"] + self.KEEP


def checked_actions(actions: DataFrame, schedules: DataFrame, doses: DataFrame) -> DataFrame:
    """Actions with `refused`, the reason that needs no state, or null, and what the machine needs; batch or stream.

    actions: action_id, user_id, schedule_id, scheduled_at, status, snooze_until, client_action_id, at. schedules:
    schedule_id, owner. doses: schedule_id, scheduled_at, user_id, status, snooze_count.
    """
    known = doses.select("schedule_id", "scheduled_at", F.col("user_id").alias("dose_user"), F.col("status").alias("dose_status"), F.col("snooze_count").alias("dose_snoozes"))
    rows = actions.join(schedules.select("schedule_id", "owner"), "schedule_id", "left").join(known, ["schedule_id", "scheduled_at"], "left")
    snooze = F.col("status") == "SNOOZED"
    until = micros(F.col("snooze_until"))
    ahead = until - micros(F.col("at"))
    refused = (
        F.when(F.col("owner").isNull(), "SCHEDULE_NOT_FOUND")
        .when(F.col("owner") != F.col("user_id"), "FORBIDDEN")
        .when(snooze & until.isNull(), "SNOOZE_UNTIL_REQUIRED")
        .when((ahead <= 0) | (ahead > SNOOZE_HOURS * HOUR), "SNOOZE_UNTIL_INVALID")
        .when(F.col("dose_user").isNull() | (F.col("dose_user") != F.col("user_id")), "DOSE_NOT_FOUND")
    )
    made = F.concat_ws(":", "schedule_id", micros(F.col("scheduled_at")), "status", F.coalesce(until.cast("string"), F.lit("")))
    client = F.concat_ws(":", "user_id", F.coalesce("client_action_id", made))
    return rows.select(
        "action_id", "schedule_id", micros(F.col("scheduled_at")).alias("scheduled_at"), micros(F.col("at")).alias("at"), "status", until.alias("snooze_until"),
        client.alias("client_id"), "dose_status", F.coalesce(F.col("dose_snoozes").cast("long"), F.lit(0)).alias("dose_snoozes"), refused.alias("refused"),
    )


def refusals(checked: DataFrame) -> DataFrame:
    none = F.lit(None)
    return checked.where("refused is not null").select(
        "action_id", "schedule_id", "scheduled_at", "at", F.col("refused").alias("outcome"), none.cast("string").alias("status"),
        none.cast("long").alias("snooze_count"), none.cast("long").alias("snooze_until"), F.lit(False).alias("changed"),
    )


def dose_actions(actions: DataFrame, schedules: DataFrame, doses: DataFrame) -> DataFrame:
    """What each action does (ACTION_RESULT, times as timestamps), in order of time and then action_id of each dose."""
    checked = checked_actions(actions, schedules, doses)
    done = run(checked.where("refused is null").drop("refused"), ["schedule_id", "scheduled_at"], ["action_id"], DoseActions, ACTION_RESULT)
    return times(done.union(refusals(checked)), "scheduled_at", "at", "snooze_until")


def stock_after(results: DataFrame, schedules: DataFrame, medicines: DataFrame) -> DataFrame:
    """(medicine_id, remaining): what is left once each dose that became TAKEN has gone off it, never below zero.

    schedules: schedule_id, medicine_id, doses_per_intake (null: 1). A null stock stays null.
    """
    taken = results.where("changed and status = 'TAKEN'").join(schedules, "schedule_id")
    used = taken.groupBy("medicine_id").agg(F.sum(F.coalesce("doses_per_intake", F.lit(1))).alias("used"))
    left = F.greatest(F.lit(0), F.col("remaining") - F.coalesce("used", F.lit(0)))
    return medicines.join(used, "medicine_id", "left").select("medicine_id", F.when(F.col("remaining").isNotNull(), left).alias("remaining"))


#: Minutes that a reminder comes ahead of its dose.
AHEAD = 15
REMINDER = "dose_id long, kind string, key string, due long"


class Reminders(Machine):
    """A dose and its changes: one reminder ahead of it while it is pending, and one for each snooze that ends.

    Rows have at, status, scheduled_at, snooze_until, schedule_active and user_active. A reminder waits for both the
    schedule and the user to be active, the end of a snooze for the user only.
    """

    KEEP = 24 * HOUR

    def fresh(self) -> dict:
        return {"row": None, "sent": []}

    def take(self, row: dict) -> list[tuple]:
        self.state["row"] = row
        return []

    def _next(self) -> tuple[int, str, str] | None:
        row = self.state["row"]
        if row is None or not row["user_active"]:
            return None
        if row["status"] == "PENDING" and row["schedule_active"]:
            due, kind, key = max(row["at"], row["scheduled_at"] - AHEAD * MINUTE), "UPCOMING", str(row["dose_id"])
            if due > row["scheduled_at"]:
                return None
        elif row["status"] == "SNOOZED" and row["snooze_until"] is not None:
            due, kind, key = max(row["at"], row["snooze_until"]), "SNOOZE", f"{row['dose_id']}:{row['snooze_until']}"
        else:
            return None
        return None if key in self.state["sent"] else (due, kind, key)

    def due(self) -> int | None:
        found = self._next()
        return found[0] if found else None

    def wake(self, at: int) -> list[tuple]:
        due, kind, key = self._next()
        self.state["sent"] = [*self.state["sent"], key]
        return [(self.state["row"]["dose_id"], kind, key, due)]

    def over(self) -> int | None:
        row = self.state["row"]
        return max(row["scheduled_at"], row["at"], row["snooze_until"] or 0) + self.KEEP if row else None


def reminder_changes(changes: DataFrame) -> DataFrame:
    """Changes as the machine takes them: times in microseconds, and no flag null."""
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("schedule_active", "user_active")}
    spans = {c: micros(F.col(c)) for c in ("at", "scheduled_at", "snooze_until")}
    names = ("dose_id", "change_id", "at", "status", "scheduled_at", "snooze_until", "schedule_active", "user_active")
    return changes.withColumns(flags | spans).select(*names)


def reminder_history(changes: DataFrame) -> DataFrame:
    """(dose_id, kind, key, due) of all reminders that a history of changes gives: windows instead of the machine.

    A change holds until the next one of its dose; of a reminder that several changes would send, the first counts.
    """
    from pyspark.sql import Window

    rows = reminder_changes(changes)
    ahead = F.lead("at").over(Window.partitionBy("dose_id").orderBy("at", "change_id"))
    upcoming = F.greatest("at", F.col("scheduled_at") - AHEAD * MINUTE)
    pending = (F.col("status") == "PENDING") & F.col("schedule_active") & F.col("user_active") & (upcoming <= F.col("scheduled_at"))
    woken = (F.col("status") == "SNOOZED") & F.col("user_active") & F.col("snooze_until").isNotNull()
    plain = F.col("dose_id").cast("string")
    snooze = F.concat_ws(":", plain, "snooze_until")

    def reminder(kind: str, key: Column, due: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), due.alias("due"))

    told = F.when(pending, reminder("UPCOMING", plain, upcoming)).when(woken, reminder("SNOOZE", snooze, F.greatest("at", "snooze_until")))
    rows = rows.withColumn("ends", ahead).withColumn("r", told).where("r is not null and (ends is null or r.due < ends)")
    found = rows.groupBy("dose_id", "r.kind", "r.key").agg(F.min("r.due").alias("due"))
    return times(found, "due")


#: The most tries of a delivery, minutes until a claim is stale, the longest wait, and messages claimed at a time.
MOST_TRIES, STALE, LONGEST_WAIT, BATCH = 5, 10, 60, 50
DELIVERY = "message_id long, at long, state string, tries long, next_at long"


class Outbox(Machine):
    """A message from its creation to SENT or its last FAILED: claims, answers, waits that double, stale claims again.

    Rows have at and ok: null for the creation, else an answer, which counts while a claim is open. `allowed` false
    ends a message without another try.
    """

    KEEP = 24 * HOUR

    def fresh(self) -> dict:
        return {"id": None, "state": None, "tries": 0, "next": None, "last": 0}

    def _tell(self, at: int) -> list[tuple]:
        self.state["last"] = at
        return [(self.state["id"], at, self.state["state"], self.state["tries"], self.state["next"])]

    def take(self, row: dict) -> list[tuple]:
        s = self.state
        if s["state"] is None and row["ok"] is None:
            s |= {"id": row["message_id"], "state": "PENDING", "next": row["at"]}
            return self._tell(row["at"])
        if s["state"] != "PROCESSING" or row["ok"] is None:
            return []
        if row["ok"]:
            s |= {"state": "SENT", "next": None}
        elif not row["allowed"] or s["tries"] >= MOST_TRIES:
            s |= {"state": "FAILED", "next": None}
        else:
            s |= {"state": "FAILED", "next": row["at"] + min(LONGEST_WAIT, 2 ** s["tries"]) * MINUTE}
        return self._tell(row["at"])

    def due(self) -> int | None:
        return self.state["next"] if self.state["tries"] < MOST_TRIES else None

    def wake(self, at: int) -> list[tuple]:
        s = self.state
        s |= {"state": "PROCESSING", "tries": s["tries"] + 1, "next": at + STALE * MINUTE}
        return self._tell(at)

    def over(self) -> int | None:
        return self.state["last"] + self.KEEP


def outbox_events(created: DataFrame, answers: DataFrame) -> DataFrame:
    """created (message_id, at) and answers (message_id, at, ok, allowed) as rows of the machine, creations first."""
    new = created.select("message_id", micros(F.col("at")).alias("at"), F.lit(None).cast("boolean").alias("ok"), F.lit(True).alias("allowed"))
    told = answers.where("ok is not null").select("message_id", micros(F.col("at")).alias("at"), "ok", F.coalesce("allowed", F.lit(True)).alias("allowed"))
    return new.union(told)


def outbox_history(created: DataFrame, answers: DataFrame, until: int) -> DataFrame:
    """Every state that each message goes through up to a time, as DELIVERY with timestamps."""
    found = run(outbox_events(created, answers), ["message_id"], ["ok"], Outbox, DELIVERY, until)
    return times(found, "at", "next_at")


def due_messages(outbox: DataFrame, now: Column) -> Column:
    """Whether a message may be claimed: pending or failed and due, or claimed too long ago, with tries left."""
    waited = F.col("claimed_at") <= now - F.make_dt_interval(mins=F.lit(STALE))
    pending = (F.col("state") == "PENDING") & (F.col("next_at").isNull() | (F.col("next_at") <= now))
    again = (F.col("state") == "FAILED") & (F.col("next_at") <= now)
    return (F.col("tries") < MOST_TRIES) & F.coalesce(pending | again | ((F.col("state") == "PROCESSING") & waited), F.lit(False))


def claim(outbox: DataFrame, now: Column, most: int = BATCH) -> DataFrame:
    """The outbox (message_id, state, tries, created_at, next_at, claimed_at) after one round of claims.

    The oldest due messages are claimed, at most so many: the batch of a worker. Which they are is found by a top-k, so
    the join back has that many rows on one side.
    """
    oldest = outbox.where(due_messages(outbox, now)).orderBy("created_at", "message_id").limit(most).select("message_id", F.lit(True).alias("mine"))
    rows = outbox.join(F.broadcast(oldest), "message_id", "left")
    mine = F.col("mine").isNotNull()
    return rows.select(
        "message_id",
        F.when(mine, F.lit("PROCESSING")).otherwise(F.col("state")).alias("state"),
        (F.col("tries") + mine.cast("int")).alias("tries"),
        "created_at",
        "next_at",
        F.when(mine, now).otherwise(F.col("claimed_at")).alias("claimed_at"),
        mine.alias("mine"),
    )


def settle(outbox: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """The outbox after answers (message_id, ok, allowed) to open claims: sent, or failed with the next try's time."""
    rows = outbox.join(answers, "message_id", "left")
    answered = (F.col("state") == "PROCESSING") & F.col("ok").isNotNull()
    allowed = F.coalesce("allowed", F.lit(True))
    again = allowed & (F.col("tries") < MOST_TRIES)
    wait = now + F.make_dt_interval(mins=F.least(F.lit(LONGEST_WAIT), F.pow(F.lit(2), F.col("tries"))).cast("int"))
    failed = answered & ~F.col("ok")
    return rows.select(
        "message_id",
        F.when(answered, F.when(F.col("ok"), F.lit("SENT")).otherwise(F.lit("FAILED"))).otherwise(F.col("state")).alias("state"),
        "tries",
        "created_at",
        F.when(failed & again, wait).when(~answered, F.col("next_at")).alias("next_at"),
        F.when(~(failed & allowed), F.col("claimed_at")).alias("claimed_at"),
    )
