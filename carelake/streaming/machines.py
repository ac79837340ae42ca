"""State machines as streams: rows are put in order of event time, timers wake the machine, and state is forgotten."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from carelake.operators import machines as M
from carelake.shipping import ship

#: The column that the watermark reads; machines read whole microseconds.
EVENT_TIME = "event_time"


class Keeper(StatefulProcessor):
    """Runs a machine for each key.

    Rows wait in a list until the watermark has passed them, so what comes in any order within the allowed lateness is
    taken in order of time. A timer stands at each waiting row, at the time at which the machine wakes, and at the time
    at which its state is dropped, so idle keys hold nothing.
    """

    def __init__(self, machine: type[M.Machine], order: list[str], result: str):
        self.machine, self.order, self.names = machine, order, [f.split()[0] for f in result.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("machine", "data string")
        self.waiting = handle.getListState("waiting", "data string")

    def _after(self, at: int) -> int:
        """A timer's milliseconds, which come strictly behind a time in microseconds."""
        return at // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            told = {k: v for k, v in row.asDict().items() if k != EVENT_TIME}
            self.waiting.appendValue((json.dumps(told),))
            self.handle.registerTimer(self._after(told["at"]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # Nothing earlier than the watermark is still to come, so all up to there is done at once.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        state = json.loads(self.held.get()[0]) if self.held.exists() else None
        machine = self.machine(state)
        rows = [json.loads(x[0]) for x in self.waiting.get()] if self.waiting.exists() else []
        ready = [r for r in rows if r["at"] < now]
        out = []
        for row in sorted(ready, key=lambda r: (r["at"], *((r[c] is not None, r[c]) for c in self.order))):
            out += [*machine.until(row["at"], False), *machine.take(row)]
        out += machine.until(now - 1, True)
        later = [r for r in rows if r["at"] >= now]
        if ready:
            self.waiting.put([(json.dumps(r),) for r in later]) if later else self.waiting.clear()
        over, due = machine.over(), machine.due()
        if not later and due is None and over is not None and over < now:
            self.held.clear()
        elif state is not None or ready:
            self.held.update((json.dumps(machine.state),))
            if due is not None:
                self.handle.registerTimer(self._after(due))
            elif over is not None:
                self.handle.registerTimer(self._after(over))
        return iter([Row(**dict(zip(self.names, x))) for x in out])

    def close(self) -> None:
        pass


def kept(rows: DataFrame, keys: list[str], order: list[str], machine: type[M.Machine], result: str, late: str) -> DataFrame:
    """A machine's results as a stream; rows have `at` in microseconds and may be late by `late`.

    The session must keep its state in RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    ship(rows.sparkSession)
    timed = rows.withColumn(EVENT_TIME, F.timestamp_micros("at")).withWatermark(EVENT_TIME, late)
    return timed.groupBy(*keys).transformWithState(Keeper(machine, order, result), result, "append", "EventTime")


def dose_actions(actions: DataFrame, schedules: DataFrame, doses: DataFrame, late: str = "10 minutes") -> DataFrame:
    """What each action of a stream does, once its time has passed; as machines.dose_actions, but for refused ones."""
    checked = M.checked_actions(actions, schedules, doses).where("refused is null").drop("refused")
    return kept(checked, ["schedule_id", "scheduled_at"], ["action_id"], M.DoseActions, M.ACTION_RESULT, late)


def refused_actions(actions: DataFrame, schedules: DataFrame, doses: DataFrame) -> DataFrame:
    """The actions of a stream that are refused without regard to earlier ones; needs no state."""
    return M.refusals(M.checked_actions(actions, schedules, doses))


def reminders(changes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Reminders of a stream of changes, each at its time."""
    return kept(M.reminder_changes(changes), ["dose_id"], ["change_id"], M.Reminders, M.REMINDER, late)


def deliveries(created: DataFrame, answers: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Every state of the messages of a stream of creations and one of answers."""
    return kept(M.outbox_events(created, answers), ["message_id"], ["ok"], M.Outbox, M.DELIVERY, late)
