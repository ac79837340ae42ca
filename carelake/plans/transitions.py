"""Queries of state machines: dose actions, reminders over time and the outbox."""

from pyspark.sql import functions as F

from carelake.operators import machines as M
from carelake.plans.registry import query
from carelake.sources.views import table

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_STATUS = {"purchase": "TAKEN", "error": "MISSED", "signup": "SKIPPED"}


def _events(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), k.alias("k"))


def actions(spark, sf_dir):
    """Events as actions on two doses of each user, with the schedules and doses that they are about."""
    e = _events(spark, sf_dir)
    half = F.when(F.col("event_id") % 2 == 0, F.lit("2024-01-20 08:00:00")).otherwise(F.lit("2024-01-20 20:00:00")).cast("timestamp")
    status = F.coalesce(F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])[F.col("event_type")], F.lit("SNOOZED"))
    until = F.when((status == "SNOOZED") & (F.col("k") % 10 != 9), F.col("ts") + F.make_dt_interval(mins=(F.col("k") * 10 - 30).cast("int")))
    given = e.select(
        F.col("event_id").alias("action_id"), "user_id", F.col("user_id").alias("schedule_id"), half.alias("scheduled_at"), status.alias("status"),
        until.alias("snooze_until"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("c"), F.col("k") % 7)).alias("client_action_id"), F.col("ts").alias("at"),
    )
    user = F.col("user_id")
    schedules = e.where("user_id % 13 != 0").select(
        user.alias("schedule_id"), F.when(user % 17 == 0, user + 1).otherwise(user).alias("owner"), (user % 20).alias("medicine_id"), F.when(user % 3 != 0, user % 3).alias("doses_per_intake")
    ).distinct()
    doses = given.where("schedule_id % 11 != 0").select(
        "schedule_id", "scheduled_at", "user_id", F.when(user % 19 == 0, F.lit("TAKEN")).otherwise(F.lit("PENDING")).alias("status"), (user % 3).alias("snooze_count")
    ).distinct()
    return given, schedules, doses


_ACTIONS = f"""e AS (SELECT event_id AS action_id, user_id, ts AS moment, {_K} AS k, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-01-20 08:00:00' ELSE TIMESTAMP '2024-01-20 20:00:00' END AS scheduled_at,
      CASE event_type WHEN 'purchase' THEN 'TAKEN' WHEN 'error' THEN 'MISSED' WHEN 'signup' THEN 'SKIPPED' ELSE 'SNOOZED' END AS status FROM events),
    a AS (SELECT *, CASE WHEN status = 'SNOOZED' AND k % 10 != 9 THEN moment + to_minutes(k * 10 - 30) END AS until FROM e),
    c AS (SELECT *, CASE WHEN user_id % 13 = 0 THEN 'SCHEDULE_NOT_FOUND' WHEN user_id % 17 = 0 THEN 'FORBIDDEN' WHEN status = 'SNOOZED' AND until IS NULL THEN 'SNOOZE_UNTIL_REQUIRED'
      WHEN until <= moment OR until > moment + INTERVAL 12 HOUR THEN 'SNOOZE_UNTIL_INVALID' WHEN user_id % 11 = 0 THEN 'DOSE_NOT_FOUND' END AS refused,
      coalesce(CASE WHEN k % 3 = 0 THEN 'c' || CAST(k % 7 AS VARCHAR) END, status || ':' || coalesce(CAST(until AS VARCHAR), '')) AS client FROM a),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id, scheduled_at ORDER BY moment, action_id) AS n FROM c WHERE refused IS NULL),
    f AS (SELECT user_id, scheduled_at, 0::BIGINT AS n, 0::BIGINT AS action_id, CASE WHEN user_id % 19 = 0 THEN 'TAKEN' ELSE 'PENDING' END AS state, user_id % 3 AS snoozes, NULL::TIMESTAMP AS till, []::VARCHAR[] AS seen, '' AS outcome, NULL::TIMESTAMP AS moment
            FROM (SELECT DISTINCT user_id, scheduled_at FROM o)
          UNION ALL
          SELECT user_id, scheduled_at, n, action_id, CASE WHEN told = 'APPLIED' THEN status ELSE state END, CASE WHEN told = 'APPLIED' AND status = 'SNOOZED' THEN snoozes + 1 ELSE snoozes END,
                 CASE WHEN told = 'APPLIED' THEN until ELSE till END, CASE WHEN told IN ('APPLIED', 'ALREADY_TAKEN') THEN list_append(seen, client) ELSE seen END, told, moment
          FROM (SELECT f.user_id, f.scheduled_at, o.n, o.action_id, o.status, o.client, o.moment, f.state, f.snoozes, f.till, f.seen, o.until,
                  CASE WHEN list_contains(f.seen, o.client) THEN 'REPLAYED' WHEN f.state = 'TAKEN' AND o.status = 'TAKEN' THEN 'ALREADY_TAKEN' WHEN f.state = 'TAKEN' THEN 'TAKEN_IS_FINAL'
                       WHEN o.status = 'SNOOZED' AND f.snoozes >= 3 THEN 'SNOOZE_LIMIT' ELSE 'APPLIED' END AS told
                FROM f JOIN o ON o.user_id = f.user_id AND o.scheduled_at = f.scheduled_at AND o.n = f.n + 1)),
    d AS (SELECT action_id, user_id AS schedule_id, scheduled_at, moment, outcome, state AS status, snoozes AS snooze_count, till AS snooze_until, outcome = 'APPLIED' AS changed FROM f WHERE n > 0
          UNION ALL SELECT action_id, user_id, scheduled_at, moment, refused, NULL, NULL, NULL, FALSE FROM c WHERE refused IS NOT NULL)"""


@query(f'WITH RECURSIVE {_ACTIONS} SELECT action_id, schedule_id, scheduled_at, moment AS "at", outcome, status, snooze_count, snooze_until, changed FROM d')
def dose_actions(spark, sf_dir):
    """What each action on a dose does: replays, final doses, at most three snoozes, refusals."""
    return M.dose_actions(*actions(spark, sf_dir))


@query(f"""WITH RECURSIVE {_ACTIONS}, u AS (SELECT schedule_id % 20 AS medicine_id, sum(CASE WHEN schedule_id % 3 = 0 THEN 1 ELSE schedule_id % 3 END) AS used FROM d WHERE changed AND status = 'TAKEN' GROUP BY 1),
    m AS (SELECT p_partkey AS medicine_id, CASE WHEN p_partkey % 7 != 0 THEN p_size END AS remaining FROM part)
    SELECT m.medicine_id, CASE WHEN remaining IS NOT NULL THEN greatest(0, remaining - coalesce(used, 0))::BIGINT END AS remaining FROM m LEFT JOIN u USING (medicine_id)""")
def stock_after_actions(spark, sf_dir):
    """Stock goes down once for each dose that became TAKEN."""
    given, schedules, doses = actions(spark, sf_dir)
    stock = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("medicine_id"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("long")).alias("remaining"))
    return M.stock_after(M.dose_actions(given, schedules, doses), schedules, stock)


def changes(spark, sf_dir):
    """Events as changes of doses: ten consecutive users share a dose of every day."""
    at, k = F.col("ts"), F.col("k")
    return _events(spark, sf_dir).select(
        (F.floor(F.col("user_id") / 10) * 1000 + F.dayofyear("ts")).cast("long").alias("dose_id"),
        F.col("event_id").alias("change_id"),
        at.alias("at"),
        F.when(F.col("event_type").isin("view", "error", "signup"), F.lit("PENDING")).when(F.col("event_type") == "click", F.lit("SNOOZED")).otherwise(F.lit("TAKEN")).alias("status"),
        (F.date_trunc("day", at) + F.make_dt_interval(hours=(F.floor(F.col("user_id") / 10) % 24).cast("int"))).alias("scheduled_at"),
        F.when(F.col("event_type") == "click", at + F.make_dt_interval(mins=(k * 5).cast("int"))).alias("snooze_until"),
        (k % 10 != 3).alias("schedule_active"),
        F.when(k % 10 != 5, k % 10 != 4).alias("user_active"),
    )


@query(f"""WITH e AS (SELECT event_id, user_id // 10 AS g, ts AS moment, event_type AS t, {_K} AS k FROM events),
    c AS (SELECT g * 1000 + dayofyear(moment) AS dose_id, event_id, moment, CASE WHEN t IN ('view', 'error', 'signup') THEN 'PENDING' WHEN t = 'click' THEN 'SNOOZED' ELSE 'TAKEN' END AS status,
            date_trunc('day', moment) + to_hours(g % 24) AS planned, CASE WHEN t = 'click' THEN moment + to_minutes(k * 5) END AS until, k % 10 != 3 AS schedule_active, k % 10 NOT IN (4, 5) AS user_active FROM e),
    r AS (SELECT *, lead(moment) OVER (PARTITION BY dose_id ORDER BY moment, event_id) AS ends, CASE WHEN status = 'PENDING' THEN greatest(moment, planned - INTERVAL 15 MINUTE) ELSE greatest(moment, until) END AS due FROM c),
    s AS (SELECT *, CASE WHEN status = 'PENDING' THEN 'UPCOMING' ELSE 'SNOOZE' END AS kind FROM r WHERE user_active AND (ends IS NULL OR due < ends)
          AND ((status = 'PENDING' AND schedule_active AND due <= planned) OR (status = 'SNOOZED' AND until IS NOT NULL)))
    SELECT CAST(dose_id AS BIGINT) AS dose_id, kind, CAST(dose_id AS VARCHAR) || CASE WHEN kind = 'SNOOZE' THEN ':' || CAST(epoch_us(until) AS VARCHAR) ELSE '' END AS key, min(due) AS due FROM s GROUP BY 1, 2, 3""")
def reminder_history(spark, sf_dir):
    """All reminders that the changes of doses give, each at its time, for active schedules and users."""
    return M.reminder_history(changes(spark, sf_dir))


def messages(spark, sf_dir):
    """Orders as messages, and several answers to some of them some minutes later."""
    orders = table(spark, sf_dir, "orders")
    key, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    created = orders.select(key.alias("message_id"), at.alias("at"))
    later = F.explode(F.filter(F.sequence(F.lit(1), F.lit(7)), lambda i: (key + i) % 4 != 0)).alias("i")
    answers = orders.select(key.alias("message_id"), at.alias("at"), later)
    answers = answers.select(
        "message_id", (F.col("at") + F.make_dt_interval(mins=(F.col("i") * (F.col("message_id") % 13 + 1)).cast("int"))).alias("at"),
        ((F.col("message_id") + F.col("i")) % 9 == 0).alias("ok"), ((F.col("message_id") * F.col("i")) % 31 != 7).alias("allowed"),
    )
    return created, answers


@query()
def outbox_history(spark, sf_dir):
    """All states of all messages: claims, answers, waits, stale claims; compared with a simulation in the tests."""
    return M.outbox_history(*messages(spark, sf_dir), until=4_000_000_000_000_000)


_NOW = "1997-06-01 00:00:00"
_OUTBOX = f"""o AS (SELECT o_orderkey AS message_id, ['PENDING', 'PROCESSING', 'SENT', 'FAILED'][o_orderkey % 4 + 1] AS state, o_orderkey % 6 AS tries, o_orderdate AS created_at,
      CASE WHEN o_orderkey % 5 != 0 THEN TIMESTAMP '{_NOW}' + to_minutes((o_orderkey % 60) - 40) END AS next_at, CASE WHEN o_orderkey % 4 = 1 THEN TIMESTAMP '{_NOW}' - to_minutes(o_orderkey % 23) END AS claimed_at FROM orders),
    d AS (SELECT message_id, row_number() OVER (ORDER BY created_at, message_id) AS place FROM o WHERE tries < 5 AND ((state = 'PENDING' AND (next_at IS NULL OR next_at <= TIMESTAMP '{_NOW}'))
      OR (state = 'FAILED' AND next_at <= TIMESTAMP '{_NOW}') OR (state = 'PROCESSING' AND claimed_at <= TIMESTAMP '{_NOW}' - INTERVAL 10 MINUTE))),
    c AS (SELECT o.message_id, CASE WHEN place <= 50 THEN 'PROCESSING' ELSE state END AS state, CAST(CASE WHEN place <= 50 THEN tries + 1 ELSE tries END AS BIGINT) AS tries, created_at, next_at,
      CASE WHEN place <= 50 THEN TIMESTAMP '{_NOW}' ELSE claimed_at END AS claimed_at, coalesce(place <= 50, FALSE) AS mine FROM o LEFT JOIN d USING (message_id))"""


def _outbox(spark, sf_dir):
    key, now = F.col("o_orderkey"), F.lit(_NOW).cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        key.alias("message_id"),
        F.element_at(F.array(*[F.lit(s) for s in ("PENDING", "PROCESSING", "SENT", "FAILED")]), (key % 4 + 1).cast("int")).alias("state"),
        (key % 6).alias("tries"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(key % 5 != 0, now + F.make_dt_interval(mins=(key % 60 - 40).cast("int"))).alias("next_at"),
        F.when(key % 4 == 1, now - F.make_dt_interval(mins=(key % 23).cast("int"))).alias("claimed_at"),
    )


@query(f"WITH {_OUTBOX} SELECT * FROM c")
def outbox_claims(spark, sf_dir):
    """One round of claims: the 50 oldest due messages."""
    return M.claim(_outbox(spark, sf_dir), F.lit(_NOW).cast("timestamp"))


@query(f"""WITH {_OUTBOX}, r AS (SELECT c.*, CASE WHEN message_id % 3 != 0 THEN message_id % 2 = 0 END AS ok, message_id % 11 != 1 AS allowed FROM c)
    SELECT message_id, CASE WHEN state = 'PROCESSING' AND ok THEN 'SENT' WHEN state = 'PROCESSING' AND NOT ok THEN 'FAILED' ELSE state END AS state, tries, created_at,
      CASE WHEN state = 'PROCESSING' AND NOT ok AND allowed AND tries < 5 THEN TIMESTAMP '{_NOW}' + to_minutes(CAST(least(60, pow(2, tries)) AS BIGINT)) WHEN state = 'PROCESSING' AND ok IS NOT NULL THEN NULL ELSE next_at END AS next_at,
      CASE WHEN state = 'PROCESSING' AND NOT ok AND allowed THEN NULL ELSE claimed_at END AS claimed_at FROM r""")
def outbox_settled(spark, sf_dir):
    """The outbox once a round's claims are answered."""
    now, key = F.lit(_NOW).cast("timestamp"), F.col("message_id")
    outbox = M.claim(_outbox(spark, sf_dir), now).drop("mine")
    answers = outbox.where(key % 3 != 0).select(key, (key % 2 == 0).alias("ok"), (key % 11 != 1).alias("allowed"))
    return M.settle(outbox, answers, now)
