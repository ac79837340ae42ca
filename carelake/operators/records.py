"""Record rules: scores, keys, validation, masking, and state transitions over whole batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from carelake.functions.numbers import half_up


def confidence(ocr: Column, entity: Column, validation: Column) -> Column:
    """A whole score of 0 to 100 from three dimensions weighing 0.4, 0.3 and 0.3."""
    return F.least(F.greatest(half_up(ocr * 0.40 + entity * 0.30 + validation * 0.30), F.lit(0)), F.lit(100)).cast("long")


def legacy_confidence(ocr: Column, verified: Column, history: Column, known: Column, agreed: Column) -> Column:
    """A whole score of 0 to 100 by the older weights; history goes before what the catalogue knows, null counts as 0."""
    zero = F.lit(0)
    score = F.coalesce(ocr, zero) * 0.45 + F.coalesce(verified, zero) * 0.30 + F.coalesce(history, known, zero) * 0.15
    score = score + F.when(F.coalesce(agreed, F.lit(False)), 100).otherwise(0) * 0.10
    return F.least(F.greatest(half_up(score), zero), F.lit(100)).cast("long")


def confidence_status(score: Column) -> Column:
    return (
        F.when(score >= 85, F.lit("VERIFIED")).when(score >= 60, F.lit("VERIFY_REQUIRED")).when(score >= 20, F.lit("NEEDS_REVIEW")).otherwise(F.lit("REJECT"))
    )


def utility(confidence: Column, tokens: Column, lines: Column) -> Column:
    return 0.6 * confidence + 0.25 * tokens + 0.15 * lines


def refill_status(remaining: Column, days: Column) -> Column:
    """The older four levels of stock; days may be null."""
    return (
        F.when((remaining <= 5) | F.coalesce(days <= 3, F.lit(False)), F.lit("critical"))
        .when((remaining <= 10) | F.coalesce(days <= 7, F.lit(False)), F.lit("low"))
        .when(days <= 14, F.lit("adequate"))
        .otherwise(F.lit("good"))
    )


def ambiguous(rows: DataFrame, group: str, similarity: str) -> DataFrame:
    """Rows with `ambiguous`: whether several of a group lie within a window below its best score.

    The window is 3 points above 90, 6 from 70 on and 10 below; scores are whole hundredths.
    """
    by = W.Window.partitionBy(group)
    points = half_up(F.col(similarity) * 100)
    top = F.max("points").over(by)
    window = F.when(top > 90, 3).when(top >= 70, 6).otherwise(10)
    out = rows.withColumn("points", points).withColumn("option", top - F.col("points") <= window)
    return out.withColumn("ambiguous", F.col("option") & (F.count_if("option").over(by) >= 2))


def bigram_dice(left: Column, right: Column) -> Column:
    """Dice's coefficient over bigrams counted with repetition; equal texts are 1, others under two letters 0."""
    def grams(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))

    a, b = grams(left), grams(right)

    def times(xs: Column, x: Column) -> Column:
        return F.size(F.filter(xs, lambda y: y == x))

    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    out = 2 * both / (F.length(left) + F.length(right) - 2)
    return F.when(left == right, 1.0).when((F.length(left) < 2) | (F.length(right) < 2), 0.0).otherwise(out)


def coverage(found: Column, wanted: Column) -> Column:
    return F.when(wanted > 0, found / wanted).otherwise(0.0)


def title_case(c: Column) -> Column:
    """Each word's first letter in upper case, the rest as it is."""
    return F.array_join(F.transform(F.split(c, r"\s+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.expr("''"), F.substr(w, F.lit(2)))), " ")


def first_sentence(c: Column, least: int = 30) -> Column:
    """The first sentence of more than so many letters, null where there is none."""
    return F.get(F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.length(s) > least), F.lit(0))


def review_key(kind: Column, source: Column, name: Column, code: Column, strength: Column, master: Column, salt: Column) -> Column:
    """The key of a review: by barcode, by what is missing, or by kind, source, name and strength; null without any."""
    def plain(c: Column) -> Column:
        return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")

    origin = plain(F.coalesce(source, F.lit("MANUAL")))
    origin = F.when(origin == "", F.lit("manual")).otherwise(origin)
    return (
        F.when(code.isNotNull() & (code != ""), F.concat(F.lit("barcode:"), plain(code)))
        .when((kind == "MISSING_IMAGE") & master.isNotNull(), F.concat(F.lit("missing-image:"), master))
        .when((kind == "MISSING_CLINICAL_DETAILS") & salt.isNotNull(), F.concat(F.lit("missing-clinical:"), salt))
        .when(plain(name) != "", F.concat_ws(":", F.coalesce(kind, F.lit("UNKNOWN")), origin, plain(name), plain(strength)))
    )


def provenance(trust: Column) -> Column:
    """Source, quality and flags of a device's readings by its level of trust."""
    def told(source: str, quality: str, *flags: str) -> Column:
        marks = F.array(*[F.lit(x) for x in flags]) if flags else F.array().cast("array<string>")
        return F.struct(F.lit(source).alias("source"), F.lit(quality).alias("quality"), marks.alias("flags"))

    return (
        F.when(trust == "VERIFIED", told("BLUETOOTH_REAL", "DEVICE_REPORTED"))
        .when(trust == "SIMULATOR", told("BLUETOOTH_SIMULATED", "QUESTIONABLE", "SIMULATED_DATA"))
        .otherwise(told("UNVERIFIED_DEVICE", "QUESTIONABLE", "UNVERIFIED_DEVICE"))
    )


def context_window(turns: DataFrame, session: str, order: str, role: str, text: str, n: int, letters: int = 1000) -> DataFrame:
    """The last n turns of each session as one text: a line `role: text` each, texts cut to so many letters."""
    place = F.row_number().over(W.Window.partitionBy(session).orderBy(F.desc(order), F.desc(role), F.desc(text)))
    near = turns.withColumn("place", place).where(F.col("place") <= n)
    line = F.concat(F.coalesce(role, F.lit("")), F.lit(": "), F.substring(F.coalesce(text, F.lit("")), 1, letters))
    entries = F.sort_array(F.collect_list(F.struct((-F.col("place")).alias("p"), line.alias("line"))))
    return near.groupBy(session).agg(F.array_join(F.transform(entries, lambda x: x["line"]), "\n").alias("context"))


def overdue(doses: DataFrame, now: Column) -> DataFrame:
    """Pending and snoozed doses whose deadline is over become MISSED; the later of grace and snooze is the deadline.

    doses is (id, status, scheduled_at, grace_minutes, snooze_until). All other rows stay as they are.
    """
    grace = F.col("scheduled_at") + F.make_dt_interval(mins=F.col("grace_minutes").cast("int"))
    deadline = F.greatest(grace, F.when(F.col("status") == "SNOOZED", F.col("snooze_until")))
    late = F.col("status").isin("PENDING", "SNOOZED") & (deadline < now)
    return doses.withColumn("status", F.when(late, F.lit("MISSED")).otherwise(F.col("status")))


def claimed(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """Which of several claims (id, claim, expected) on a row wins: the first whose expected status the row has.

    A claim moves the row away from that status, so at most one of a batch wins.
    """
    first = claims.join(rows.select("id", "status"), "id").where("status = expected").groupBy("id").agg(F.min("claim").alias("winner"))
    return claims.join(first, "id", "left").select("id", "claim", F.coalesce(F.col("claim") == F.col("winner"), F.lit(False)).alias("won"))


def outbox(rows: DataFrame, results: DataFrame, now: Column, most_tries: int = 5, stale_minutes: int = 10) -> DataFrame:
    """The next state of an outbox (id, state, tries, since): stale claims go back, answers decide.

    results is (id, ok). A failed try is tried again until most_tries, then the row has FAILED.
    """
    stale = (F.col("state") == "PROCESSING") & (F.col("since") < now - F.make_dt_interval(mins=F.lit(stale_minutes)))
    both = rows.join(results, "id", "left").withColumn("sent", F.col("ok") & (F.col("state") == "PROCESSING"))
    tries = F.when((F.col("state") == "PROCESSING") & F.col("ok").isNotNull() & ~F.col("ok"), F.col("tries") + 1).otherwise(F.col("tries"))
    state = (
        F.when(F.col("state") != "PROCESSING", F.col("state"))
        .when(F.col("ok"), F.lit("SENT"))
        .when(F.col("ok").isNotNull() & (F.col("tries") + 1 >= most_tries), F.lit("FAILED"))
        .when(F.col("ok").isNotNull() | stale, F.lit("PENDING"))
        .otherwise(F.lit("PROCESSING"))
    )
    return both.select("id", state.alias("state"), tries.alias("tries"))


def replaced_children(stored: DataFrame, parent: str, new: DataFrame) -> DataFrame:
    """Child rows after all children of the parents in `new` were deleted and the new ones created."""
    return stored.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def reminders(doses: DataFrame, sent: DataFrame, now: Column, ahead_minutes: int = 15) -> DataFrame:
    """(id, kind, key) of reminders to send: pending doses within the time ahead, and snoozed ones whose time is over.

    doses is (id, status, scheduled_at, snooze_until, schedule_active, user_active). A dose is told once and each of its
    snoozes once: keys in `sent` are left out. Users have to be active, and for a pending dose its schedule too.
    """
    ahead = now + F.make_dt_interval(mins=F.lit(ahead_minutes))
    soon = (F.col("status") == "PENDING") & F.col("scheduled_at").between(now, ahead) & F.col("schedule_active") & F.col("user_active")
    woken = (F.col("status") == "SNOOZED") & (F.col("snooze_until") <= now) & F.col("user_active")
    kind = F.when(soon, F.lit("UPCOMING")).when(woken, F.lit("SNOOZE"))
    key = F.concat_ws(":", F.col("id").cast("string"), F.when(woken, F.date_format("snooze_until", "yyyyMMddHHmmss")))
    return doses.select("id", kind.alias("kind"), key.alias("key")).where("kind is not null").join(sent, "key", "left_anti").select("id", "kind", "key")


def mixed_names(json: Column) -> Column:
    """The names in a JSON array of texts and of objects with a name; other entries go."""
    items = F.from_json(json, "array<string>")
    names = F.transform(items, lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x))
    return F.array_compact(names)


def progress(elapsed: Column, eta_minutes: Column) -> tuple[Column, Column]:
    """The share of a way that is done, 1 at most, and the whole minutes that are left; a way takes 90 seconds at least."""
    share = F.least(elapsed / F.greatest(F.lit(90), eta_minutes * 60), F.lit(1.0))
    return share, F.ceil(eta_minutes * (1 - share)).cast("long")
