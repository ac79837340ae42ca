"""Catalogue import: actions, duplicates, keys, merges and learned corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from carelake.lineage import cut


def first_in_file(rows: DataFrame, keys: list[str], number: str, valid: str, most_rounds: int = 1000) -> DataFrame:
    """Marks rows that have one of several keys in common with an earlier row that counts.

    Only valid rows that aren't duplicates themselves count, so a decision rests on earlier ones. Each round decides
    every row whose earlier partners are decided; rows are few keys long chains only in adversarial files, and a file
    without chains is done in two. Null keys never repeat. rows need distinct numbers.
    """
    state = F.when(~F.col(valid), F.lit("invalid"))
    now = rows.select(number, *keys, F.col(valid).alias(valid), state.alias("state"))
    for _ in range(most_rounds):
        first, taken = [], []
        for key in keys:
            same = W.Window.partitionBy(key)
            # An invalid row's own state never blocks others; it is a duplicate or not by the rows that count.
            open_ = F.min(F.when(F.col("state").isNull(), F.col(number))).over(same)
            counted = F.min(F.when(F.col("state") == "counts", F.col(number))).over(same)
            first.append(F.col(key).isNull() | F.coalesce(open_ >= F.col(number), F.lit(True)))
            taken.append(F.col(key).isNotNull() & F.coalesce(counted < F.col(number), F.lit(False)))
        repeats, leads = reduce(Column.__or__, taken), reduce(Column.__and__, first)
        decided = F.when(F.col("state").isNotNull(), F.col("state")).when(repeats, F.lit("repeats")).when(leads, F.lit("counts"))
        now = cut(now.withColumn("state", decided))
        if now.where("state is null").isEmpty():
            break
    else:
        raise ValueError(f"rows are not decided after {most_rounds} rounds")
    counted = [
        F.coalesce(F.min(F.when(F.col("state") == "counts", F.col(number))).over(W.Window.partitionBy(key)) < F.col(number), F.lit(False))
        & F.col(key).isNotNull()
        for key in keys
    ]
    marks = now.select(number, reduce(Column.__or__, counted).alias("duplicate"))
    return rows.join(marks, number)


def actions(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """What an import does with each row: the first of duplicate, invalid, protected, unchanged, update, create.

    rows is (key, name, valid, duplicate); existing is (key, stored_name, protected).
    """
    both = rows.join(existing, "key", "left")
    action = (
        F.when(F.col("duplicate"), F.lit("DUPLICATE_IN_FILE"))
        .when(~F.col("valid"), F.lit("INVALID"))
        .when(F.col("protected") | (F.col("stored_name") == F.col("name")), F.lit("NOOP"))
        .when(F.col("stored_name").isNotNull(), F.lit("UPDATE"))
        .otherwise(F.lit("CREATE"))
    )
    return both.withColumn("action", action)


def unique_keys(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of a key keeps it, later ones get their number as a suffix."""
    rn = F.row_number().over(W.Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("unique_key", F.when(rn == 1, F.col(key)).otherwise(F.concat_ws("-", key, rn.cast("string"))))


def prefer(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The best row of each key, by one aggregate; order holds columns that rise from better to worse."""
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("best"))
    return best.select("best.*")


def merge_plan(masters: DataFrame) -> DataFrame:
    """Winner and losers of each key held by several masters: (key, winner, losers), best rank first, then the oldest.

    masters is (id, key, rank, created_at).
    """
    out = masters.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("r"), "created_at", "id"))).alias("m")
    )
    ids = F.transform("m", lambda x: x["id"])
    return out.where(F.size("m") > 1).select(
        "key", ids[0].alias("winner"), F.slice(ids, F.lit(2), F.size("m")).alias("losers")
    )


def repoint(rows: DataFrame, plan: DataFrame, column: str) -> DataFrame:
    """Foreign keys of losers rewritten to their winners."""
    moves = plan.select("winner", F.explode("losers").alias(column))
    return rows.join(moves, column, "left").withColumn(column, F.coalesce("winner", column)).drop("winner")


def redirected(rows: DataFrame) -> DataFrame:
    """(id, resolved) of masters (id, merged_into, archived): one hop to where a master was merged into.

    A target that is archived or missing gives null; a master that wasn't merged stands for itself.
    """
    live = rows.where("not archived").select(F.col("id").alias("target"))
    resolved = F.when(F.col("merged_into").isNull(), F.col("id")).otherwise(F.col("target"))
    return rows.join(live, F.col("merged_into") == F.col("target"), "left").select("id", resolved.alias("resolved"))


def demand(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """Demand counters after a batch of requests: (key, demand)."""
    new = asked.groupBy("key").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    out = stored.join(new, "key", "full_outer")
    return out.select("key", (F.coalesce("demand", zero) + F.coalesce("n", zero)).alias("demand"))


def corrections(log: DataFrame) -> DataFrame:
    """Learned corrections of (user_id, raw, corrected, at): the first correction stays, uses are counted."""
    return log.groupBy("user_id", "raw").agg(
        F.min_by("corrected", F.struct("at", "corrected")).alias("corrected"), F.count("*").alias("uses"), F.max("at").alias("last_used")
    )


def domain_class(host: Column, lists: dict[str, list[str]]) -> Column:
    """The first list that holds a host or a domain above it; else `rejected`."""
    out = None
    for name, domains in lists.items():
        inside = F.lit(False)
        for d in domains:
            inside = inside | (host == d) | host.endswith(f".{d}")
        out = F.when(inside, F.lit(name)) if out is None else out.when(inside, F.lit(name))
    return out.otherwise(F.lit("rejected"))
