"""Similarity links among the rows of hash tables, confirmed on full sets; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.components import components
from carelake.llm.shared import Scratch

SMALL = 16
BROADCAST_ROWS = 150_000


#: Turns holders into rows (key, *columns), one for each hash table that a holder is in.
Tables = Callable[..., DataFrame]


def fits(percent: int, n: Column | str = "na", m: Column | str = "nb") -> F.Column:
    """Whether two sets of these sizes can be similar at all."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def agreement(x: str, y: str) -> F.Column:
    """The number of places in which two sketches of one length are equal."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, same: n + same)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of at most BROADCAST_ROWS rows of a few numbers each; leave larger ones to a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of vertices whose full sets have 100 * |intersection| >= percent * |union|."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("both", F.size(F.array_intersect("sa", "sb")))
        .where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both")))
        .select("a", "b")
    )


def _small_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of different components within tables of few rows, but for those already compared with the first."""
    left = rows.where("id != first").select("key", F.col("id").alias("a"), F.col("comp").alias("ca"))
    right = rows.select("key", F.col("id").alias("b"), F.col("comp").alias("cb"))
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")))
    return pairs.select("a", "b").distinct()


def rare_pairs(members: DataFrame, sets: DataFrame, percent: int, least: int, scratch: Scratch) -> DataFrame:
    """Pairs of members of different components that can still be similar: prefix and positional filters.

    members is (id, comp, sketch). Shingles are ordered by how many members hold them; two sets with the wanted
    similarity share one of their rarest |s| - ceil(percent * |s| / 100) + 1 shingles, and behind the first one that
    they share each has enough left for the wanted intersection. Within a shingle the component that holds most of
    it is never paired with itself. The low bytes of the sketches must agree as often as the whole ones are to.
    """
    low = F.transform("sketch", lambda x: x.bitwiseAND(F.lit(127)).cast("tinyint"))
    held = members.select("id", "comp", low.alias("low")).join(sets, "id")
    held = held.select("id", "comp", "low", "cls", F.size("shingles").alias("n"), "shingles")
    each = held.select("id", "cls", F.explode("shingles").alias("s"))
    count = each.groupBy("s").count().where("count > 1")
    shared = (
        each.join(count, "s")
        .groupBy("cls", "id")
        .agg(F.sort_array(F.collect_list(F.struct("count", "s"))).alias("shared"))
        .join(held.drop("shingles"), ["cls", "id"])
    )
    # Shingles of one member alone come first in the order and lead nowhere.
    alone = F.col("n") - F.size("shared")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - alone
    rows = (
        shared.withColumn("alone", alone)
        .withColumn("prefix", prefix)
        .where("prefix > 0")
        .select("id", "comp", "low", "n", "alone", F.posexplode(F.slice("shared", F.lit(1), F.col("prefix"))).alias("i", "x"))
        .select("id", "comp", "low", "n", F.col("x.s").alias("s"), (F.col("n") - F.col("alone") - F.col("i")).alias("left"))
    )
    rows = scratch.write(rows, "rare")
    top = (
        rows.groupBy("s", "comp")
        .count()
        .groupBy("s")
        .agg(F.max_by("comp", F.struct("count", "comp")).alias("top"), F.count("*").alias("comps"))
        .where("comps > 1")
        .select("s", "top")
    )
    mixed = rows.join(top, "s")
    minor = mixed.where("comp != top").select(
        "s",
        F.col("id").alias("x"),
        F.col("comp").alias("cx"),
        F.col("n").alias("nb"),
        F.col("left").alias("lb"),
        F.col("low").alias("y"),
    )
    pairs = minor.join(mixed.select("s", "id", "comp", F.col("n").alias("na"), F.col("left").alias("la"), "low"), "s")
    enough = F.least("la", "lb") * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    pairs = pairs.where((F.col("comp") != F.col("cx")) & fits(percent) & enough & (agreement("low", "y") >= least))
    return pairs.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()


def links(
    holders: DataFrame,
    tables: Tables,
    sets_of: Callable[[DataFrame], DataFrame],
    percent: int,
    least: int,
    scratch: Scratch,
    likely: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Links (a, b) that connect all vertices of one table whose sets are similar, directly or through others.

    holders has a vertex `id`, its `sketch` and what tables() needs. sets_of() gives the (id, cls, shingles) of the
    vertices that meet another one. Vertices are compared with their table's smallest one first. Pairs that share a table but are still in different components are then compared too:
    directly in tables of up to SMALL rows, and through filters that are exact in larger ones. No large table is
    expanded into all its pairs. likely() drops pairs before full sets are moved: those of which fewer than `least`
    places of the sketches agree, and others that sizes rule out.
    """
    firsts = tables(holders, "id").groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("hi"))
    firsts = scratch.write(firsts.where("first < hi").select("key", "first"), "firsts")
    met = tables(holders, "id").join(small(firsts, firsts.count()), "key").select("first", "id").distinct()
    met = scratch.write(met, "met")
    members = scratch.write(met.select("id").distinct(), "members")
    sets = sets_of(members)
    stars = met.where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    found = scratch.write(_verified(likely(stars), sets, percent), "found")

    label = components(found, scratch, "stars").withColumnRenamed("root", "comp")
    labelled = holders.join(members, "id").join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    labelled = scratch.write(labelled, "labelled")
    mixed = tables(labelled, "id", "comp").groupBy("key")
    mixed = mixed.agg(
        F.min("id").alias("first"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")
    )
    mixed = scratch.write(mixed.where("lo < hi and rows > 2").select("key", "first", "rows"), "mixed")
    apart = tables(labelled, "id", "comp").join(small(mixed, mixed.count()), "key")
    crowded = apart.where(F.col("rows") > SMALL).select("id").distinct()
    crowded = labelled.join(crowded, "id").select("id", "comp", "sketch").dropDuplicates(["id"])
    pairs = _small_pairs(apart.where(F.col("rows") <= SMALL)).union(rare_pairs(crowded, sets, percent, least, scratch))
    more = scratch.write(_verified(likely(pairs.distinct()), sets, percent), "more")
    return found.union(more)
