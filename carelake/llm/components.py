"""Connected components as Spark joins: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Component root of each vertex that has an edge: (id, root), root the smallest id of its component.

    edges has columns a and b of one orderable type. Each round contracts every neighbourhood towards its
    minimum, so the number of rounds grows with the logarithm of a component's size. Each round is written to the
    shared folder, which cuts lineage and replaces the one before; only a count and a checksum of the edges reach the driver. Nulls and self-links are ignored; an empty input gives an empty result.
    """
    now = scratch.write(_clean(edges), f"{name}-0", edges.count())
    mark, step = _fingerprint(now), 0
    while mark[0]:
        step += 1
        now = scratch.write(_star(_star(now, larger_only=True), larger_only=False), f"{name}-{step}", mark[0])
        before, mark = mark, _fingerprint(now)
        scratch.drop(f"{name}-{step - 1}")
        if mark == before:
            break
    roots = now.select(F.col("b").alias("root")).distinct().select(F.col("root").alias("id"), "root")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _clean(edges: DataFrame) -> DataFrame:
    """Distinct links from the larger id (a) to the smaller one (b)."""
    return (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link each vertex's neighbours to the smallest vertex around it."""
    if larger_only:  # neighbours above the centre, from links seen in both directions
        out = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = out.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = out.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        return _clean(linked)
    out = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = out.groupBy("u").agg(F.min("v").alias("m"))
    linked = out.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return _clean(linked.union(least.select("u", "m")))
