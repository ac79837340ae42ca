"""Sliding windows, ordered folds and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from carelake.functions.numbers import half_up


def rounded_rolling_mean(values: Column) -> Column:
    """A mean of an ordered array that is rounded after every step, so it depends on the order."""
    start = F.struct(F.lit(0.0).alias("mean"), F.lit(0).alias("n"))

    def step(acc, x):
        n = acc["n"] + 1
        return F.struct(half_up((acc["mean"] * (n - 1) + x) / n).cast("double").alias("mean"), n.alias("n"))

    return F.aggregate(values, start, step, lambda acc: acc["mean"])


def newest(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """A buffer of the n newest rows of each group."""
    place = F.row_number().over(W.Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= n)


def text_windows(rows: DataFrame, group: str, order: str, text: str, value: str, most: int = 3) -> DataFrame:
    """Each run of 1 to `most` consecutive lines: (group, order, lines, text, mean)."""
    w = W.Window.partitionBy(group).orderBy(order)
    ahead = [f(c, i).over(w).alias(f"{x}{i}") for f, c, x in ((F.lead, text, "_t"), (F.lead, value, "_v")) for i in range(most)]
    rows = rows.select(group, order, *ahead)
    texts, values = ([F.col(f"{x}{i}") for i in range(most)] for x in ("_t", "_v"))
    runs = [
        F.when(
            texts[n - 1].isNotNull(),
            F.struct(F.lit(n).alias("lines"), F.concat_ws(" ", *texts[:n]).alias("text"), (sum(values[1:n], values[0]) / n).alias("mean")),
        )
        for n in range(1, most + 1)
    ]
    out = rows.select(group, order, F.explode(F.array_compact(F.array(*runs))).alias("x"))
    return out.select(group, order, "x.lines", "x.text", "x.mean")


def token_grams(tokens: Column, most: int = 4) -> Column:
    """All runs of 1 to `most` tokens, joined by spaces, shorter ones first."""
    def of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.size(tokens) - n + 1)
        runs = F.transform(at, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
        return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of(n) for n in range(1, most + 1)]))


def positive_gaps(rows: DataFrame, group: str, order: list, value: Column) -> DataFrame:
    """Steps from each value to the next one of its group, those above zero."""
    step = F.lead(value).over(W.Window.partitionBy(group).orderBy(*order)) - value
    return rows.withColumn("gap", step).where("gap > 0")


def box_smoothed(value: Column, group: str, order: list, size: int = 9) -> Column:
    """A moving mean over `size` values, of which those beyond the ends count as zeros."""
    half = size // 2
    return F.sum(value).over(W.Window.partitionBy(group).orderBy(*order).rowsBetween(-half, half)) / size


def edge_smoothed(value: Column, group: str, order: list, radius: int) -> Column:
    """A moving mean over the values that there are within a radius."""
    return F.avg(value).over(W.Window.partitionBy(group).orderBy(*order).rowsBetween(-radius, radius))


def nearest_rank(rows: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """The value at place floor((n - 1) * p) of each group's values in order."""
    by = W.Window.partitionBy(group)
    place = F.row_number().over(by.orderBy(value)) - 1
    ranked = rows.where(F.col(value).isNotNull()).select(group, value, place.alias("place"), F.count("*").over(by).alias("n"))
    return ranked.where(F.col("place") == F.floor((F.col("n") - 1) * F.lit(p))).select(group, value)


def confusion(rows: DataFrame, group: str, wanted: str, told: str) -> DataFrame:
    """Counts, precision, recall and F1 of each group; a ratio without a base is 0."""
    def count(w: bool, t: bool) -> Column:
        return F.count_if((F.col(wanted) == w) & (F.col(told) == t))

    def ratio(x: Column, y: Column) -> Column:
        return F.when(y > 0, x / y).otherwise(F.lit(0.0))

    out = rows.groupBy(group).agg(count(True, True).alias("tp"), count(False, True).alias("fp"), count(True, False).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select(
        group, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def recognition(cases: DataFrame, group: str) -> DataFrame:
    """Quality of recognised names by group, from cases (told, wanted, recovered, latency) of which told and wanted are arrays.

    Names count as sets for hits and misses; told is in order of rank for the first and the first three, which look for
    the first wanted one. A recovery is false when it tells names of which none is wanted. Cases without told names are
    empty. Ratios without a base are 0; null arrays are empty ones.
    """
    none = F.array().cast("array<string>")
    rows = cases.withColumns({"told": F.coalesce("told", none), "wanted": F.coalesce("wanted", none)})
    hits = F.size(F.array_intersect("told", "wanted"))
    first = F.get("wanted", F.lit(0))
    top1, top3 = F.get("told", F.lit(0)) == first, F.array_contains(F.slice("told", 1, 3), first)
    lost = F.col("recovered") & (F.size("told") > 0) & (hits == 0)

    def ratio(x: Column, y: Column) -> Column:
        return F.when(y > 0, x / y).otherwise(F.lit(0.0))

    sums = rows.groupBy(group).agg(
        F.count("*").alias("cases"), F.sum(hits).alias("tp"), F.sum(F.size(F.array_except("told", "wanted"))).alias("fp"), F.sum(F.size(F.array_except("wanted", "told"))).alias("fn"),
        F.count_if(top1).alias("one"), F.count_if(top3).alias("three"), F.count_if("recovered").alias("recoveries"), F.count_if(lost).alias("lost"), F.count_if(F.size("told") == 0).alias("empty"), F.avg("latency").alias("latency"),
    )
    tp, fp, fn, n = F.col("tp"), F.col("fp"), F.col("fn"), F.col("cases")
    return sums.select(
        group, "cases", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(F.col("one"), n).alias("top1"),
        ratio(F.col("three"), n).alias("top3"), ratio(F.col("lost"), F.col("recoveries")).alias("false_recovery"), ratio(F.col("empty"), n).alias("empty"), F.round("latency", 9).alias("latency"),
    )
