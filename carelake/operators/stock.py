"""Stock: latest refills, forecasts, alert escalation, ledger checks and purchase links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def latest_per(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key in an order, numbered from 1."""
    rank = F.row_number().over(W.Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def nested_latest(rows: DataFrame, key: str, order: list, n: int, item: Column) -> DataFrame:
    """The same as an array of each key, in order."""
    ranked = latest_per(rows, key, order, n)
    entries = F.sort_array(F.collect_list(F.struct("rank", item.alias("item"))))
    return ranked.groupBy(key).agg(F.transform(entries, lambda x: x["item"]).alias("items"))


def stock_status(remaining: Column, days: Column, threshold: Column) -> Column:
    """The names of stock levels and the days of supply where they end. days and threshold may be null."""
    low = F.coalesce(remaining <= threshold, F.lit(False)) | F.coalesce(days <= 7, F.lit(False))
    return (
        F.when(remaining.isNull(), F.lit("UNKNOWN"))
        .when(remaining <= 0, F.lit("OUT"))
        .when(days <= 3, F.lit("CRITICAL"))
        .when(low, F.lit("LOW"))
        .when(days <= 14, F.lit("ADEQUATE"))
        .when(days.isNull() & threshold.isNull(), F.lit("UNKNOWN"))
        .otherwise(F.lit("GOOD"))
    )


def forecast(stock: DataFrame, today: str) -> DataFrame:
    """Days of supply, status, need of a refill and a suggested date: five days ahead of the end, never past.

    stock is (id, remaining, daily, threshold); without a known amount and use there is no forecast and no date.
    """
    days = F.when((F.col("daily") > 0) & F.col("remaining").isNotNull(), F.floor(F.col("remaining") / F.col("daily")).cast("long"))
    rows = stock.withColumn("days", days)
    status = stock_status(F.col("remaining"), F.col("days"), F.col("threshold"))
    suggested = F.date_add(F.lit(today).cast("date"), F.greatest(F.lit(0), F.col("days") - 5).cast("int"))
    return rows.select(
        "id",
        status.alias("status"),
        F.coalesce("days", F.lit(-1)).alias("days"),
        status.isin("OUT", "CRITICAL", "LOW").alias("needs_refill"),
        F.when(F.col("days").isNotNull(), suggested).alias("suggested"),
    )


def alert_level(remaining: Column, threshold: Column) -> Column:
    """3 out, 2 critical up to half the threshold, 1 low up to the threshold, else 0."""
    half = F.greatest(F.lit(1), F.floor(threshold / 2))
    return F.when(remaining <= 0, 3).when(remaining <= half, 2).when(remaining <= threshold, 1).otherwise(0)


def escalations(levels: DataFrame) -> DataFrame:
    """Rows of (key, at, id, level) whose level is above the one before it; recovery clears it."""
    before = F.lag("level", 1, 0).over(W.Window.partitionBy("key").orderBy("at", "id"))
    return levels.withColumn("before", before).where("level > before").drop("before")


def ledger(events: DataFrame) -> DataFrame:
    """Running balance of (key, at, id, delta) events, before and after each."""
    order = W.Window.partitionBy("key").orderBy("at", "id").rowsBetween(W.Window.unboundedPreceding, 0)
    after = F.sum("delta").over(order)
    return events.withColumn("after", after).withColumn("before", F.col("after") - F.col("delta"))


def best_links(links: DataFrame) -> DataFrame:
    """For each item and provider: package links beat medicine links, later checks beat earlier ones."""
    scope = F.when(F.col("scope") == "PACKAGE", 0).otherwise(1)
    order = W.Window.partitionBy("item", "provider").orderBy(scope, F.desc("verified_at"), "link_id")
    return links.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def savings(brand: Column, generic: Column) -> Column:
    return F.floor((brand - generic) / brand * 100 + 0.5).cast("long")
