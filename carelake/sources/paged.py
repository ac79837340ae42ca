"""Sources that give their records by pages with a cursor, as Spark data sources with caps, batch and streaming."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from carelake.shipping import ship

ITEM_LIMIT, PAGE_LIMIT, REPEATED = "ITEM_LIMIT_REACHED", "PAGE_LIMIT_REACHED", "REPEATED_PAGE_TOKEN"


class Client(Protocol):
    """What a paged service offers. It is sent to executors, so it must be picklable."""

    def resources(self) -> list[str]:
        """What can be read independently of each other: users, kinds of records, shards."""

    def fetch(self, resource: str, token: str | None) -> tuple[list[str], str | None]:
        """The records of a page and the next page's token, blank or None at the end."""


class Page(InputPartition):
    def __init__(self, resource: str, token: str | None, pages: int):
        self.resource, self.token, self.pages = resource, token, pages


SCHEMA = "resource string, page long, place long, record string, source_records long, pages long, truncated boolean, stop_reason string"


class _Reader(DataSourceReader):
    """One partition for each resource, which follows its own cursor."""

    def __init__(self, client: Client, max_items: int, max_pages: int):
        self.client, self.max_items, self.max_pages = client, max_items, max_pages

    def partitions(self) -> list[Page]:
        return [Page(r, None, self.max_pages) for r in self.client.resources()]

    def read(self, part: Page) -> Iterator[tuple]:
        """Records up to the caps, then one row about the resource."""
        token, seen, items, pages = None, set(), 0, 0
        while pages < self.max_pages:
            records, following = self.client.fetch(part.resource, token)
            following = following.strip() if following else None
            pages += 1
            for place, record in enumerate(records):
                if items == self.max_items:
                    yield part.resource, None, None, None, items, pages, True, ITEM_LIMIT
                    return
                items += 1
                yield part.resource, pages, place, record, None, None, None, None
            if items == self.max_items and following:
                yield part.resource, None, None, None, items, pages, True, ITEM_LIMIT
                return
            if not following or following in seen:
                yield part.resource, None, None, None, items, pages, bool(following), REPEATED if following else None
                return
            seen.add(following)
            token = following
        yield part.resource, None, None, None, items, pages, True, PAGE_LIMIT


class _Stream(DataSourceStreamReader):
    """The offset is each resource's cursor, so that a restart goes on behind the last page that was read."""

    def __init__(self, client: Client, pages: int, max_pages: int):
        self.client, self.pages, self.max_pages, self.now = client, pages, max_pages, None

    def initialOffset(self) -> dict:
        return {r: {"token": None, "pages": 0, "end": False} for r in self.client.resources()}

    def _behind(self, resource: str, at: dict) -> dict:
        """The cursor some pages further; the end of a resource is kept, so that nothing is read twice."""
        token, pages = at["token"], at["pages"]
        for _ in range(self.pages):
            following = self.client.fetch(resource, token)[1]
            following = following.strip() if following else None
            pages += 1
            if not following or following == token or pages >= self.max_pages:
                return {"token": token, "pages": pages, "end": True}
            token = following
        return {"token": token, "pages": pages, "end": False}

    def latestOffset(self) -> dict:
        self.now = self.now or self.initialOffset()
        self.now = {r: at if at["end"] else self._behind(r, at) for r, at in self.now.items()}
        return self.now

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.now = self.now or end
        fresh = {"token": None, "pages": 0, "end": False}
        spans = ((r, start.get(r, fresh), at) for r, at in end.items())
        return [Page(r, a["token"], b["pages"] - a["pages"]) for r, a, b in spans if b["pages"] > a["pages"]]

    def commit(self, end: dict) -> None:
        self.now = self.now or end

    def read(self, part: Page) -> Iterator[tuple]:
        token = part.token
        for page in range(part.pages):
            records, token = self.client.fetch(part.resource, token)
            for place, record in enumerate(records):
                yield part.resource, page, place, record, None, None, None, None


def paged(spark: SparkSession, client: Client, name: str = "paged") -> str:
    """Register a client as the data source `name`, for spark.read and spark.readStream.

    Options: maxItems and maxPages cap each resource of a batch; pagesPerBatch and maxPages a stream's. A batch ends with
    a row about each resource, which results() has; a stream gives records alone. Resources are read in parallel, the
    pages of one in order, since only a page knows the next one.
    """
    ship(spark)

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def _option(self, key: str, otherwise: int) -> int:
            found = int(self.options.get(key, otherwise))
            if found <= 0:
                raise ValueError(f"{key} must be positive")
            return found

        def reader(self, schema) -> DataSourceReader:
            return _Reader(client, self._option("maxItems", 10_000), self._option("maxPages", 1000))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(client, self._option("pagesPerBatch", 1), self._option("maxPages", 1 << 40))

    spark.dataSource.register(Paged)
    return name


def records(read: DataFrame) -> DataFrame:
    return read.where("record is not null").select("resource", "page", "place", "record")


def results(read: DataFrame) -> DataFrame:
    """What was read of each resource, and why no more."""
    return read.where("record is null and pages is not null").select("resource", "source_records", "pages", "truncated", "stop_reason")


def collected(rows: DataFrame, order: list[Column], items: Column, page_size: int, max_items: int, max_pages: int) -> DataFrame:
    """What reading a table by pages gives each resource: (resource, items, source_records, pages, truncated, stop_reason).

    rows has `resource`; a record gives as many `items` as that column says, 0 and more. Reading stops in the record that
    would go beyond max_items, of which the items that still fit are taken, or at the one that reaches them, and
    otherwise after max_pages pages. It is truncated when records or pages are left then.
    """
    by = W.Window.partitionBy("resource").orderBy(*order)
    seen = rows.select("resource", F.row_number().over(by).alias("n"), items.alias("items"), F.sum(items).over(by.rowsBetween(W.Window.unboundedPreceding, 0)).alias("sum"))
    full = F.min(F.when((F.col("sum") >= max_items) & (F.col("n") <= page_size * max_pages), F.struct("n", "sum"))).alias("full")
    capped = F.sum(F.when(F.col("n") <= page_size * max_pages, F.col("items")))
    sums = seen.groupBy("resource").agg(F.count("*").alias("all"), full, F.coalesce(capped, F.lit(0)).alias("taken"))
    pages_there = F.greatest(F.ceil(F.col("all") / page_size), F.lit(1))
    last = F.coalesce(F.col("full.n"), F.least("all", F.lit(page_size * max_pages)))
    limited = F.col("full").isNotNull() & ((F.col("full.sum") > max_items) | (F.col("all") > F.col("full.n")))
    out_of_pages = F.col("full").isNull() & (pages_there > max_pages)
    return sums.select(
        "resource",
        F.when(F.col("full").isNotNull(), F.lit(max_items)).otherwise(F.col("taken")).cast("long").alias("items"),
        last.cast("long").alias("source_records"),
        F.when(F.col("full").isNotNull(), F.ceil(F.col("full.n") / page_size)).otherwise(F.least(pages_there, F.lit(max_pages))).cast("long").alias("pages"),
        (limited | out_of_pages).alias("truncated"),
        F.when(limited, ITEM_LIMIT).when(out_of_pages, PAGE_LIMIT).alias("stop_reason"),
    )
