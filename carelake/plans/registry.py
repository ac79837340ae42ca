"""Collects the registered queries and their SQL."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODULES = ("adherence", "schedules", "vitals", "stock", "safety", "catalogue", "matching", "selection", "evaluation", "records", "extraction", "transitions", "layout", "records_io", "observations", "search", "reports", "identity")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that gives the same rows.

    Queries run with UTC as the session's time zone, on which casts between texts and points in time rest. Points in
    time leave a query as timestamp_ntz, which every reader shows alike.
    """

    def add(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            out = f(spark, sf_dir)
            return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes])

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"carelake.plans.{name}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(_SQL)
