"""Every registered query against its SQL in DuckDB, and what has no SQL against its own rules."""

from decimal import Decimal

import duckdb
import pytest

from carelake.plans import registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(x):
    if isinstance(x, (float, Decimal)):
        return round(float(x), 6)
    return str(list(x)) if isinstance(x, (list, tuple)) else str(x)


def _sorted(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_value(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert _sorted(df.columns, df.collect()) == _sorted(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0
    assert all(kind != "timestamp" for _, kind in df.dtypes)
