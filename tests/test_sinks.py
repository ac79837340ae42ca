"""Sinks: batches that come twice or fail half-way leave the same table."""

import pytest
from pyspark.sql import functions as F

from carelake.streaming.sinks import VersionedTable, append_once

SCHEMA = "id long, name string, n long, created string"


def _rows(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def _found(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


@pytest.fixture()
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/table", SCHEMA, ["id"], 4)


def test_inserts_and_updates_have_their_own_columns(spark, table):
    assert _found(table) == []
    assert table.merge(_rows(spark, (1, "a", 1, "x"), (2, "b", 2, "x")), 0, update=["name", "n"])
    assert table.merge(_rows(spark, (2, "c", None, "y"), (3, "d", 3, "y")), 1, update=["name", "n"])
    assert _found(table) == [(1, "a", 1, "x"), (2, "c", None, "x"), (3, "d", 3, "y")]


def test_a_batch_written_twice_changes_nothing_and_writers_count_apart(spark, table):
    for done in (True, False):
        assert table.merge(_rows(spark, (1, "a", 1, "x")), 7, "w") is done
    assert not table.merge(_rows(spark, (1, "b", 1, "x")), 6, "w")
    assert table.merge(_rows(spark, (1, "c", 1, "x")), 0, "other")
    assert _found(table) == [(1, "c", 1, "x")]


def test_a_merge_that_fails_half_way_leaves_the_old_table(spark, table):
    table.merge(_rows(spark, *[(i, "a", 0, "x") for i in range(40)]), 0)
    before = _found(table)
    broken = _rows(spark, *[(i, "b", 1, "y") for i in range(20, 60)]).withColumn("n", F.when(F.col("id") == 59, F.raise_error(F.lit("lost"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        table.merge(broken, 1)
    assert _found(table) == before
    assert table.merge(_rows(spark, *[(i, "b", 1, "y") for i in range(20, 60)]), 1)
    assert _found(table) == sorted([(i, "a", 0, "x") for i in range(20)] + [(i, "b", 1, "y") for i in range(20, 60)], key=repr)


def test_only_touched_partitions_are_written_and_two_writers_of_a_version_collide(spark, table):
    table.merge(_rows(spark, *[(i, "a", 0, "x") for i in range(40)]), 0)
    before = table.manifest()[1]["parts"]
    table.merge(_rows(spark, (3, "b", 1, "y")), 1)
    after = table.manifest()[1]["parts"]
    assert sum(before[k] != after[k] for k in before) == 1 and len(before) == 4
    with pytest.raises(RuntimeError):
        table._commit(1, {})


def test_the_last_of_repeated_keys_counts_and_newer_rows_are_kept(spark, table):
    table.merge(_rows(spark, (1, "old", 1, "x"), (1, "new", 2, "x"), (2, "b", 5, "x")), 0, order=[F.col("n")])
    table.merge(_rows(spark, (1, "late", 1, "y"), (2, "newer", 6, "y")), 1, keep="{n} > n")
    assert _found(table) == [(1, "new", 2, "x"), (2, "newer", 6, "y")]


def test_streams_merge_and_log_each_batch_once_over_a_restart(spark, table, tmp_path):
    log = str(tmp_path / "log")
    for round in range(2):
        for i in range(2):
            _rows(spark, (i, f"r{round}", round, "x"), (10 + round, "z", i, "x")).coalesce(1).write.parquet(str(tmp_path / f"in{round}{i}"))
        for name, write in (("merge", table.writer("s", order=[F.col("n")])), ("log", append_once(log))):
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
            query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / f"checkpoint-{name}")).trigger(availableNow=True).start()
            assert query.awaitTermination(120)
    assert [r[:3] for r in _found(table)] == [(0, "r1", 1), (1, "r1", 1), (10, "z", 1), (11, "z", 1)]
    assert spark.read.parquet(log).count() == 8
    append_once(log)(_rows(spark, (5, "again", 0, "x")), 3)
    assert spark.read.parquet(log).count() == 7  # batch 3 had two rows


def test_archived_rows_stay_but_are_left_out(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "id long, archived boolean", ["id"], 2)
    table.merge(spark.createDataFrame([(1, None), (2, False)], "id long, archived boolean"), 0)
    table.archive(spark.createDataFrame([(2,), (3,)], "id long"), 0)
    assert sorted(map(tuple, table.read().collect())) == [(1, None), (2, True)] and [r[0] for r in table.live().collect()] == [1]
