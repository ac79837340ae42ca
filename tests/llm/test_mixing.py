import numpy as np
import pytest

from carelake.llm import tokens
from carelake.llm.mixing import BLOCK_WORDS, mix, permute, water_fill
from carelake.llm.shared import table
from tests.llm.cases import COLUMNS, awkward, empty, words


def _check(rows, docs, sources):
    size_of = {}
    for source, size in sources:
        size_of[source] = size_of.get(source, 0) + size
    taken = {}
    for r, source in rows:
        assert r["source_size"] == size_of[source]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
    order = sorted(size_of, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, water_fill([size_of[s] for s in order], [i % 3 + 1 for i in range(len(order))])))
    for r, source in rows:
        assert r["target"] == pytest.approx(targets[source])
    return taken, targets, size_of


def test_sizes_and_targets_of_a_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = {r["doc_id"]: r for r in docs.collect()}
    found = mix(docs).taken.collect()
    assert len(found) == len(held)
    assert all(r["size"] == len(words(held[r["doc_id"]]["text"])) for r in found)
    rows = [(r, held[r["doc_id"]]["source"]) for r in found]
    taken, targets, sizes = _check(rows, docs, [(held[r["doc_id"]]["source"], r["size"]) for r in found])
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 0.02 * target + 20 * BLOCK_WORDS
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, mix(docs).taken.collect()), key=repr)


def test_slots_hold_what_is_taken(spark, sf_dir):
    found = mix(table(spark, sf_dir, "documents"))
    slots = found.slots.count()
    assert found.slots.select("shard", "slot").distinct().count() == slots
    by_slot = {r["doc_id"]: r["n"] for r in found.shards().groupBy("doc_id").agg({"words": "sum"}).toDF("doc_id", "n").collect()}
    assert by_slot == {r["doc_id"]: r["taken"] for r in found.taken.collect() if r["taken"]}


def test_water_fill():
    assert water_fill([100, 100], [1, 3]) == [50.0, 150.0]
    assert water_fill([10, 100, 100], [1, 2, 3]) == [30.0, 72.0, 108.0]
    assert water_fill([1, 99], [3, 1]) == [3.0, 97.0]
    assert water_fill([0, 0], [1, 2]) == [0.0, 0.0]
    assert water_fill([], []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_permutation(n):
    size, key = np.full(n, n), np.full(n, tokens.stream(9, 1)[0])
    assert sorted(permute(np.arange(n), size, key)) == list(range(n))


def test_awkward_rows_and_empty_table(spark):
    found = mix(awkward(spark)).taken.collect()
    assert len(found) == 13
    assert all(r["size"] == 0 and r["taken"] == 0 for r in found if r["doc_id"] in (2, 3, 4, 11))
    assert all(r["taken"] <= 3 * r["size"] for r in found)
    assert mix(empty(spark)).taken.count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None)], COLUMNS)
    assert [tuple(r) for r in mix(blank).taken.collect()] == [(1, 0, 0, 0.0, 0)]
