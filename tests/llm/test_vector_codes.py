import hashlib
import math
import random

import numpy as np
import pytest

from carelake.llm.shared import table
from carelake.llm.vector_codes import compress, search

SCHEMA = "vec_id long, embedding array<float>, label int"


def _expected(rows, parts=16, entries=64, rounds=2):
    """Plain lists and full distances."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) % parts == 0]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return []
    width = next((len(r[1]) for r in rows if r[1]), 0)
    rows = [r for r in rows if len(r[1]) == width]
    dims = len(rows[0][1]) // parts
    cut = [[[math.floor(256 * x) for x in r[1][p * dims : p * dims + dims]] for p in range(parts)] for r in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            far = [[sum((a - b) ** 2 for a, b in zip(c[p], e)) for e in books[p]] for p in range(parts)]
            out.append([(min(f), f.index(min(f))) for f in far])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(v) // len(mine) for v in zip(*mine)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(rows, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    told = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{i:02x}" for _, i in f), e, by_label[r[2]], told) for r, f, e in zip(rows, found, errors)), key=repr)


def _found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_same_as_brute_force_on_a_whole_table(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    rows = [tuple(r) for r in vectors.select("vec_id", "embedding", "label").collect()]
    assert _found(compress(vectors.repartition(7))) == _expected(rows)


def test_awkward_rows_few_entries_and_clashing_columns(spark):
    draw = random.Random(1)
    good = [(i, [draw.uniform(-1, 1) for _ in range(32)], None if i % 3 == 0 else i % 2) for i in range(9)]
    same = [(20, [0.5] * 32, 1), (20, [0.5] * 32, 1), (None, [0.25] * 32, None), (21, [-0.001] * 32, 5), (22, [1e30] * 32, 6)]
    bad = [(30, None, 1), (31, [None] * 32, 1), (32, [float("nan")] * 32, 1), (33, [1.0] * 31 + [float("inf")], 1), (34, [1.0] * 16, 1), (-5, [], 1), (36, [1.0] * 33, 1)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in good + same[:-1] + bad], SCHEMA + ", code string, share string, error int")
    rows = [(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b], c) for a, b, c in good + same[:-1] + bad]
    assert _found(compress(df)) == _expected(rows)
    assert len(_found(compress(spark.createDataFrame(good + same, SCHEMA)))) == len(good + same)


def test_empty_tables_and_vectors(spark):
    assert compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert compress(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
    assert [r[:3] for r in _found(compress(spark.createDataFrame([(1, [], 1), (2, [], None)], SCHEMA)))] == [(1, "00" * 16, 0), (2, "00" * 16, 0)]


@pytest.mark.parametrize("dims", [1, 3, 8])
def test_search_finds_the_nearest_entry_and_the_lowest_of_ties(dims):
    draw = np.random.default_rng(dims)
    parts, book = draw.integers(-4, 5, (3000, dims)), draw.integers(-4, 5, (40, dims))
    far = ((parts[:, None] - book[None]) ** 2).sum(2)
    index, least = search(parts, book, block=700)
    assert (index == far.argmin(1)).all() and (least == far.min(1)).all()
