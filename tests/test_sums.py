"""Sums of doubles that decide at a limit are added up in a fixed order, however rows are dealt."""

import datetime as dt
import random

import pytest

from carelake.operators import layout as L
from carelake.operators import vitals as V

#: In the order of time their mean is a little below 12.05, backwards it is 12.05.
VALUES = (5.22, 12.8, 29.17, 1.01)


def _readings(spark, back, days=1):
    rows = [(1, "m", x, dt.datetime(2024, 1, 1 + d, 8, i), 0, False) for d in range(days) for i, x in enumerate(VALUES)]
    return spark.createDataFrame(rows[::-1] if back else rows, "user_id long, metric string, value double, recorded_at timestamp, offset_minutes int, questionable boolean").coalesce(1)


@pytest.mark.parametrize("back", [False, True])
def test_a_daily_mean_is_added_up_in_the_order_of_time(spark, back):
    (row,) = V.daily_trend(_readings(spark, back)).collect()
    assert (row["n"], row["mean"], row["least"], row["most"]) == (4, 12.0, 1.01, 29.17)


def test_pages_at_their_least_confidence_are_judged_by_one_order_of_lines(spark):
    draw, pages = random.Random(1), {}
    for page in range(300):  # means of exactly 0.42
        (w, d), (v, e) = ((draw.randint(20, 70), draw.randint(1, 40)) for _ in range(2))
        held = [(w, (42 + d) / 100), (w, (42 - d) / 100), (v, (42 + e) / 100), (v, (42 - e) / 100), (30, 0.42)]
        pages[page] = draw.sample(held, len(held))
    rows = [(p, "generic", i, "a" * n, sure) for p, held in pages.items() for i, (n, sure) in enumerate(held)]
    found = L.quality(spark.createDataFrame(draw.sample(rows, len(rows)), "page long, kind string, line int, text string, confidence double"))

    def added_up(held):
        total = 0.0
        for n, sure in reversed(held):
            total += sure * n
        return total / sum(n for n, _ in held)

    expected = {p: added_up(held) >= L.LEAST_SURE["generic"] for p, held in pages.items()}
    assert len(set(expected.values())) == 2
    assert {r["page"]: r["accepted"] for r in found.collect()} == expected
