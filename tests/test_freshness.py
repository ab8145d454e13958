"""Reuse of indexes in order against the sequential fold."""

import datetime as dt
import random

import pytest

from quillcast.operators.freshness import reused_cutoffs

DAY0 = dt.date(2023, 1, 1)


def fold(days, apart):
    last, chosen = None, {}
    for d in sorted(days):
        if last is None or d - last > apart:
            last = d
        chosen[d] = last
    return chosen


@pytest.mark.parametrize("apart", [0, 1, 3, 10])
def test_equals_the_fold(spark, apart):
    rng = random.Random(apart)
    days, at = [], 0
    for _ in range(150):
        at += rng.choice([0, 0, 1, 1, 2, 3, apart, apart + 1, 11, 40])
        days.append(at)
    rng.shuffle(days)
    want = fold(days, apart)
    rows = spark.createDataFrame([(i, DAY0 + dt.timedelta(d)) for i, d in enumerate(days)] + [(-1, None)], "i int, c date")
    for block in (1, 16, 1024):  # many blocks, down to the least that a block may hold
        got = {r.i: r.index_cutoff for r in reused_cutoffs(rows, "c", apart, block).collect()}
        assert got == {i: DAY0 + dt.timedelta(want[d]) for i, d in enumerate(days)} | {-1: None}


def test_empty_and_equal_days(spark):
    rows = spark.createDataFrame([(1, DAY0), (2, DAY0)], "i int, c date")
    assert [r.index_cutoff for r in reused_cutoffs(rows, "c", 5).collect()] == [DAY0, DAY0]
    assert reused_cutoffs(rows.limit(0), "c", 5).collect() == []
