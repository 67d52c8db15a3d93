"""Buys on a shared calendar against a walk over its dates, and features that tell outcomes apart."""

import random

import pytest

from tidemark.operators import allocation as C
from tidemark.operators import stats as A


@pytest.fixture(scope="module")
def prices():
    rng = random.Random(2)
    return {(s, d): rng.uniform(5, 20) for s, first, last in (("a", 0, 40), ("b", 3, 40), ("c", 11, 25)) for d in range(first, last) if rng.random() < 0.7 or d == 0}


def walk(prices, every, cost):
    dates, units, known, out, invested, peak = sorted({d for _, d in prices}), {}, {}, [], 0.0, 1.0
    for k, d in enumerate(dates):
        known |= {s: p for (s, e), p in prices.items() if e == d}
        if k % every == 0 and known:
            for s in known:
                units[s] = units.get(s, 0) + (1 - cost) / len(known) / known[s]
            invested += 1
        value = sum(units.get(s, 0) * p for s, p in known.items())
        peak = max(peak, value / invested)
        out.append((d, invested, value, value / invested, value / invested / peak - 1))
    return out


def test_interval_buys(spark, prices):
    frame = spark.createDataFrame([(s, d * 7, p) for (s, d), p in prices.items()], "symbol string, time long, close double").repartition(3)
    found = [tuple(r) for r in C.shared_interval_buys(frame, 4, cost=0.01).orderBy("time").collect()]
    expected = [(d * 7, *rest) for d, *rest in walk(prices, 4, 0.01)]
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert a == pytest.approx(b)
    assert C.shared_interval_buys(frame.limit(0), 4).count() == 0 and C.shared_buy_and_hold(frame.limit(0)).count() == 0


def test_hold(spark, prices):
    frame = spark.createDataFrame([(s, d, p) for (s, d), p in prices.items()], "symbol string, time long, close double")
    dates, first = sorted({d for _, d in prices}), min(d for _, d in prices)
    start = {s: p for (s, d), p in prices.items() if d == first}
    known, peak = dict(start), 1.0
    for row, d in zip(C.shared_buy_and_hold(frame, 0.01).orderBy("time").collect(), dates, strict=True):
        known |= {s: p for (s, e), p in prices.items() if e == d and s in start}
        value = sum(0.99 / len(start) * known[s] / start[s] for s in start)
        peak = max(peak, value)
        assert (row.time, row.value, row.drawdown) == pytest.approx((d, value, value / peak - 1))


def test_separations(spark):
    rows = [(True, 1.0, 5.0, True, None), (True, 3.0, None, False, None), (False, 2.0, 5.0, False, True), (False, None, 5.0, False, True), (None, 99.0, 99.0, True, True)]
    frame = spark.createDataFrame(rows, "win boolean, a double, b double, f boolean, g boolean")
    found = [(r.feature, r.kind, r.winners, r.losers, round(r.separation, 6), r.place) for r in A.separations(frame, "win", ["a", "b"], ["f", "g"]).orderBy("place").collect()]
    assert found == [("f", "flag", 50.0, 0.0, 0.5, 1), ("a", "number", 2.0, 2.0, 0.0, 2), ("b", "number", 5.0, 5.0, 0.0, 3)]
