"""Queries that ask every bar, against brute force."""

import bisect
from collections import defaultdict

from tidemark.operators import pivots as P
from tidemark.plans import lenses as L
from tidemark.plans import registry


def series(df, *names):
    out = defaultdict(list)
    for r in sorted(df.select("symbol", *names).collect()):
        out[r.symbol].append(r)
    return out


def test_resistance_of_every_bar(spark, sf):
    found = {(r.symbol, r.i): r.resistance for r in registry.queries()["j5_resistance"](spark, sf).collect()}
    expected = {}
    for symbol, rows in series(P.with_pivots(L.bars(spark, sf)), "i", "close", "pivot", "pivot_price").items():
        for r in rows:
            expected[symbol, r.i] = min((h.pivot_price for h in rows if h.pivot == "high" and h.i < r.i and h.pivot_price > r.close), default=None)
    assert found == expected and any(i % 24 and p for (_, i), p in found.items())


def test_funding_from_every_bar(spark, sf):
    found = sorted(tuple(r) for r in registry.queries()["c2_funding_cost"](spark, sf).select("symbol", "entry", "funding").collect())
    expected = []
    for symbol, rows in series(L.bars(spark, sf), "time", "buy_vol", "sell_vol").items():
        times = [r.time for r in rows]
        for k, r in enumerate(rows):
            expected.append((symbol, r.time, sum(x.buy_vol - x.sell_vol for x in rows[k : bisect.bisect_left(times, r.time + 36000)])))
    assert found == sorted(expected)


def test_support_of_every_bar(spark, sf):
    found = {(r.symbol, r.i): r.support for r in registry.queries()["j6_support_touch"](spark, sf).collect()}
    expected = {}
    for symbol, rows in series(P.with_pivots(L.bars(spark, sf)), "i", "low", "pivot", "pivot_price").items():
        for r in rows:
            met = [(abs(r.low - h.pivot_price), h.i, h.pivot_price) for h in rows if h.pivot == "low" and h.i < r.i and 0.98 * h.pivot_price <= r.low <= 1.004 * h.pivot_price]
            if met:
                expected[symbol, r.i] = min(met)[2]
    assert found == expected and found
