"""Exits and trades against a reading of each entry's bars one by one."""

import dataclasses
import random

import pytest

from tidemark.operators import entries as E
from tidemark.operators import positions as X
from tidemark.plans import lenses as L
from tidemark.plans import registry
from tidemark.plans.trade_queries import EXITS

SF = "/root/testdata/sf0.01"


def ended(path, start, entry, stop, x):
    """(bar, price, label, partial bar) of the first exit, or None."""
    risk = entry - stop
    lock = max(x.lock_r * risk, x.fee_buffer * entry)
    partial = None
    for k in range(start + 1, min(len(path), start + x.max_hold + 1)):
        peak = max([entry, *(b.high for b in path[start + 1 : k])])
        levels = [stop]
        if x.trail_r and peak >= entry + x.trail_start_r * risk:
            levels.append(peak - x.trail_r * risk)
        if x.lock_at_r is not None and peak >= entry + max(x.lock_at_r * risk, lock + 0.5 * risk):
            levels.append(entry + lock)
        bar, now = path[k], max(levels)
        if bar.low <= now:
            return k, now, "trail/be" if len(levels) > 1 else "stop", partial
        if x.trailing_target is None and bar.high >= entry + x.target_r * risk:
            return k, entry + x.target_r * risk, "target", partial
        if x.trailing_target is not None and peak > entry and bar.low <= peak * (1 - x.trailing_target):
            return k, peak * (1 - x.trailing_target), "trailing_target", partial
        if partial is None and x.partial_at_r and bar.high >= entry + x.partial_at_r * risk:
            partial = k
        if x.swing_high and bar.pivot == "high" and bar.close > entry:
            return k, bar.close, "swing_high", partial
        if k == start + x.max_hold:
            return k, bar.close, "timeout", partial
    return None


def trades(path, entries, x):
    out, free = [], 0
    for e in sorted(entries, key=lambda e: e.i):
        if e.i < free:
            continue
        start, price = e.i + x.delay, e.entry
        if x.delay:
            if start >= len(path) or path[start].open <= e.stop:
                continue
            price = path[start].open
        net = lambda p: (p - price) / (price - e.stop) - x.cost * (price + p) / (price - e.stop)  # noqa: B023, E731
        if x.delay and path[start].low <= e.stop:
            out.append((e.i, start, "same_bar", net(e.stop), 0.0))
            free = e.i + 1
            continue
        found = ended(path, start, price, e.stop, x)
        if not found:
            break
        at, left, label, partial = found
        banked = x.partial_share * net(price + x.partial_at_r * (price - e.stop)) if partial is not None else 0.0
        out.append((e.i, at, label, banked + (1 - x.partial_share if partial is not None else 1) * net(left), banked))
        free = at + 1
    return out


@pytest.fixture(scope="module")
def market(spark):
    bars = E.prepared(L.bars(spark, SF)).cache()
    entries = E.candidates(bars, "breakout", min_stop=None).filter("reason = 'taken'").cache()
    paths, asked = {}, {}
    for r in bars.select("symbol", "i", "open", "high", "low", "close", "pivot").orderBy("symbol", "i").collect():
        paths.setdefault(r.symbol, []).append(r)
    for r in entries.select("symbol", "i", "entry", "stop").collect():
        asked.setdefault(r.symbol, []).append(r)
    return bars, entries, paths, asked


def test_every_model(market):
    bars, entries, paths, asked = market
    models = [*EXITS, X.Exit("all", target_r=3.0, partial_at_r=0.5, trail_r=1.5, lock_at_r=0.7, swing_high=True, delay=1, max_hold=40)]
    found = {}
    for r in X.simulate(bars, entries, models).collect():
        found.setdefault(r.config, []).append((r.symbol, r.trade, r.entry_i, r.exit_i, r.label, round(r.r, 9), round(r.partial_r, 9)))
    for x in models:
        expected = [(s, k + 1, a, b, label, round(r, 9), round(p, 9)) for s in asked for k, (a, b, label, r, p) in enumerate(trades(paths[s], asked[s], x))]
        assert expected and sorted(found[x.name]) == sorted(expected), x.name
    labels = {t[4] for x in found.values() for t in x}
    assert labels >= {"stop", "target", "trail/be", "trailing_target", "swing_high", "timeout"}


def test_filled_and_stopped_on_one_bar(spark):
    rng = random.Random(4)
    close = [100 + rng.randrange(-9, 10) / 2 for _ in range(400)]
    rows = [("s", i, close[i - 1], max(close[i - 1 : i + 1]) + 1.0, min(close[i - 1 : i + 1]) - 1.0, close[i], None) for i in range(1, 400)]
    bars = spark.createDataFrame([("s", r[1] - 1, *r[2:]) for r in rows], "symbol string, i long, open double, high double, low double, close double, pivot string")
    entries = spark.createDataFrame([("s", i, close[i + 1], close[i + 1] - 1.5) for i in range(0, 395, 3)], "symbol string, i long, entry double, stop double")
    path, asked = bars.orderBy("i").collect(), entries.collect()
    models = [dataclasses.replace(X.Exit("a", target_r=1.0, max_hold=7), delay=d, name=f"d{d}") for d in (0, 1, 2)]
    found = X.simulate(bars, entries, models).collect()
    for x in models:
        own = sorted((r.entry_i, r.exit_i, r.label, round(r.r, 9)) for r in found if r.config == x.name)
        assert own == [(a, b, label, round(r, 9)) for a, b, label, r, _ in trades(path, asked, x)]
    assert any(r.label == "same_bar" for r in found)


def test_summaries(spark, market):
    bars, entries, paths, asked = market
    found = {r.config: r for r in registry.queries()["x_exit_sweep"](spark, SF).collect()}
    taken = E.candidates(bars, "breakout").filter("reason = 'taken'").collect()
    own = {s: [r for r in taken if r.symbol == s] for s in paths}
    for x in EXITS:
        rs = {s: [t[3] for t in trades(paths[s], own[s], x)] for s in own}
        n = sum(map(len, rs.values()))
        assert found[x.name].trades == n and found[x.name].avg_r == pytest.approx(sum(map(sum, rs.values())) / n)
        assert found[x.name].positive_assets == sum(sum(v) > 0 for v in rs.values())
    late = {r.config: r for r in registry.queries()["c8_delay_curve"](spark, SF).collect()}
    for d in (0, 3, 5):
        rs = [t[3] for s in own for t in trades(paths[s], own[s], X.Exit("late", delay=d))]
        assert late[f"delay{d}"].trades == len(rs) and late[f"delay{d}"].total_r == pytest.approx(sum(rs))
    whole = {(r["mode"], r.config): r for r in registry.queries()["x_tournament"](spark, SF).collect()}
    levelled = E.with_contraction(E.with_levels(bars)).cache()
    assert len(E.MODES) == 11 and len({mode for mode, _ in whole}) >= 10
    for mode in E.MODES:
        taken = E.candidates(levelled, mode, min_stop=None).filter("reason = 'taken'").collect()
        rs = [t[3] for s in paths for t in trades(paths[s], [r for r in taken if r.symbol == s], X.Exit("net"))]
        if not rs:
            assert (mode, "net") not in whole
            continue
        assert whole[mode, "net"].trades == len(rs) and whole[mode, "net"].total_r == pytest.approx(sum(rs))
        assert whole[mode, "gross"].total_r > whole[mode, "net"].total_r


def test_no_entries(market):
    bars, entries, *_ = market
    assert X.simulate(bars, entries.limit(0), EXITS[:2]).count() == 0


def test_a_series_whose_first_entry_stays_open(spark):
    """It has no trades, and holds up no other series."""
    bars = spark.createDataFrame([(s, i, 100.0, 100.5, 99.5, 100.0, None) for s in ("open", "ends") for i in range(10)], "symbol string, i long, open double, high double, low double, close double, pivot string")
    entries = spark.createDataFrame([("open", 2, 100.0, 95.0), ("open", 5, 100.0, 99.6), ("ends", 2, 100.0, 99.6)], "symbol string, i long, entry double, stop double")
    found = X.simulate(bars, entries, [X.Exit("live")]).collect()
    assert [(r.symbol, r.trade, r.entry_i, r.exit_i, r.label) for r in found] == [("ends", 1, 2, 3, "stop")]
    assert X.simulate(bars, entries.filter("symbol = 'open'"), [X.Exit("live")]).count() == 0
