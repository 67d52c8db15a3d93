"""The whole grid of stops and targets against brute force."""

from collections import defaultdict

import pytest

from tidemark.operators import entries as E
from tidemark.operators import joins as J
from tidemark.plans import lenses as L
from tidemark.plans import registry


def series(df, *names):
    out = defaultdict(list)
    for r in sorted(df.select("symbol", *names).collect()):
        out[r.symbol].append(r)
    return out


def grid(bars, entries, horizon, stops, targets):
    cells = {(k, m): [0, 0, 0, 0] for k in stops for m in targets}
    for symbol, rows in entries.items():
        path = bars[symbol]
        for e in rows:
            if e.i + horizon >= len(path):
                continue
            for (k, m), cell in cells.items():
                cell[0] += 1
                for r in path[e.i + 1 : e.i + horizon + 1]:
                    if r.low <= e.close - k * e.unit:
                        cell[2] += 1
                        break
                    if r.high >= e.close + m * e.unit:
                        cell[1] += 1
                        break
                else:
                    cell[3] += 1
    return {k: tuple(v) for k, v in cells.items() if v[0]}


@pytest.mark.parametrize("horizon", [5, 30])
def test_first_passages(spark, sf, horizon):
    bars = E.prepared(L.bars(spark, sf))
    entries = bars.filter("close > top20 and atr_before > 0").selectExpr("symbol", "i", "close", "atr_before AS unit")
    stops, targets = [0.5, 1.5, 4.0], [1.0, 6.0]
    found = {(r.k_stop, r.k_target): (r.n, r.wins, r.losses, r.open) for r in J.first_passages(entries, bars, horizon, stops, targets).collect()}
    assert found and found == grid(series(bars, "i", "low", "high"), series(entries, "i", "close", "unit"), horizon, stops, targets)


def test_grid_has_every_cell(spark):
    sf = "/root/testdata/sf0.01"
    bars = E.prepared(L.bars(spark, sf))
    entries = bars.filter("close > top20 and atr_before > 0").selectExpr("symbol", "i", "close", "atr_before AS unit")
    found = {(r.k_stop, r.k_target): (r.n, r.wins, r.losses, r.open) for r in registry.queries()["x2_stop_target_grid"](spark, sf).collect()}
    assert len(found) == 42
    assert found == grid(series(bars, "i", "low", "high"), series(entries, "i", "close", "unit"), 200, [0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0], [1.0, 1.5, 2.0, 3.0, 4.0, 6.0])
