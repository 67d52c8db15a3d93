"""Cuts of splits against the rules written out on small series."""

import math
import random

import pytest

from tidemark.operators import splits as P


def frame(spark, series):
    return spark.createDataFrame([(s, t) for s, times in series.items() for t in times], "symbol string, time long").repartition(3)


@pytest.fixture(scope="module")
def series():
    rng = random.Random(9)
    return {s: sorted(rng.sample(range(0, 4000, 10), n)) for s, n in (("a", 37), ("b", 3), ("c", 1), ("d", 120))}


def parts(df, *by):
    out = {}
    for r in df.collect():
        out.setdefault((*(r[c] for c in by), r.part), []).append((r.symbol, r.time))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("folds,train", [(4, 0.5), (3, 0.7), (1, 0.1)])
def test_walk_forward(spark, series, folds, train):
    coarse = {s: sorted({t // 100 * 100 for t in times}) for s, times in series.items()}
    expected = {}
    for s, times in series.items():
        n, first = len(times), math.floor(len(times) * train)
        step = (n - first) // folds
        for i in range(folds):
            cut, end = first + i * step, n if i == folds - 1 else first + (i + 1) * step
            if 0 < cut < end:
                for t in coarse[s]:
                    if t <= times[end - 1]:
                        expected.setdefault((i + 1, "train" if t <= times[cut - 1] else "holdout"), []).append((s, t))
    found = parts(P.in_folds(frame(spark, coarse), P.walk_forward(frame(spark, series), folds, train)), "fold")
    assert found == {k: sorted(v) for k, v in expected.items()}


def test_epochs(spark, series):
    found = {}
    for r in P.in_epochs(frame(spark, series), P.epochs(frame(spark, series), 5)).collect():
        found.setdefault((r.symbol, r.epoch), []).append(r.time)
    for s, times in series.items():
        bounds = [times[len(times) * i // 5] for i in range(5)] + [math.inf]
        for i in range(5):
            assert sorted(found.get((s, i), [])) == [t for t in times if bounds[i] <= t < bounds[i + 1]]
    assert sum(map(len, found.values())) == sum(map(len, series.values()))


def test_fraction_and_window(spark, series):
    found = parts(P.by_fraction(frame(spark, series), frame(spark, series), 0.7))
    assert found["holdout",] == sorted((s, t) for s, times in series.items() for t in times if t >= times[math.floor(len(times) * 0.7)])
    inside = {s: [t for t in times if 500 <= t <= 3000] for s, times in series.items()}
    found = parts(P.by_window(frame(spark, series), frame(spark, series), 500, 3000, 0.7))
    assert found["holdout",] == sorted((s, t) for s, times in inside.items() for t in times if t >= times[math.floor(len(times) * 0.7)])
    assert sum(map(len, found.values())) == sum(map(len, inside.values()))


def test_others(spark):
    rows = frame(spark, {"a": [0, 86400, 5 * 86400], "b": [2 * 86400, 4 * 86400], "c": [86400]})
    assert parts(P.by_time(rows, 86400))["train",] == [("a", 0)]
    assert parts(P.by_recent_days(rows, 1))["holdout",] == [("a", 5 * 86400), ("b", 4 * 86400)]
    dated = rows.selectExpr("symbol", "time", "time div 86400 AS date")
    assert parts(P.by_recent_dates(dated, 2))["holdout",] == [("a", 5 * 86400), ("b", 4 * 86400)]
    assert parts(P.by_recent_dates(dated, 9)).keys() == {("holdout",)}
    assert parts(P.by_symbol(rows, ["a", "b"], ["b"])) == {("train",): [("a", 0), ("a", 86400), ("a", 5 * 86400)], ("holdout",): [("b", 2 * 86400), ("b", 4 * 86400)]}
    for holdout, least in ((["z"], 1), (["a"], 2)):
        with pytest.raises(ValueError):
            P.by_symbol(rows, ["a", "b"], holdout, least)
    none = rows.limit(0)
    assert P.by_recent_days(none, 3).count() == P.by_fraction(none, none).count() == P.in_folds(none, P.walk_forward(none)).count() == P.in_epochs(none, P.epochs(none, 3)).count() == 0
