"""Nulls of pairs, regressions, and searches in two stages, against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from test_positions import SF, trades

from tidemark.operators import entries as E
from tidemark.operators import inference as R
from tidemark.operators import positions as X
from tidemark.operators import search as S
from tidemark.plans import lenses as L


def fit(xs, ys):
    """Coefficients, errors and residuals of least squares by lists of regressors."""
    a = np.array(xs).T
    inverse = np.linalg.inv(a.T @ a)
    beta = inverse @ a.T @ ys
    rest = ys - a @ beta
    return beta, np.sqrt(np.diag(inverse) * (rest @ rest) / (len(ys) - a.shape[1])), rest


def pull(y, x):
    beta, _, rest = fit([np.ones(len(x)), x], y)
    step = np.diff(rest)
    rho, error, _ = fit([np.ones(len(step) - 1), rest[1:-1], step[:-1]], step[1:])
    return beta, rho[1], rho[1] / error[1]


def test_pair_null(spark):
    rng = random.Random(8)
    rows, series = [], {}
    for one, other, n, tied in (("a", "b", 130, True), ("a", "c", 61, False), ("b", "c", 16, True), ("d", "e", 40, None)):
        x = np.cumsum([rng.gauss(0, 1) for _ in range(n)]) if tied is not None else np.zeros(n)
        y = 2 + 0.7 * x + np.array([rng.gauss(0, 0.5) for _ in range(n)]) if tied else np.cumsum([rng.gauss(0, 1) for _ in range(n)])
        series[one, other] = y, x
        rows += [(one, other, t, float(y[t]), float(x[t]), "clash") for t in range(n)]
    rows.append(("a", "b", 999, None, 1.0, "clash"))
    rng.shuffle(rows)
    found = {(r.one, r.other): r for r in R.pair_null(spark.createDataFrame(rows, "one string, other string, time long, y double, x double, p string"), 40, 20).collect()}
    assert set(found) == {("a", "b"), ("a", "c"), ("d", "e")}  # a history of 16 is too short
    assert found["d", "e"].t is None and found["d", "e"].p is None and found["d", "e"].drawn == 0
    for key in (("a", "b"), ("a", "c")):
        y, x = series[key]
        beta, rho, t = pull(y, x)
        row = found[key]
        assert (row.alpha, row.beta, row.rho, row.t) == pytest.approx((*beta, rho, t)) and row.n == len(y)
        moves, hits = np.diff(x), 0
        for replica in range(1, 41):
            order = sorted(range(math.ceil(len(moves) / 20)), key=lambda b: hashlib.md5(f"c|{replica}|{'|'.join(key)}|{b}".encode()).hexdigest())
            hits += pull(y, x[0] + np.append(0, np.cumsum(np.concatenate([moves[20 * b : 20 * b + 20] for b in order]))))[2] <= t + 1e-12
        assert row.p == pytest.approx((hits + 1) / 41) and row.drawn == 40
        assert row.half_life == (pytest.approx(math.log(0.5) / math.log(1 + rho)) if -1 < rho < 0 else None)
    assert found["a", "b"].p < found["a", "c"].p
    assert R.pair_null(spark.createDataFrame([], "one string, other string, time long, y double, x double")).count() == 0


def test_regression(spark):
    rng = random.Random(1)
    rows = [(g, *(x := [rng.gauss(1e4, 3), rng.random(), rng.gauss(-2, 1)]), 3 + 2 * x[0] - x[1] + rng.gauss(0, 0.3)) for g in "pq" for _ in range(50 if g == "p" else 9)]
    frame = spark.createDataFrame([*rows, ("p", None, 1.0, 1.0, 1.0)], "g string, a double, b double, c double, y double")
    for r in R.regression(frame, "y", ["a", "b", "c"], "g").collect():
        own = [x for x in rows if x[0] == r.g]
        beta, errors, rest = fit([np.ones(len(own)), *(np.array([x[k] for x in own]) for k in (1, 2, 3))], ys := np.array([x[4] for x in own]))
        assert [r.intercept, *r.slopes] == pytest.approx(beta.tolist(), rel=1e-5) and r.errors == pytest.approx(errors.tolist(), rel=1e-5)
        assert r.n == len(own) and r.r2 == pytest.approx(1 - rest @ rest / ((ys - ys.mean()) @ (ys - ys.mean())))
    whole = R.regression(frame, "y", ["a"]).collect()
    assert len(whole) == 1 and whole[0].n == 59
    twice = frame.withColumn("d", 2 * F.col("a") + F.col("b"))
    with pytest.raises(PythonException):
        R.regression(twice, "y", ["a", "b", "d"], "g").collect()
    assert [r.slopes for r in R.regression(twice, "y", ["a", "b", "d"], "g", singular="null").collect()] == [None, None]
    assert [r.slopes for r in R.regression(frame.limit(3), "y", ["a", "b", "c"], singular="null").collect()] == [None]


def test_search(spark):
    modes, exits = ("breakout", "ma_dip", "rsi"), [x for x in S.configurations((2.0, 4.0)) if "lock" not in x.name or "trail" in x.name]
    bars = L.bars(spark, SF)
    found = {(r["mode"], r.config): r for r in S.strategy_search(bars, modes, exits, least=25, top=4).collect()}
    parts = []
    for half in S.halves(bars):
        ready = S.ready(half).cache()
        paths, asked = {}, {}
        for r in ready.select("symbol", "i", "open", "high", "low", "close", "pivot").orderBy("symbol", "i").collect():
            paths.setdefault(r.symbol, []).append(r)
        for mode in modes:
            for r in E.candidates(ready, mode, min_stop=None).filter("reason = 'taken'").collect():
                asked.setdefault((mode, r.symbol), []).append(r)
        own = {(m, x.name): {s: rs for s in paths if (rs := [t[3] for t in trades(paths[s], asked.get((m, s), []), x)])} for m in modes for x in exits}
        parts.append({key: (sum(map(len, v.values())), sum(map(sum, v.values())) / max(1, sum(map(len, v.values()))), len(v), sum(sum(x) > 0 for x in v.values())) for key, v in own.items()})
    assert sum(len(v) for v in paths.values()) + parts[0]["rsi", exits[0].name][0] > 0
    train, holdout = parts
    best = sorted((k for k, v in train.items() if v[0] >= 25), key=lambda k: (-round(train[k][1], 9), *k))[:4]
    assert len(best) == 4 and {k: r.place for k, r in found.items()} == {k: i + 1 for i, k in enumerate(best)}
    for key, r in found.items():
        assert (r.trades, r.avg_r, r.assets, r.positive_assets) == pytest.approx(train[key])
        if holdout[key][0]:
            assert (r.holdout_trades, r.holdout_avg_r, r.holdout_assets, r.holdout_positive_assets) == pytest.approx(holdout[key])
        assert r.promoted == (train[key][1] > 0 and holdout[key][1] > 0 and holdout[key][3] >= 0.5 * holdout[key][2])


def test_halves_are_cut_by_time(spark):
    bars = spark.createDataFrame([(s, t) for s, n in (("a", 10), ("b", 1), ("c", 3)) for t in range(0, 60 * n, 60)], "symbol string, time long")
    first, second = ({(r.symbol, r.time // 60) for r in x.collect()} for x in S.halves(bars))
    assert first == {("a", k) for k in range(7)} | {("c", 0), ("c", 1)} and second == {("a", 7), ("a", 8), ("a", 9), ("b", 0), ("c", 2)}


def test_only_folders_of_chosen_modes_are_read(spark, tmp_path):
    spark.createDataFrame([(k, m) for m in ("x", "y", "z") for k in range(5)], "i long, mode string").write.partitionBy("mode").parquet(f"{tmp_path}/e")
    spark.createDataFrame([("y", 1), ("z", 2)], "mode string, place int").write.parquet(f"{tmp_path}/c")
    asked = S.entries_of(spark.read.parquet(f"{tmp_path}/e"), spark.read.parquet(f"{tmp_path}/c"), 1)
    assert {r["mode"] for r in asked.collect()} == {"y"}
    assert "dynamicpruning" in asked._jdf.queryExecution().executedPlan().toString()


def test_gates(spark):
    columns = "v string, trades long, avg_r double, assets long, positive_assets long"
    train = spark.createDataFrame([("bad", 300, -0.6, 5, 1), ("few", 199, 0.5, 5, 5), ("good", 200, 0.4, 5, 5), ("best", 900, 0.5, 5, 5), ("none", 201, 0.1, 5, 5), ("narrow", 201, 0.2, 5, 5)], columns)
    later = spark.createDataFrame([("bad", 900, 1.0, 5, 5), ("good", 149, 0.1, 5, 5), ("best", 150, -0.2, 5, 2), ("narrow", 400, 0.3, 6, 2)], columns)
    asked = []

    def holdout(chosen):
        asked.append({r.v for r in chosen.collect()})
        return later

    found = {r.v: r for r in S.gated(train, holdout, "v").collect()}
    assert {v: r.verdict for v, r in found.items()} == {"bad": "train_fail", "few": "train_fail", "good": "holdout_fail", "best": "pass", "none": "holdout_fail", "narrow": "holdout_fail"}
    assert asked == [{"good", "best", "none", "narrow"}] and found["bad"].holdout_trades is None and found["best"].holdout_trades == 150
    found = {r.v: r.verdict for r in S.gated(train, holdout, "v", best_only=True).collect()}
    assert asked[1] == {"best"} and found["good"] == "not_selected" and found["best"] == "pass"
