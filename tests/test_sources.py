"""Responses of every shape, tables by day, and bars whose repetitions are settled alike."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.sources import tables as T

FIELDS = ["open", "high", "low", "close", "volume", "buy_vol", "sell_vol", "trades", "max_trade"]


def bar(symbol, time, close=2.0, **other):
    return (symbol, time, *(other.get(f, {"close": close, "high": 9.0, "low": 1.0, "trades": 3}.get(f, 2.0)) for f in FIELDS))


@pytest.fixture(scope="module")
def bars(spark):
    return lambda rows: spark.createDataFrame(rows, T.BAR_SCHEMA)


def told(spark, **bodies):
    frame = spark.createDataFrame([(k, json.dumps(v) if not isinstance(v, str) else v) for k, v in bodies.items()], "k string, body string")
    return sorted(((r.k, r["shape"], r.timestamp, json.loads(r.value)) for r in T.points(frame, "body", "k").collect()), key=str)


def test_shapes(spark):
    found = told(
        spark, array={"result": {"timestamp": [100, "bad", 300, "400"], "data": [1, 2, {"long": 3}, None, 5]}}, parallel={"result": {"timestamp": [1, 2, 3], "data": {"a": [1, 2, 3], "b": ["x", None], "no": 7}}},
        wrapped={"result": {"timestamp": [1, 2], "data": {"top": {"a": [1, [2]], "b": [3, 4]}}}}, nested={"result": {"timestamp": [5, 6], "data": {"bid": {"s": [1, 2], "m": 9}, "ask": {"s": [3, 4]}, "none": {}}}},
        empty={"result": {"timestamp": [], "data": []}}, bare={"result": {"timestamp": [1], "data": {}}}, lone={"result": {"timestamp": [1], "data": {"a": [4]}}},
    )
    assert found == sorted([
        ("array", "array", 100.0, 1), ("array", "array", 300.0, {"long": 3}), ("array", "array", 400.0, None), ("parallel", "parallel", 1.0, {"a": 1, "b": "x"}), ("parallel", "parallel", 2.0, {"a": 2, "b": None}),
        ("wrapped", "parallel", 1.0, {"a": 1, "b": 3}), ("wrapped", "parallel", 2.0, {"a": [2], "b": 4}), ("nested", "nested", 5.0, {"ask": {"s": 3}, "bid": {"s": 1}}), ("nested", "nested", 6.0, {"ask": {"s": 4}, "bid": {"s": 2}}), ("lone", "parallel", 1.0, {"a": 4}),
    ], key=str)


@pytest.mark.parametrize("body", ["no json", {"result": {"timestamp": 5, "data": []}}, {"result": {"timestamp": [1], "data": 5}}, {}])
def test_other_forms_end_the_query(spark, body):
    with pytest.raises(Exception, match="without result"):
        told(spark, x=body)


def test_days_are_replaced_whole_and_others_not_touched(spark, bars, tmp_path):
    at = f"{tmp_path}/t"
    T.replace_days(bars([bar(s, d * 86400 + m * 60) for s in "ab" for d in range(3) for m in range(4)]), at)
    before = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(at) for f in fs if f.endswith(".parquet")}
    T.replace_days(bars([bar("a", 86400, 5.0), bar("a", 86400, 7.0), bar("c", 60)]), at)
    after = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(at) for f in fs if f.endswith(".parquet")}
    rows = sorted((r.symbol, r.time, r.close) for r in spark.read.parquet(at).collect())
    assert rows == sorted([(s, d * 86400 + m * 60, 2.0) for s in "ab" for d in range(3) for m in range(4) if (s, d) != ("a", 1)] + [("a", 86400, 7.0), ("c", 60, 2.0)])
    assert len(before) == 6 and sum(after.get(f) == t for f, t in before.items()) == 5


def test_merges_of_repeated_bars(spark, bars):
    stored, archive = [bar("a", 0, 1.5), bar("a", 60, 3.0), bar("a", 60, 4.0)], [bar("a", 0, 5.0), bar("a", 0, 6.0), bar("a", 120, 7.0)]
    for k in (1, 3):
        found = B.merge(bars(stored).repartition(k), bars(archive[::-1]).repartition(k))
        assert sorted((r.time, r.close) for r in found.collect()) == [(0, 6.0), (60, 4.0), (120, 7.0)] and found.columns == bars(stored).columns
        found = B.replace_range(bars(stored[:2]).repartition(k), bars(archive).repartition(k))
        assert sorted((r.time, r.close) for r in found.collect()) == [(0, 6.0), (60, 3.0), (120, 7.0)]


@pytest.mark.parametrize("field", ["time", *FIELDS])
def test_every_field_is_checked(spark, bars, field):
    good, at = bar("a", 120), 1 + ["time", *FIELDS].index(field)
    bad = [None, -60, 61] if field == "time" else [None, -1] if field == "trades" else [None, -1.0, float("nan"), float("inf"), float("-inf")]
    rows = [good, *((*good[:at], x, *good[at + 1 :]) for x in bad)]
    assert [r.bad for r in bars(rows).select(B.invalid().alias("bad")).collect()] == [False] + [True] * len(bad)
    assert bars([good]).filter(F.lit(False)).filter(B.invalid()).count() == 0


def test_gap_audit(spark, bars):
    rows = [bar("a", 60 * k) for k in (0, 1, 2, 5, 6, 7, 8, 9, 30)] + [bar("b", 86400 * 20)]
    found = {r.symbol: r for r in B.gap_audit(bars(rows), 60).collect()}
    a, b = found["a"], found["b"]
    assert (a.bars, a.gaps, a.missing, a.largest, a.train_gaps, a.holdout_gaps, a.train_missing, a.holdout_missing, a.flagged, a.stale) == (9, 2, 1320, 1200, 1, 1, 120, 1200, True, True)
    assert a.missing_share == pytest.approx(1320 / 1860) and a.stale_days == pytest.approx((86400 * 20 - 1800) / 86400)
    assert (b.gaps, b.missing, b.missing_share, b.flagged, b.stale_days, b.stale) == (0, 0, 0, False, 0, False)
    assert B.gap_audit(bars([]), 60).count() == 0
