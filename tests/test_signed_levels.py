"""The price of the trades lens is a walk, which larger tables take through zero and below."""

import math
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

QUERIES = ["b5_quality", "b6_manifest", "io1_csv_bars", "io19_clean_history", "b9_slippage", "c17_exposure", "w16_beta", "io6_verify"]


@pytest.fixture(scope="module")
def walks(tmp_path_factory):
    """Hourly trades of a walk that falls through zero and comes back to it, of one that stays below, and of one that stays above; three in every other hour."""
    rows, n = [], 0
    start = datetime(2024, 1, 1)
    for hour in range(700):
        for name, down in (("falls", hour < 250 or 300 <= hour < 330), ("sinks", hour < 420 or hour % 2), ("stays", hour % 3 == 0)):
            for k in range(3 if hour % 2 else 1):
                # ten down or up for ``falls`` and ``sinks`` in the first trade of an hour, one up and one down after it
                step = (9 if k == 0 else 0, down if k == 0 else k == 2)
                rows.append((n, start + timedelta(hours=hour, minutes=20 * k), (step[0] - (9 if step[1] else 8)) % 10, name, 1.0, '{"k": %d}' % (9 if step[1] else 8)))
                n += 1
    folder = tmp_path_factory.mktemp("walks")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY t TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def plain(value):
    return repr(float(value)) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", QUERIES)
def test_levels_of_any_sign(spark, walks, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{walks}/events.parquet'")
    wanted = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    expected = sorted(tuple(map(plain, r)) for r in wanted.fetchall())
    found = entry.queries()[name](spark, walks)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == expected


def test_an_entry_at_zero_is_too_far_from_its_stop(spark, walks):
    from tidemark.operators import entries as E
    from tidemark.plans import lenses as L

    bars = E.prepared(L.bars(spark, walks)).withColumn("atr_before", F.lit(4.0)).withColumn("top20", F.col("close") - 1).localCheckpoint()
    found = {r.entry: r.reason for r in E.candidates(bars, "breakout", min_stop=None).filter("symbol = 'falls'").collect()}
    assert found[0.0] == "stop_too_far" and found[2000.0 - 100] == "taken" and found[-100.0] == "taken"


def test_the_walks_cross_zero(spark, walks):
    from tidemark.plans import lenses as L

    closes = {r.symbol: r for r in L.bars(spark, walks).groupBy("symbol").agg({"close": "min", "low": "min", "high": "max"}).collect()}
    assert closes["falls"]["min(close)"] < 0 and closes["sinks"]["min(close)"] < 0 < closes["stays"]["min(close)"]
    assert L.bars(spark, walks).filter("close = 0").count() > 0 and not math.isnan(closes["stays"]["max(high)"])


def test_gate_with_an_entry_at_zero(spark, walks):
    found = entry.queries()["i19_volume_gate"](spark, walks).collect()
    assert {r.verdict for r in found} <= {"train_fail", "not_selected", "holdout_fail", "pass"} and found


def test_gate_with_a_symbol_whose_first_breakout_stays_open(spark, tmp_path):
    """Hourly trades that go to and fro by one and break out upwards once; ``ends`` falls through its stop at once, ``open`` stays between stop and target."""
    rows, n = [], 0
    for hour in range(100):
        for name in ("open", "ends"):
            size = {40: 2, 41: 9 if name == "ends" else 1}.get(hour, 1)
            k = 8 + hour % 2  # up in even hours
            rows.append((n, datetime(2024, 1, 1) + timedelta(hours=hour), (size - 1 - k) % 10, name, 1.0, '{"k": %d}' % k))
            n += 1
    con = duckdb.connect()
    con.execute("CREATE TABLE t (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY t TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    found = entry.queries()["i19_volume_gate"](spark, str(tmp_path)).collect()
    assert [(r.threshold, r.trades, r.assets, r.verdict) for r in found] == [(0.5, 1, 1, "train_fail")]
    assert found[0].avg_r == pytest.approx((2000 - 2002 - 0.0045 * 4002) / 2)
