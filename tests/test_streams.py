"""Streams that stop and go on: positions, pages and the ledger, against what one run over everything gives."""

import json
import random

import pytest
from pyspark.errors import StreamingQueryException

from tidemark.plans import registry
from tidemark.plans.source_queries import priced
from tidemark.sources.tables import BAR_SCHEMA
from tidemark.streaming import ingest, positions
from tidemark.streaming.live import event_stream

SECOND = 1_000_000
PRICES = "symbol string, ts timestamp, event_id long, price double, stop double, target double"


def one_by_one(rows, rules, watermark=None):
    """Closed positions of rows (symbol, at, id, price, stop, target) in order of time; those past their limit at the watermark end too."""
    out, held = [], {}
    end = lambda s, p, at, price, why: out.append((s, p[3], at, p[0], price, why, p[1]))
    for s, at, _, price, stop, target in sorted(rows, key=lambda r: (r[1], r[2])):
        p = held.get(s)
        if p and at >= p[3] + rules.hold * SECOND:
            end(s, p, p[3] + rules.hold * SECOND, p[5], "timeout")
            p = None
        if p:
            p, why = rules.step(p, price)
            if why:
                end(s, p, at, price, why)
                p = None
        elif stop is not None and stop < price:
            p = rules.opened(price, stop, target, at)
        held[s] = p
    for s, p in held.items():
        if p and watermark is not None and p[3] + rules.hold * SECOND <= watermark:
            end(s, p, p[3] + rules.hold * SECOND, p[5], "timeout")
    return sorted(out)


def run(stream, folder, name="x"):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()


def test_step():
    rules = positions.Rules(hold=100, arm_r=1.0, lock_r=0.2, fee_buffer=0.01)
    p = rules.opened(100.0, 95.0, 120.0, 7)
    assert rules.step(p, 95.0)[1] == "stop" and rules.step(p, 120.0)[1] == "target" and rules.step(p, 104.9) == ((100.0, 95.0, 120.0, 7, False, 104.9), None)
    raised, why = rules.step(p, 105.0)
    assert why is None and raised == (100.0, 101.0, 120.0, 7, True, 105.0) and rules.step(raised, 101.0)[1] == "stop"
    assert rules.step(raised, 119.0)[0][1] == 101.0  # once


def test_positions_over_a_restart(spark, tmp_path):
    rng = random.Random(6)
    rows, at = [], 1_700_000_000 * SECOND
    for k in range(1200):
        at += rng.randrange(1, 400) * SECOND
        price = 100 + rng.gauss(0, 3)
        signal = rng.random() < 0.2
        rows.append((rng.choice("abc") if k < 1100 else "a", at, k, price, price * rng.choice([0.97, 1.0]) if signal else None, price * 1.04 if signal else None))
    rules = positions.Rules(hold=3 * 3600)
    timed = lambda some: spark.createDataFrame(some, "symbol string, at long, event_id long, price double, stop double, target double").selectExpr("symbol", "timestamp_micros(at) AS ts", "event_id", "price", "stop", "target")
    for part in (rows[:500], rows[500:900], rows[900:]):
        timed(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(positions.positions(spark.readStream.schema(PRICES).parquet(f"{tmp_path}/in"), rules), tmp_path)  # stopped and started again each time
    found = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/rows").collect())
    expected = one_by_one(rows, rules, rows[-1][1] - 600 * SECOND)
    assert found == expected
    assert {r[5] for r in found} == {"stop", "target", "timeout"} and any(r[6] > r[3] for r in found)


def test_registered_positions(spark, sf):
    rows = priced(event_stream(spark, sf).sparkSession.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "cast(ts AS timestamp) AS ts", "event_type AS symbol", "value")).selectExpr("symbol", "unix_micros(ts)", "event_id", "price", "stop", "target").collect()
    found = sorted(tuple(r) for r in registry.queries()["st5_positions"](spark, sf).collect())
    expected = one_by_one([tuple(r) for r in rows], positions.Rules(), max(r[1] for r in rows) - 600 * SECOND)
    assert found == expected and len(found) > 20


def page(folder, cursor, last, rows):
    at = folder / "pages" / f"cursor={cursor}"
    at.mkdir(parents=True)
    (at / "part-0.txt").write_text(json.dumps({"rows": rows, "last": last}))


def trade(k):
    return {"symbol": "s", "seq": k, "sec": 60 * k, "price": 1.5 * k, "volume": 1.0, "side": "b"}


def test_pages_over_a_restart(spark, tmp_path):
    for k in range(3):
        page(tmp_path, 7 * k, str(7 * k + 7), [trade(10 * k + j) for j in range(4)])
    for more in ((), (3, 4), ()):
        for k in more:
            page(tmp_path, 7 * k, str(7 * k + 7) if k < 4 else "28", [trade(10 * k + j) for j in range(4)])  # the last names itself
        run(ingest.paged(spark, f"{tmp_path}/pages"), tmp_path)
        known = 3 if not more and not (tmp_path / "pages" / "cursor=21").exists() else 4
        seqs = sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/rows").collect())
        assert seqs == [10 * k + j for k in range(known) for j in range(4)]


def test_reader_walks_from_page_to_page(tmp_path):
    for k in range(5):
        page(tmp_path, k, str(k + 1), [trade(k)] if k != 2 else [])
    reader = ingest.PagesReader(f"{tmp_path}/pages", "0", 2, ["seq", "none"])
    assert [p.cursor for p in reader.partitions({"cursor": "1"}, {"cursor": "3"})] == ["1", "2"]
    assert reader.latestOffset() == {"cursor": "5"} and reader.latestOffset() == {"cursor": "5"}
    page(tmp_path, 5, "6", [])
    page(tmp_path, 6, "7", [])
    page(tmp_path, 7, "8", [])
    assert reader.latestOffset() == {"cursor": "7"} and reader.latestOffset() == {"cursor": "8"}
    assert list(reader.read(ingest.Page("3"))) == [(3, None)] and list(reader.read(ingest.Page("2"))) == []
    with pytest.raises(FileNotFoundError):
        reader.partitions({"cursor": "8"}, {"cursor": "9"})
    assert ingest.PagesReader(f"{tmp_path}/nothing", "4", 2, []).latestOffset() == {"cursor": "4"}


def test_many_pages_go_in_few_partitions(tmp_path, monkeypatch):
    for k in range(600):
        page(tmp_path, k, str(k + 1), [trade(k)])
    (tmp_path / "pages" / "cursor=300" / "part-0.txt").write_text('{"last": "301", "rows": [{"seq": 300}]}')  # the cursor comes first here
    reader, read, page_of = ingest.PagesReader(f"{tmp_path}/pages", "0", 2, ["seq"]), [], ingest._page
    monkeypatch.setattr(ingest, "_page", lambda folder, cursor: read.append(cursor) or page_of(folder, cursor))
    parts = reader.partitions({"cursor": "0"}, {"cursor": "600"})
    assert len(parts) <= 256 and read == ["300"]  # the driver parses no page whose end tells the next cursor
    assert [row for p in parts for row in reader.read(p)] == [(k,) for k in range(600)]
    (tmp_path / "pages" / "cursor=400" / "part-0.txt").unlink()
    with pytest.raises(FileNotFoundError):
        reader.partitions({"cursor": "0"}, {"cursor": "600"})


BAR = (1.0, 3.0, 0.5, 2.0, 1.0, 1.0, 0.0, 1, 1.0)


def test_batches_are_applied_once(spark, tmp_path):
    table, ledger = f"{tmp_path}/t/bars", f"{tmp_path}/t/ledger"
    apply = ingest.applied_once(table, ledger)
    frame = lambda *rows: spark.createDataFrame([(s, t, *BAR[:3], c, *BAR[4:]) for s, t, c in rows], BAR_SCHEMA)
    held = lambda: sorted((r.symbol, r.time, r.close) for r in spark.read.parquet(table).collect())
    apply(frame(("a", 0, 1.0), ("a", 60, 1.0), ("b", 86400, 1.0)), 0)
    apply(frame(("a", 60, 2.0), ("a", 120, 2.0)), 1)
    expected = [("a", 0, 1.0), ("a", 60, 2.0), ("a", 120, 2.0), ("b", 86400, 1.0)]
    assert held() == expected
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "bars").rglob("*.parquet")}
    apply(frame(("a", 120, 2.0), ("a", 60, 2.0)), 1)  # again, in another order
    assert held() == expected and files == {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "bars").rglob("*.parquet")}
    for rows, number in (([("a", 60, 9.0)], 1), ([("c", 60, 9.0)], 3)):  # other rows; a predecessor that is missing
        with pytest.raises(ingest.UnsafeState):
            apply(frame(*rows), number)
    (tmp_path / "t" / "ledger" / "1.json").write_text("{broken")
    (tmp_path / "t" / "ledger" / ".1.json.crc").unlink(missing_ok=True)
    with pytest.raises(ingest.UnsafeState):
        apply(frame(("a", 120, 2.0), ("a", 60, 2.0)), 1)
    assert held() == expected


def test_a_damaged_ledger_ends_the_query(spark, tmp_path):
    spark.createDataFrame([("a", 0, *BAR)], BAR_SCHEMA).write.parquet(f"{tmp_path}/in")
    (tmp_path / "ledger").mkdir()
    (tmp_path / "ledger" / "0.json").write_text("[]")
    query = spark.readStream.schema(BAR_SCHEMA).parquet(f"{tmp_path}/in").writeStream.foreachBatch(ingest.applied_once(f"{tmp_path}/bars", f"{tmp_path}/ledger")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    with pytest.raises(StreamingQueryException, match="ledger"):
        query.awaitTermination()
    assert not (tmp_path / "bars").exists()
