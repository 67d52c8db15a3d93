"""Rule discovery against a loop over replicas, with the same digests."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import discovery as D

DAY = 86400


def brute(rows, rules, k, cuts=(0.5, 0.6, 0.7), least=10, seed="d"):
    rows = sorted(rows)  # (time, key, y, a, b)
    n = len(rows)
    windows = [[i for i in range(n) if rows[i][0] > rows[int(n * c)][0]] for c in cuts]
    days = sorted({r[0] // DAY for r in rows})
    blocks = {d: [r[2] for r in rows if r[0] // DAY == d] for d in days}

    def lift(rule, ys):
        found = []
        for own in windows:
            chosen = [ys[i] for i in own if rule(rows[i])]
            if len(chosen) >= least:
                found.append(sum(chosen) / len(chosen) - sum(ys[i] for i in own) / len(own))
        return sum(found) / len(found) if len(found) >= 2 else None

    true = {name: lift(rule, [r[2] for r in rows]) for name, rule in rules.items()}
    hits = dict.fromkeys(rules, 0)
    for replica in range(1, k + 1):
        ys = [y for d in sorted(days, key=lambda d: hashlib.md5(f"{seed}|{replica}|{d}".encode()).hexdigest()) for y in blocks[d]]
        for name, rule in rules.items():
            if true[name] is not None and lift(rule, ys) >= true[name] - 1e-12:
                hits[name] += 1
    p = {name: 1.0 if true[name] is None else (hits[name] + 1) / (k + 1) for name in rules}
    order = sorted((x for x in rules if true[x] is not None), key=p.get)
    q = {x: min(min(1.0, p[y] * len(order) / (j + 1)) for j, y in enumerate(order) if j >= i) for i, x in enumerate(order)}
    middle = {name: [rows[i][2] for i in windows[1] if rule(rows[i])] for name, rule in rules.items()}
    return {x: (len(middle[x]), sum(middle[x]) / len(middle[x]) if middle[x] else None, true[x], p[x], q.get(x)) for x in rules}


@pytest.mark.parametrize("piece,stretch", [(1024, 16_384), (5, 32)])
def test_days_move_whole(spark, monkeypatch, piece, stretch):
    monkeypatch.setattr(D, "PIECE", piece)
    monkeypatch.setattr(D, "STRETCH", stretch)
    rng = random.Random(3)
    rows = [(int(rng.triangular(0, 12 * DAY, 5 * DAY)), f"s{k}", 0.0, rng.random(), rng.choice(["x", None, "y"])) for k in range(240)]
    rows += [(6 * DAY + 5, f"t{k}", 0.0, rng.random(), "x") for k in range(60)]  # one time, a day with a fifth of all rows
    rows = [(t, s, (1.5 if a > 0.7 else 0) + rng.gauss(0, 1), a, b) for t, s, _, a, b in rows]
    rules = {"a": lambda r: r[3] > 0.7, "b": lambda r: r[4] == "x", "all": lambda r: True, "few": lambda r: r[3] > 0.99, "not x": lambda r: r[4] is not None and r[4] != "x"}
    columns = {"a": F.col("a") > 0.7, "b": F.col("b") == "x", "all": F.lit(True), "few": F.col("a") > 0.99, "not x": F.col("b") != "x"}
    frame = spark.createDataFrame([*rows, (5, "null", None, 0.9, "x")], "time long, key string, y double, a double, b string").repartition(3)
    found = {r.rule: (r.n, r["mean"], r.lift, r.p, r.q) for r in D.discover(frame, columns, "y", ["key"], 80).collect()}
    expected = brute(rows, rules, 80)
    assert set(found) == set(expected)
    for name, own in expected.items():
        assert found[name] == pytest.approx(own), name
    assert found["a"][3] < 0.05 and found["few"][2] is None and found["few"][3] == 1


def test_no_rows(spark):
    frame = spark.createDataFrame([], "time long, key string, y double, a double")
    found = D.discover(frame, {"a": F.col("a") > 0}, "y", ["key"], 5).collect()
    assert [(r.rule, r.n, r["mean"], r.lift, r.p, r.q) for r in found] == [("a", 0, None, None, 1.0, None)]


def test_predicates_treat_nulls_as_stated(spark):
    kinds = {"higher_low": "boolean", "swept": "boolean", "gap": "boolean", "mid_bias": "string", "high_bias": "string", "lead_bias": "string"}
    columns = ["room_r", "rsi", "ma_share", "range_place", "higher_low", "stop_share", "mid_bias", "high_bias", "volume_ratio", "atr_share", "displacement", "swept", "gap", "low_share", "high_share", "lead_bias", "lead_change"]
    frame = spark.createDataFrame([(None,) * len(columns)], ", ".join(f"{c} {kinds.get(c, 'double')}" for c in columns))
    rules = D.predicates()
    row = frame.select(*(rule.alias(name) for name, rule in rules.items())).first()
    assert len(rules) == 35 and {x for x in rules if row[x]} == {"room > 1R", "room > 2R", "room > 3R", "middle not bull"}
