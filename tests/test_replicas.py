"""Resampling tests with all replicas, against the same digests in Python."""

import hashlib
import math
import random
from statistics import mean

import pytest

from tidemark.operators import inference as R
from tidemark.plans import registry
from tidemark.plans.study_queries import date_means


def digest(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def ranks(xs):
    return [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]


def spearman(xs, ys):
    a, b = ranks(xs), ranks(ys)
    ma, mb = mean(a), mean(b)
    return sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))


def test_panels_paired_across_dates(spark):
    rng = random.Random(5)
    rows = [(d, f"a{n}", float(rng.randrange(6)) + n / 3, rng.random() + n / 20) for d in range(7) for n in range(6) if (d, n) != (2, 3)]
    by = {d: {a: (t, f) for e, a, t, f in rows if e == d} for d in range(7)}

    def ic(order):
        return mean(spearman(*zip(*((by[d][a][0], by[o][a][1]) for a in by[d] if a in by[o]), strict=True)) for d, o in enumerate(order))

    drawn = [ic(sorted(range(7), key=lambda d: digest("q", k, d))) for k in range(1, 61)]
    found = R.permuted_panels(spark.createDataFrame(rows, "date long, asset string, trail double, fwd double"), 60).collect()[0]
    assert found.ic == pytest.approx(ic(range(7)))
    assert found.p == pytest.approx((sum(r >= found.ic - 1e-12 for r in drawn) + 1) / 61)


def test_all_replicas_are_drawn(spark, sf):
    rows = [(str(r.date), r.m) for r in date_means(spark, sf).orderBy("date").collect()]
    m = mean(x for _, x in rows)
    flip = registry.queries()["i10_sign_flip"](spark, sf).collect()[0]
    flips = [mean(x if digest("s", k, d)[0] < "8" else -x for d, x in rows) for k in range(1, 5001)]
    assert flip.p == pytest.approx((sum(r >= m for r in flips) + 1) / 5001, abs=2e-4)
    found = registry.queries()["i4_bootstrap"](spark, sf).collect()[0]
    means = sorted(mean(rows[int(digest("b", k, at)[:8], 16) % len(rows)][1] for at in range(len(rows))) for k in range(1, 1001))
    assert (found.lo, found.hi) == (pytest.approx(means[25], abs=2e-6), pytest.approx(means[975], abs=2e-6))
    p = registry.queries()["i2_permutation"](spark, sf).collect()[0].p * 1001
    assert p == pytest.approx(round(p)) and 1 <= round(p) <= 1001


def test_vectors_moved_by_place(spark):
    rng = random.Random(8)
    rows = [(d, f"a{n}", rng.random(), rng.random()) for d in range(6) for n in range(6) if (d, n) not in ((2, 3), (4, 0))]
    by = {d: [(t, f) for e, _, t, f in sorted(rows) if e == d] for d in range(6)}

    def ic(order):
        return mean(spearman(*zip(*((x[0], y[1]) for x, y in zip(by[d], by[o], strict=False)), strict=True)) for d, o in enumerate(order))

    drawn = [ic(sorted(range(6), key=lambda d: digest("v", k, d))) for k in range(1, 41)]
    found = R.permuted_vectors(spark.createDataFrame(rows, "date long, asset string, trail double, fwd double"), 40).collect()[0]
    assert found.ic == pytest.approx(ic(range(6)))
    assert found.p == pytest.approx((sum(abs(r) >= abs(found.ic) - 1e-12 for r in drawn) + 1) / 41)


def test_block_permuted_ic(spark):
    rng = random.Random(9)
    rows = [("s", t, float(rng.randrange(5)), float(rng.randrange(4))) for t in range(23)]
    xs, ys = ranks([r[2] for r in rows]), ranks([r[3] for r in rows])

    def corr(a, b):
        return spearman(a, b)  # ranks of ranks are the ranks

    blocks = [ys[k : k + 4] for k in range(0, 23, 4)]
    drawn = [corr(xs, [y for b in sorted(range(6), key=lambda b: digest("k", k, "s", b)) for y in blocks[b]]) for k in range(1, 61)]
    found = R.block_permuted_ic(spark.createDataFrame(rows, "symbol string, time long, x double, y double"), 4, 60).collect()[0]
    assert found.n == 23 and found.ic == pytest.approx(corr(xs, ys))
    assert found.p == pytest.approx((sum(abs(r) >= abs(found.ic) - 1e-12 for r in drawn) + 1) / 61)
