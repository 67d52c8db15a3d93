"""The classifier, its folds and its refits against plain numpy."""

import hashlib

import numpy as np
import pytest

from tidemark.operators import learning as M
from tidemark.plans import registry
from tidemark.plans.study_queries import FEATURES, labelled


def newton(x, y, penalty):
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    ridge, beta = np.append(np.full(x.shape[1] - 1, penalty), 0.0), np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta - np.linalg.solve((x.T * (w * p * (1 - p))) @ x + np.diag(ridge), x.T @ (w * (p - y)) + ridge * beta)
    return beta


def area(score, y):
    wins = [(a > b) + (a == b) / 2 for a in score[y == 1] for b in score[y == 0]]
    return float(np.mean(wins))


def scaled(rows):
    x = np.asarray([[getattr(r, c) or 0.0 for c in FEATURES] for r in rows])
    train = np.asarray([r.train for r in rows])
    sd = x[train].std(axis=0)
    return (x - x[train].mean(axis=0)) / np.where(sd == 0, 1, sd), np.asarray([r.y for r in rows]), train


def test_classifier(spark, sf):
    x, y, train = scaled(labelled(spark, sf).collect())
    beta = newton(x[train], y[train], 0.01)
    score = x @ beta[:-1] + beta[-1]
    found = {r.train: r.auc for r in registry.queries()["m4_classifier"](spark, sf).collect()}
    assert found == {t: pytest.approx(area(score[train == t], y[train == t]), abs=1e-4) for t in (True, False)}


def folds_of(rows, folds):
    """Round-robin in each class, in the order of time and symbol."""
    out, met = {}, {0: 1, 1: 0}
    for r in sorted(rows, key=lambda r: (r.time, r.symbol)):
        out[r.symbol, r.time] = met[r.y] % folds
        met[r.y] += 1
    return np.asarray([out[r.symbol, r.time] for r in rows])


def chosen(x, y, fold, penalties):
    ranked = []
    for c in penalties:
        areas, losses = [], []
        for f in range(3):
            beta = newton(x[fold != f], y[fold != f], c)
            z = x[fold == f] @ beta[:-1] + beta[-1]
            areas.append(area(z, y[fold == f]))
            losses.append(np.mean(np.logaddexp(0, z) - y[fold == f] * z))
        ranked.append((-np.mean(areas), np.mean(losses), c))
    return sorted(ranked)


def test_penalty_choice(spark, sf):
    rows = [r for r in labelled(spark, sf).collect() if r.train]
    x, y, _ = scaled(rows)
    expected = chosen(x, y, folds_of(rows, 3), [0.0, 0.01, 0.1, 1.0])
    found = sorted(registry.queries()["m6_penalty_choice"](spark, sf).collect(), key=lambda r: r.place)
    assert [r.place for r in found] == [1, 2, 3, 4]
    assert {r.penalty: (r.mean_auc, r.mean_loss) for r in found} == {c: (pytest.approx(-a, abs=2e-6), pytest.approx(b, abs=2e-6)) for a, b, c in expected}
    assert found[0].mean_auc == max(r.mean_auc for r in found)


def test_refits_under_permuted_labels(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((160, 2))
    y = (x[:, 0] + rng.standard_normal(160) > 0).astype(int)
    train = np.arange(160) < 110
    rows = spark.createDataFrame([(f"{k:04d}", k // 7, float(a), float(b), int(c), bool(t)) for k, ((a, b), c, t) in enumerate(zip(x, y, train, strict=True))], "key string, chunk long, a double, b double, y int, train boolean")
    found = M.sealed_score(rows, ["a", "b"], "key", "y", "train", "chunk", [0.01, 1.0], k=12).collect()[0]
    z = (x - x[train].mean(axis=0)) / x[train].std(axis=0)

    def held_area(labels):
        fold, met = np.zeros(110, int), {0: 1, 1: 0}
        for k in range(110):  # folds are those of the true labels
            fold[k] = met[y[k]] % 3
            met[y[k]] += 1
        c = chosen(z[train], labels, fold, [0.01, 1.0])[0][2]
        beta = newton(z[train], labels, c)
        return c, area(z[~train] @ beta[:-1] + beta[-1], y[~train]), area(z[train] @ beta[:-1] + beta[-1], labels)

    c, own, seen = held_area(y[train])
    assert (found.penalty, found.valid) == (c, 12) and found.holdout_auc == pytest.approx(own) and found.train_auc == pytest.approx(seen)
    null = []
    for replica in range(1, 13):
        order = sorted(range(110), key=lambda k: hashlib.md5(f"l|{replica}|{k:04d}".encode()).hexdigest())
        labels = np.zeros(110, int)
        labels[order[: y[train].sum()]] = 1
        null.append(held_area(labels)[1])
    assert found.exceedances == sum(a >= own - 1e-12 for a in null) and found.p == pytest.approx((found.exceedances + 1) / 13)
