import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import toxicity as T


def test_gradient_agrees_with_differences():
    words = T.Words(pa.array(["bad x good words in here", "a b", ""]), np.zeros(0, np.uint64))
    p = {k: v.astype(np.float64) for k, v in T.initial(0, 1).items()}
    at, owner = words.windows()

    def loss(q):
        _, gates = T.inputs(q, words)
        return T.forward(q, gates, at)[0].sum()

    x, gates = T.inputs(p, words)
    logit, made = T.forward(p, gates, at, keep=True)
    g = T.gradient(p, words, x, gates, at, made, np.ones(len(logit), np.float32))
    for name in ("fwd", "bwd", "in", "att", "att_v", "out", "gram"):
        where = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        step = np.zeros_like(p[name])
        step[where] = 1e-2
        slope = (loss(p | {name: p[name] + step}) - loss(p | {name: p[name] - step})) / 2e-2
        assert slope == pytest.approx(g[name][where], rel=0.05, abs=1e-3)


def test_windows_cover_every_word():
    text = " ".join(f"w{i}" for i in range(101))
    words = T.Words(pa.array([text, None, "one"]), np.zeros(0, np.uint64))
    at, owner = words.windows()
    for k, n in ((0, 101), (2, 1)):
        assert len(set(at[owner == k].ravel()) - {len(words.hashes)}) == n
    assert (owner == 1).sum() == 1 and set(at[owner == 1].ravel()) == {len(words.hashes)}


def corpus(n, seed=3):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(n):
        words = list(rng.choice(vocab, rng.integers(5, 120)))
        if k % 4 == 0:
            for _ in range(3):
                words.insert(rng.integers(len(words)), rng.choice(["vile", "foul", "nasty"]))
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    return rows


def test_held_out_rows_are_told_apart(spark):
    rows = corpus(500)
    docs = spark.createDataFrame([(k, t, "s", 0.0) for k, t, _ in rows] + [(None, None, "s", 0.0), (9999, "", "s", 0.0), (3, rows[3][1], "s", 0.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (4, None), (77777, 1)], "doc_id long, toxic int")
    found = T.toxicity(docs, labels).collect()
    assert len(found) == 503 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    truth = {k: y for k, _, y in rows}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    unseen = [r for r in found if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in unseen]) > 0.95
    assert len({r.score for r in found if r.doc_id == 3}) == 1


def test_no_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [(r.score, r.predicted) for r in T.toxicity(docs, none).collect()] == [(0.0, 0)]
    assert T.toxicity(docs.limit(0), none).count() == 0


def plain_score(p, text):
    """One window after the other, word by word, as the docstring says."""
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h = T.HIDDEN
    known = {int(x): k + 1 for k, x in enumerate(p["vocabulary"])}
    worst = 0.0
    for at in range(0, max(1, len(words) - (T.WINDOW - T.STRIDE)), T.STRIDE):
        xs = []
        for word in words[at : at + T.WINDOW]:
            one = T.Words(pa.array([word]), np.zeros(0, np.uint64))
            mean = p["gram"][one.grams].mean(axis=0)
            xs.append(np.concatenate([p["word"][known.get(int(one.hashes[0]), 0)], mean]) @ p["in"] + p["in_b"])

        def read(xs, u):
            s, states = np.zeros(h), []
            for g in xs:
                a = s @ u
                z, r = sigmoid(g[:h] + a[:h]), sigmoid(g[h : 2 * h] + a[h : 2 * h])
                n = np.tanh(g[2 * h :] + r * a[2 * h :])
                s = n + z * (s - n)
                states.append(s)
            return states

        ahead, back = read([x[: 3 * h] for x in xs], p["fwd"]), read([x[3 * h :] for x in xs[::-1]], p["bwd"])[::-1]
        states = np.asarray([np.concatenate(x) for x in zip(ahead, back, strict=True)]) if xs else np.zeros((1, 2 * h))
        weight = np.exp(np.tanh(states @ p["att"] + p["att_b"]) @ p["att_v"])
        pooled = (weight[:, None] * states).sum(axis=0) / weight.sum()
        worst = max(worst, sigmoid(pooled @ p["out"] + p["out_b"][0]))
    return worst


def test_scores_agree_with_a_plain_scorer():
    rows = corpus(120)
    p = T.fit([t for _, t, _ in rows], [y for _, _, y in rows], epochs=2)
    texts = [rows[0][1], rows[1][1], "vile", "", "nobody wrote these WORDS, Ünd das!", " ".join(t for _, t, _ in rows[:40])]
    assert T.score(p, pa.array(texts)) == pytest.approx([plain_score(p, t) for t in texts], abs=1e-4)


def test_a_very_long_text():
    rows = corpus(500)
    p = T.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    clean = " ".join(t for _, t, y in rows if not y)
    long = (clean + " ") * 10
    assert len(long.split()) > 200_000
    a, b = T.score(p, pa.array([long, long + " vile foul nasty vile"]))
    assert b > a
