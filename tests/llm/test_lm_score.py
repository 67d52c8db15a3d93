import collections
import math
import random
import re

import duckdb
import pytest

from tidemark.llm import lm_score as L
from tidemark.llm import registry


def brute(rows, corpus=None):
    words, counted = ([re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower()) for _, t in x] for x in (rows, rows if corpus is None else corpus))
    uni, bi = collections.Counter(w for x in counted for w in x), collections.Counter(p for x in counted for p in zip(["<s>", *x], x))
    context = collections.Counter()
    for (v, _), c in bi.items():
        context[v] += c
    n = sum(map(len, counted))

    def share(v, w):
        if bi[v, w]:
            return bi[v, w] / context[v]
        return 0.4 * (uni[w] or 0.4) / n

    out = []
    for (d, _), x in zip(rows, words, strict=True):
        out.append((d, len(x), sum(math.log10(share(v, w)) for v, w in zip(["<s>", *x], x)) / len(x) if x and n else None))
    return sorted(out, key=lambda r: (str(r[:2]), r[2] or 0))


def agree(found, expected):
    found = sorted(((r.doc_id, r.n_words, r.score) for r in found), key=lambda r: (str(r[:2]), r[2] or 0))
    assert [r[:2] for r in found] == [r[:2] for r in expected]
    for a, b in zip(found, expected, strict=True):
        assert a[2] == b[2] or a[2] == pytest.approx(b[2], abs=2e-6)


def some_rows(seed):
    rng = random.Random(seed)
    vocab = ["the"] * 60 + ["a", "b"] * 20 + [f"w{i}É" for i in range(200)]
    return [(k, " ".join(rng.choices(vocab, k=rng.randrange(0, 60)))) for k in range(120)] + [(1, None), (None, "the a"), (None, "the a"), (5, " . "), (6, "x " * 20_000)] + [(k, "of the") for k in range(300, 360)]


@pytest.mark.parametrize("buckets", [1, 7, 40])
def test_against_brute_force(spark, buckets):
    rows = some_rows(buckets)
    docs = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, bucket string")
    agree(L.scores(docs, buckets=buckets).collect(), brute(rows))


@pytest.mark.parametrize("buckets", [1, 40])
def test_another_corpus_makes_bigrams_back_off(spark, buckets):
    rows, corpus = some_rows(1) + [(900, "nobody wrote this of the the a")], some_rows(2)[:100] + [(k, "in the") for k in range(50)]
    docs, counted = (spark.createDataFrame([(d, t) for d, t in x], "doc_id long, text string") for x in (rows, corpus))
    agree(L.scores(docs, counted, buckets).collect(), brute(rows, corpus))
    agree(L.scores(docs, counted.limit(0), buckets).collect(), brute(rows, []))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.scores(docs).count() == 0
    assert L.scores(spark.createDataFrame([(1, "")], docs.schema)).collect()[0].score is None


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = sorted(con.execute(L.ORACLE).fetchall())
    assert sorted(tuple(r) for r in registry.op8_lm_score(spark, sf).select("doc_id", "n_words", "score").collect()) == expected
