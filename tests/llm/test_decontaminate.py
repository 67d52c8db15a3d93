import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import Row

from tidemark.llm import decontaminate as D


def make(rng, n, vocab):
    return [". ".join(" ".join(rng.choices(vocab, k=rng.randrange(4, 30))).capitalize() for _ in range(rng.randrange(1, 4))) + "." for _ in range(n)]


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    vocab = ["the", "of", "a", "in"] * 40 + [f"w{i}é" for i in range(900)]
    items = make(rng, 60, vocab) + [" ".join(rng.choices(vocab, k=200)) + ". End of it."]
    docs = make(rng, 150, vocab)
    planted = {}
    for k in range(0, 150, 10):
        j = (k // 10) % len(items)
        docs[k] = docs[k] + " " + items[j].upper().replace(".", " !") + " " + " ".join(rng.choices(vocab, k=300))
        planted[k] = j
    docs[7] = " ".join(rng.choices(vocab, k=90)) + " " + items[-1] + " " + docs[7]
    planted[7] = len(items) - 1
    return items, docs, planted


def brute(items, docs):
    """(document, item) by the docstring's rules, word by word."""
    unspaced = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}"
    split = lambda t: regex.findall(rf"(?V1)[{unspaced}]|[[\p{{L}}\p{{M}}\p{{N}}]--[{unspaced}]]+", (t or "").lower())
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    units = []
    for j, text in enumerate(items):
        w = split(text)
        units += [(j, list(x)) for x in np.array_split(np.asarray(w, object), max(1, -(-len(w) // 64)))] if w else []
    df = collections.Counter(t for _, u in units for t in set(u))
    mean = sum(len(u) for _, u in units) / max(1, len(units))
    shares = []
    for _, u in units:
        idf = {t: math.log1p((len(units) - df[t] + 0.5) / (df[t] + 0.5)) for t in u}
        own = {t: idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(u) / mean)) for t, c in collections.Counter(u).items()}
        shares.append({t: x / sum(own.values()) for t, x in own.items()})
    out = set()
    for d, text in enumerate(docs):
        w = split(text)
        passages = [set(w[k : k + 128]) for k in range(0, len(w), 64)]
        for (j, _), share in zip(units, shares, strict=True):
            if not any(sum(share.get(t, 0) for t in p) >= 0.6 - 1e-9 for p in passages):
                continue
            cut = D.answer_start(items[j])
            whole, good = split(items[j]), True
            for part in (split(items[j][:cut]), split(items[j][cut:])):
                n = min(3, len(part))
                if n:
                    have = grams(w, n) if len(part) <= 3 else grams(w, 3)
                    good &= len(grams(part, n) & have) >= 0.5 * len(grams(part, n))
            n = min(5, len(whole))
            good &= bool(grams(whole, n) & grams(w, n))
            if good:
                out.add((d, j))
    return out


def test_all_of_it_against_brute_force(spark, case):
    items, docs, _ = case
    items = [*items, "the of a", "w3é", "of w5é", "a in the of", "w1é w2é w3é w4é w5é"]
    docs = [*docs, "so W3é it is", "of, w5é.", "w5é of", " ".join(docs[:40]), "w1é w2é w3é w4é", "w1é w2é w3é w4é w5é"]
    d, b = (spark.createDataFrame(list(enumerate(x)), f"{k} long, text string") for k, x in (("doc_id", docs), ("item_id", items)))
    found = {(r.doc_id, r.item_id) for r in D.contaminated(d, b).collect()}
    assert found == brute(items, docs)
    assert {(150, len(items) - 4), (151, len(items) - 3)} <= found and (152, len(items) - 3) not in found


def test_real_tables(spark, sf):
    docs, items = (sorted((tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect())) for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    expected = brute([t for _, t in items], [t for _, t in docs])
    found = {(r.doc_id, r.item_id) for r in D.contaminated(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))).collect()}
    assert found == {(docs[a][0], items[b][0]) for a, b in expected}


def test_null_keys_and_a_very_long_document(spark, case):
    items, docs, _ = case
    long = " ".join(docs * 30) + " " + items[0]
    assert len(long.split()) > 200_000
    d = spark.createDataFrame([(None, "x " + items[3]), (None, "nothing of it"), (5, long)], "doc_id long, text string")
    b = spark.createDataFrame([(None, items[3]), (7, items[3]), (8, items[0])], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.contaminated(d, b).collect()}
    assert {(None, None), (None, 7), (5, 8)} <= found
    assert [r.text for r in D.decontaminate(d, b).collect()] == ["nothing of it"]


def test_planted_items_are_found_and_nothing_else(spark, case):
    items, docs, planted = case
    d = spark.createDataFrame([Row(doc_id=k, text=t, item_id="clash") for k, t in enumerate(docs)] + [Row(doc_id=1000, text=None, item_id="x"), Row(doc_id=1001, text="", item_id="x"), Row(doc_id=10, text=docs[10], item_id="x")])
    b = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(500, None), (501, ""), (502, "...")], "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in D.contaminated(d, b).collect()]
    assert sorted(found) == sorted([*planted.items(), (10, planted[10])])
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(k for k in [*range(150), 1000, 1001] if k not in planted)


def test_blocks_of_items_change_nothing(spark, case):
    items, docs, _ = case
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    column = pa.array(docs)
    one = [x for i in D.indexes(b) for x in i.search(column, 0.6, 0.5, 0.5)]
    many = [x for i in D.indexes(b, block_bytes=1500) for x in i.search(column, 0.6, 0.5, 0.5)]
    assert sorted((a, i, round(s, 9)) for a, i, s, *_ in one) == sorted((a, i, round(s, 9)) for a, i, s, *_ in many)


@pytest.mark.parametrize("threshold", [0.15, 0.3, 0.6])
def test_wand_finds_all_that_brute_force_finds(spark, case, threshold):
    items, docs, _ = case
    index = next(D.indexes(spark.createDataFrame(list(enumerate(items)), "item_id long, text string")))
    for text in docs[:60]:
        words, _ = D.words_of(pa.array([text]))
        terms = sorted({int(np.searchsorted(index.terms, w)) for w in words if w in index.terms})
        scores = np.zeros(len(index.items))
        for t in terms:
            a, b = index.first[t], index.first[t + 1]
            scores[index.units[a:b]] += index.shares[a:b]
        expected = {int(u) for u in np.flatnonzero(scores >= threshold)}
        assert {u for u, _ in index.wand(terms, threshold)} == expected
        hopeful = index.hopeful(np.zeros(len(terms), np.int64), np.asarray(terms, np.int64), 1, threshold)
        assert not expected or len(hopeful) == 1


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert D.contaminated(d, b.limit(0)).count() == 0 and D.contaminated(d.limit(0), b).count() == 0
    assert D.contaminated(d, b).count() == 1 and D.decontaminate(d, b.limit(0)).count() == 1


SCRIPTS = {
    "chinese": ("人类最早的文字出现在哪个地区？公元前三千多年的两河流域南部。", "这本书很有意思。", "第二章讲了很多别的事情，", "后来的人继续研究。"),
    "japanese": ("日本で一番高い山は何ですか。富士山は三千七百七十六メートルです。", "今日はとても天気がいいので、", "散歩に行きましょう。", "それから家に帰ります。"),
    "thai": ("เมืองหลวงของประเทศไทยคือเมืองอะไรและมีประชากรกี่คน", "วันนี้อากาศดีมาก", "เราไปเดินเล่นกันเถอะ", "แล้วกลับบ้าน"),
    "quoted": ("Which river is the longest one in “Europe”? The Volga, of course.", "Some text… ", "« and more »", "— the end —"),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_items_inside_longer_texts_of_any_script(spark, script):
    item, *around = SCRIPTS[script]
    texts = [around[0] * 20 + item + around[1] * 20, around[0] * 30 + around[2], item[: len(item) // 3] + around[1] * 5, item.replace("，", " , "), item.replace("“", "'").replace("”", "'")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = [item, around[2] * 9]
    found = {(r.doc_id, r.item_id) for r in D.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert found == brute(items, texts)
    assert {(0, 0), (4, 0)} <= found and not {(1, 0), (2, 0)} & found


def test_answers_of_unspaced_texts():
    text = SCRIPTS["chinese"][0]
    assert text[D.answer_start(text) :] == "公元前三千多年的两河流域南部。"
    assert D.answer_start(SCRIPTS["thai"][0]) == len(SCRIPTS["thai"][0]) * 2 // 3
    assert D.answer_start("one two three. Four five.") == 15 and D.answer_start("word") == 0
