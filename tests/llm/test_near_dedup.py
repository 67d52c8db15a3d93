import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tidemark.llm import near_dedup
from tidemark.llm.common import Workspace, shingle_sets
from tidemark.llm.near_dedup import near_duplicates


def shingles(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def run(spark, rows, width, percent):
    found = near_duplicates(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, cid string, n int"), width, percent).collect()
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in found)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_groups_of_edited_copies(spark, width, percent):
    rng = random.Random(width)
    vocab = [f"w{i}" for i in range(4000)]
    common = " ".join(rng.choices(vocab, k=60))
    rows = []
    for group in range(12):
        base = rng.choices(vocab, k=rng.choice([4, 9, 30, 150, 400]))
        for _ in range(rng.choice([1, 2, 5, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 12])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows) + 1000, " ".join(words)))
    rows += [(len(rows) + 5000 + i, " ".join(rng.choices(vocab, k=rng.choice([8, 20, 100]))) + " " + common) for i in range(40)]
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, None), (5, "Two Words"), (6, "two words"), (6, "two words"), (7, rows[0][1]), (7, "other text here now"), (None, rows[5][1]), (None, "nobody else says this"), (8, " ".join(rng.choices(vocab, k=30000)))]
    rng.shuffle(rows)
    assert run(spark, rows, width, percent) == brute(rows, width, percent)


def test_empty(spark):
    assert run(spark, [], 3, 85) == []
    assert run(spark, [(1, "a b c d"), (2, None)], 3, 85) == [(1, 2, 1), (2, 0, 2)]


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = near_duplicates(docs, 3, 85)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str) == brute(rows, 3, 85)


def test_many_null_and_repeated_keys(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(5000)]
    rows = [(None, " ".join(rng.choices(vocab, k=12))) for _ in range(5000)]
    rows += [(None, rows[k % 40][1]) for k in range(5000)] + [(1, rows[50 + k % 7][1]) for k in range(300)]
    found = run(spark, rows, 3, 85)
    assert len(found) == 10_300
    least = {t: None for _, t in rows} | {t: d for d, t in rows if d is not None}
    assert found == sorted(((d, 10, least[t]) for d, t in rows), key=str)


def test_pages_of_one_template_fall_apart(spark, monkeypatch):
    """2000 texts share 70 words of 100: candidates of each other, but nothing is linked; blocks of texts stay few."""
    sent = []
    links = near_dedup._block_links

    def counted(members, *rest):
        sent.append(members.count())
        return links(members, *rest)

    monkeypatch.setattr(near_dedup, "_block_links", counted)
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(5000)]
    common = rng.choices(vocab, k=70)
    rows = [(k, " ".join(common + rng.choices(vocab, k=30))) for k in range(2000)]
    rows += [(5000 + k, rows[k][1] + " and more") for k in range(100)]
    found = run(spark, rows, 3, 85)
    assert found == sorted(((d, n, d - 5000 if d >= 5000 else d) for d, n, _ in found), key=str)
    assert sent[0] <= 400


@pytest.mark.parametrize("width", [2, 3, 5, 7])
def test_sets_of_repeated_words(width):
    """Every order of few words is a shingle of its own."""
    rng = random.Random(width)
    texts = [" ".join(rng.choices("abc", k=200)) for _ in range(20)]
    assert [len(x) for x in shingle_sets(pa.array(texts), width)] == [len(shingles(t, width)) for t in texts]


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    """Spark guesses sizes from compressed files, so a table far over its threshold would go through the driver."""
    plans, put = [], Workspace.put

    def spied(self, df, name, *by):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return put(self, df, name, *by)

    monkeypatch.setattr(Workspace, "put", spied)
    texts = [" ".join(f"w{k}-{j}" for j in range(80)) for k in range(20)]
    rows = [(k, x, "en", "web", len(x)) for k, x in enumerate(texts + [x + " more" for x in texts])]
    stage = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    plans.append(("stage", stage._jdf.queryExecution().sparkPlan().toString()))
    assert sorted(r.doc_id for r in stage.collect()) == list(range(20))
    assert sum("Join" in p for _, p in plans) > 5
    assert [name for name, p in plans if "Broadcast" in p] == []


def test_blocks_go_out_in_waves(spark, monkeypatch):
    """Copies of one text with many edits: similarities on both sides of the threshold, more of them than a wave takes."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 12)
    monkeypatch.setattr(near_dedup, "LEAST_WAVE", 90_000)
    monkeypatch.setattr(near_dedup, "WAVE_PART", 10**9)
    names, put = [], Workspace.put
    monkeypatch.setattr(Workspace, "put", lambda self, df, name, *by: names.append(name) or put(self, df, name, *by))
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(3):
        base = [f"b{k}-{i}" for i in range(150)]
        for _ in range(60):
            words = list(base)
            for _ in range(rng.randrange(2, 9)):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([1, 1, 2])] = rng.choice([[], [rng.choice(vocab)]])
            rows.append((len(rows), " ".join(words)))
    found = run(spark, rows, 3, 85)
    assert found == brute(rows, 3, 85)
    assert 3 < len({c for _, _, c in found}) < len(rows) - 20
    assert sum(x.startswith("more-") for x in names) > 1


def test_shuffle_files_go_with_each_table(spark, monkeypatch):
    """Else those of all steps stay until the driver happens to collect its garbage."""
    folders = [Path(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: sum(1 for x in folders for _ in x.rglob("shuffle_*"))
    left, put = {}, Workspace.put

    def spied(self, df, name, *by):
        before = files()
        out = put(self, df, name, *by)
        end = time.time() + (0 if any(left.values()) else 10)  # they are removed in the background
        while files() > before and time.time() < end:
            time.sleep(0.1)
        left[name] = max(0, files() - before)
        return out

    monkeypatch.setattr(Workspace, "put", spied)
    texts = [" ".join(f"w{k}-{j}" for j in range(80)) for k in range(20)]
    rows = [(k, x, "en", "web", len(x)) for k, x in enumerate(texts + [x + " more" for x in texts])]
    stage = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(r.doc_id for r in stage.collect()) == list(range(20))
    assert {"lists", "texts", "links", "result"} <= set(left)
    assert not any(left.values())


def test_overlaps():
    rng = np.random.default_rng(4)
    left, right = ([np.unique(rng.integers(0, 30_000, n)) for n in sizes] for sizes in ((0, 5, 9000, 20_000), (7000, 0, 3)))
    assert near_dedup.overlaps(left, right).tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]
    assert near_dedup.overlaps(left, left).diagonal().tolist() == [len(x) for x in left]
    assert near_dedup.overlaps(left, []).shape == (4, 0)
