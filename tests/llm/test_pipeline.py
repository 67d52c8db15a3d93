import random

import public_tokenizers
import pytest

import corpus_pipeline as P
from tidemark.llm import decontaminate, near_dedup, sp_sampling, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = [docs]
    for _, stage in P.STAGES:
        found.append(stage(spark, found[-1], sf).cache())
    yield found
    for df in found[1:]:
        df.unpersist()


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_take_effect_and_keep_the_columns(spark, sf, stages):
    docs, calm, single, clean, pieces = stages
    assert docs.columns == calm.columns == single.columns == clean.columns
    assert ids(docs) > ids(calm) > ids(single) > ids(clean) == ids(pieces)
    toxic = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1").collect()}
    assert ids(docs) - ids(calm) == toxic
    groups = near_dedup.near_duplicates(calm, 5, 80).collect()
    assert ids(single) == {r.doc_id for r in groups if r.kept}
    leaks = {r.doc_id for r in decontaminate.contaminated(single, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids(single) - ids(clean) == leaks


def test_run_gives_the_last_stage(spark, sf, stages):
    ran = {r.doc_id: r.pieces for r in P.run(spark, sf).collect()}
    assert ran == {r.doc_id: r.pieces for r in stages[-1].collect()}


def test_no_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_one_row_of_each_group_by_row(spark, sf):
    copied, other, third = ("the quick brown fox jumps over the lazy dog by the river", "one clean text that nobody else has written anywhere so far", "these words come twice under no name at all in this table")
    rows = [(7, copied), (7, copied), (3, copied), (7, other), (None, third), (None, third), (9, copied), (None, copied), (5, ""), (5, None), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", "x", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = sorted(((r.doc_id, r.text) for r in P.one_of_each_group(spark, docs, sf).collect()), key=str)
    assert found == sorted([(3, copied), (7, other), (None, third), (5, ""), (5, None), (None, "")], key=str)


def test_odd_rows_through_all_stages(spark, sf, tmp_path):
    """Null, repeated, empty, very long and tied rows, a clashing column: what stays is known beforehand."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    item, long, twin, other = text(30), text(60_000), text(80), text(70)
    near = twin.replace(twin.split()[40], "changed", 1)
    rows = [(1, twin), (1, twin), (2, near), (None, near), (None, other), (None, other), (3, ""), (3, None), (4, long), (5, long + " tail"), (6, item), (7, text(50) + " " + item + " " + text(50)), (8, "   "), (9, "▁ odd  spaces \x00"), (9, other + " " + text(70))]
    kept = [(1, twin), (None, other), (3, ""), (3, ""), (4, long), (8, "   "), (9, "▁ odd  spaces \x00"), rows[-1]]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, 1.5, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, pieces string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = P.run(spark, str(tmp_path))
    back = sp_sampling.decode(found, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(kept, key=str)
    assert all(r.n_pieces == len(r.pieces) for r in found.collect())
