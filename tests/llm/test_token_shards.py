import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import token_shards as T

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_slots_are_a_permutation(n):
    slots = T.feistel(np.arange(n), n, 5)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 60:
        assert (slots != T.feistel(np.arange(n), n, 6)).any() and abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.5


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(spark, docs, rows, encoding, folder, length, per_shard):
    n = T.write_shards(docs, PATH, folder, 9, length, per_shard)
    found = T.read_shards(spark, folder, length, per_shard, tokens=True).collect()
    assert sorted(r.slot for r in found) == list(range(n)) and all(r.in_place for r in found)
    texts = {}
    for r in sorted(found, key=lambda r: r.seq):
        texts.setdefault(r.doc_id, []).append(r)
    expected = {}
    for d, t in rows:
        expected.setdefault(d, []).append(encoding.encode_ordinary(t or ""))
    assert {d: sum(len(x) // length + 1 for x in v) for d, v in expected.items()} == {d: len(v) for d, v in texts.items()}
    for d, v in expected.items():
        if len(v) == 1:
            tokens = [x for r in texts[d] for x in r.tokens[: r.n_tokens]]
            assert tokens[:-1] == v[0] and tokens[-1] == 50256
            assert all(x == 50256 for r in texts[d] for x in r.tokens[r.n_tokens :])
    return {r.slot: (r.doc_id, r.seq, r.tokens_crc32) for r in found}


def test_documents(spark, sf, encoding, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    one = check(spark, docs, rows, encoding, f"{tmp_path}/a", 64, 100)
    docs.repartition(1).sortWithinPartitions("doc_id").write.option("parquet.block.size", 65536).parquet(f"{tmp_path}/split")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    two = check(spark, spark.read.parquet(f"{tmp_path}/split"), rows, encoding, f"{tmp_path}/b", 64, 100)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    three = check(spark, spark.read.parquet(f"{tmp_path}/split"), rows, encoding, f"{tmp_path}/c", 64, 100)
    assert two == three and len(one) == len(two)


def test_rows_that_are_no_table(spark, encoding, tmp_path):
    rows = [(1, None), (2, ""), (None, "no key"), (3, "  two  spaces \n"), (4, "word " * 3000), (4, "word " * 3000), (5, "\x00\n<|endoftext|>")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, slot int")
    check(spark, docs, rows, encoding, f"{tmp_path}/a", 16, 7)
    assert T.materialise(docs.limit(0), PATH, f"{tmp_path}/b").count() == 0


def test_a_filtered_table(spark, sf, encoding, tmp_path):
    """A filter leaves gaps in the files; what the driver holds stays one row for each split."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 2 = 0")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(spark, docs, rows, encoding, f"{tmp_path}/a", 64, 100)
    held = []
    whole = spark.sparkContext.broadcast
    try:
        spark.sparkContext.broadcast = lambda x: held.append(x) or whole(x)
        T.write_shards(docs, PATH, f"{tmp_path}/b", 9, 64, 100)
    finally:
        del spark.sparkContext.broadcast
    assert any(isinstance(x, tuple) and len(x[0]) <= 4 for x in held)


@pytest.mark.parametrize("plan", ["repartition", "by key", "sorted", "united", "twice read", "joined", "filtered"])
def test_plans_that_move_rows(spark, sf, encoding, tmp_path, plan):
    """_metadata goes along when rows are shuffled; the splits it names are then no runs of rows any more."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    moved = {
        "repartition": lambda: docs.repartition(7), "by key": lambda: docs.repartition(6, "doc_id").sortWithinPartitions("source"), "sorted": lambda: docs.orderBy(docs.text.desc()),
        "united": lambda: docs.union(docs), "twice read": lambda: spark.read.parquet(f"{sf}/documents.parquet", f"{sf}/documents.parquet"), "joined": lambda: docs.join(docs.select("doc_id", "lang"), ["doc_id", "lang"]),
        "filtered": lambda: docs.filter("doc_id % 3 = 1").select("text", "doc_id"),
    }[plan]()
    check(spark, moved, [(r.doc_id, r.text) for r in moved.collect()], encoding, f"{tmp_path}/a", 64, 100)
