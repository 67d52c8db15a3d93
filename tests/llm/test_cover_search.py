import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.llm import cover_search
from tidemark.llm.cover_search import Best, Block, CoverTree, search, top_k

NAMES = ["query_id", "rank", "vec_id", "score"]
def asks():
    return F.col("vec_id") % 50 == 0


def brute(rows, k=5, step=50, factor=256):
    kept = [(i, [int(np.floor(x * factor)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(kept):
        if i is not None and i % step == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j is None, j or 0) for b, (j, w) in enumerate(kept) if b != a)
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def told(df):
    assert df.columns == NAMES and df.schema["rank"].dataType.simpleString() == "int"
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_table_and_sql(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = told(top_k(vectors, asks()))
    assert found == brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    assert sorted(db.sql(cover_search.ORACLE).fetchall(), key=repr) == found


@pytest.mark.parametrize("rows_of_block", [4096, 90])
def test_odd_rows(spark, monkeypatch, rows_of_block):
    """Nulls, non-finite components, repeated keys and rows, a third of the rows equal, clashing names, several passes."""
    monkeypatch.setattr(cover_search, "ROWS", rows_of_block)
    monkeypatch.setattr(cover_search, "PASS", 3000)
    draw = np.random.default_rng(5)
    rows = [(int(k), draw.integers(-3, 3, 8).astype(float).tolist()) for k in draw.permutation(900)]
    rows += [(2000 + k, [1.0] * 8) for k in range(500)]
    rows += [(50, [2.0] * 8), (50, [2.0] * 8), (None, [3.0] * 8), (None, [2.0] * 8), (6, None), (100, [None] + [1.0] * 7), (150, [float("nan")] * 8), (200, [float("-inf")] + [0.0] * 7), (-50, [-1.0] * 8)]
    made = spark.createDataFrame([Row(vec_id=a, embedding=b, row="clash", rank=1, key="clash") for a, b in rows]).repartition(5)
    assert told(top_k(made, asks())) == brute(rows)


def test_lengths_and_few_rows(spark):
    rows = [(50 * k, [float(k % 7)] * (k % 4)) for k in range(4)]
    assert told(top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), asks())) == brute(rows)
    bare = [(0, []), (1, [])]
    assert told(top_k(spark.createDataFrame(bare, "vec_id long, embedding array<float>"), asks())) == [(0, 1, 1, 0)]
    assert told(top_k(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>"), asks())) == []


def test_empty(spark):
    assert told(top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), asks())) == []


@pytest.mark.parametrize("spread", [2, 40])
def test_cover_tree_prunes(spread, monkeypatch):
    monkeypatch.setattr(cover_search, "LEAF", 8)
    monkeypatch.setattr(cover_search, "THIN", 2)
    draw = np.random.default_rng(spread)
    centres = draw.integers(-250, 250, (60, 6))
    points = (centres[draw.integers(60, size=4000)] + draw.integers(-spread, spread + 1, (4000, 6))).astype(float)
    tree, order = CoverTree.build(points)
    for node in tree.nodes:
        own = tree.points[node["lo"] : node["hi"]]
        assert np.sqrt(((own - tree.points[node["centre"]]) ** 2).sum(axis=1)).max() <= node["radius"] + 1e-9
        below = tree.nodes[node["child"] : node["last"]]
        if len(below):
            assert below["lo"][0] == node["lo"] and below["hi"][-1] == node["hi"] and (below["lo"][1:] == below["hi"][:-1]).all()
            apart = np.sqrt(((tree.points[below["centre"]][:, None] - tree.points[below["centre"]][None]) ** 2).sum(axis=2))
            assert apart[~np.eye(len(below), dtype=bool)].min() >= node["radius"] / 2 - 1e-6
    queries, at = CoverTree.build(points[:300])
    best = Best(300, 5)
    compared = search(queries, np.full(300, -9), Block(tree, order, np.zeros(4000, bool), 0), best)
    scores = points[:300][at] @ points.T
    assert (best.score == -np.sort(-scores, axis=1)[:, :5]).all()
    assert compared < 0.5 * 300 * 4000
