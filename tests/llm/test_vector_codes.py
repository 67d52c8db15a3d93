import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row

from tidemark.llm import vector_codes
from tidemark.llm.vector_codes import Tree, compress

NAMES = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def brute(rows, factor=1024, parts=4, entries=256, rounds=4):
    """(key, label, vector) rows: Lloyd's rounds over whole distance tables."""
    kept = sorted((r for r in rows if r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = -(-max((len(r[2]) for r in kept), default=0) // parts)
    whole = np.zeros((len(kept), parts * width), np.int64)
    for k, r in enumerate(kept):
        whole[k, : len(r[2])] = np.floor(np.asarray(r[2], np.float64) * factor)
    codes, errors, books = [], np.zeros(len(kept), np.int64), []
    for points in np.split(whole, parts, axis=1):
        book = points[:entries].copy()
        for k in range(rounds + 1):
            far = ((points[:, None, :] - book[None]) ** 2).sum(axis=2) if len(points) else np.zeros((0, 1), np.int64)
            entry = far.argmin(axis=1)
            for z in range(len(book) if k < rounds else 0):
                if (entry == z).any():
                    book[z] = points[entry == z].sum(axis=0) // (entry == z).sum()
        codes.append(entry)
        errors += far.min(axis=1)
        books.append(book)
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
    by_label = {}
    for r, e in zip(kept, errors.tolist(), strict=True):
        by_label[r[1]] = by_label.get(r[1], 0) + e
    return [(r[0], "".join(f"{c[k]:02x}" for c in codes), e, by_label[r[1]], digest) for k, (r, e) in enumerate(zip(kept, errors.tolist(), strict=True))]


def told(df, names=NAMES):
    return sorted((tuple(r[x] for x in names) for r in df.collect()), key=repr)


def test_table_and_sql(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = told(compress(vectors))
    assert found == sorted(brute([(r.vec_id, r.label, r.embedding) for r in vectors.collect()]), key=repr)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    assert sorted(db.sql(vector_codes.ORACLE).fetchall(), key=repr) == found


def test_odd_rows(spark):
    """Nulls, non-finite components, repeated keys and rows, one point a third of all rows, clashing names."""
    draw = np.random.default_rng(5)
    rows = [(int(k), int(draw.integers(3)), draw.integers(-3, 3, 8).astype(float).tolist()) for k in draw.permutation(900)]
    rows += [(2000 + k, None, [1.0] * 8) for k in range(500)]
    rows += [(5, 1, [0.5] * 8), (5, 1, [0.5] * 8), (None, 7, [0.25] * 8), (6, 2, None), (7, 2, [None] + [1.0] * 7), (8, 2, [float("nan")] * 8), (9, 2, [float("inf")] + [0.0] * 7)]
    made = spark.createDataFrame([Row(vec_id=a, label=b, embedding=c, code="clash", n=1, key="clash") for a, b, c in rows]).repartition(5)
    for options in ({}, {"factor": 1, "entries": 16, "rounds": 2}):
        assert told(compress(made, **options)) == sorted(brute(rows, **options), key=repr)


def test_lengths(spark):
    rows = [(k, 0, [float(k % 7)] * (k % 6)) for k in range(40)]
    made = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert told(compress(made)) == sorted(brute(rows), key=repr)
    bare = spark.createDataFrame([(1, 0, []), (2, 0, [])], "vec_id long, label int, embedding array<float>")
    assert [r[1:4] for r in told(compress(bare))] == [("00000000", 0, 0)] * 2


def test_empty(spark):
    found = compress(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"))
    assert found.columns == NAMES and found.count() == 0


def test_too_large(spark):
    with pytest.raises(ValueError):
        compress(spark.createDataFrame([(1, 0, [1e30] * 8)], "vec_id long, label int, embedding array<double>"))


@pytest.mark.parametrize("spread", [1, 4, 60, 4000])
def test_descent_is_exact_and_prunes(spread):
    draw = np.random.default_rng(spread)
    centres = draw.integers(-4000, 4000, (40, 3))
    points = (centres[draw.integers(40, size=3000)] + draw.integers(-spread, spread + 1, (3000, 3))).astype(float)
    book = points[:50].copy()
    tree = Tree.build(points)
    tree = Tree.unpack(tree.pack(), len(points), 3)
    far = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    entry, distance = tree.assign(book)
    assert (entry == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
    total, count = tree.sums(book)
    assert (count == np.bincount(entry, minlength=50)).all() and (total[entry[0]] == points[entry == entry[0]].sum(axis=0)).all()
    whole, leaves = tree.descend(book)
    left = sum((hi - lo) * len(x) for lo, hi, x in leaves)
    assert left < 0.6 * points.shape[0] * len(book)  # most entries never meet a point
    assert spread > 4 or sum(len(x[1]) for x in whole) > 0


