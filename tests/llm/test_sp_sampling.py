import collections
import time

import numpy as np
import pytest
import public_tokenizers

from tidemark.llm import sp_sampling as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "Hello  world ", "▁literal ▁▁", "\n\t\x00", "naïve 北京 🙂 \U0010ffff ▁", "word " * 50, "x" * 5000, "\U0001f642" * 300, "a\nb\n\nc"]


@pytest.fixture(scope="module")
def table():
    return S.Lattices(PATH, 0.5)


def test_decoding_gives_every_text_back(table):
    pieces, first = table.encode(TEXTS, np.arange(len(TEXTS), dtype=np.uint64))
    assert [table.decode(pieces[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)] == TEXTS


@pytest.mark.parametrize("text", ["hello", "    if", "naïve▁"])
def test_paths_are_drawn_by_weight(table, text):
    """Against all segmentations of a segment, listed by brute force."""
    word = " " + text

    def paths(at):
        if at == len(word):
            yield (), 1.0
        for end in range(at + 1, len(word) + 1):
            part = word[at:end]
            found = table.piece.get(part.replace(" ", S.MARK)) if S.MARK not in part else None
            options = [((found[0],), found[1])] if found else []
            if len(part) == 1 and not found:
                options = [(tuple(table.byte[list(part.encode())].tolist()), table.spelled)]
            for ids, w in options:
                for rest, v in paths(end):
                    yield (*ids, *rest), w * v

    weights = dict(paths(0))
    total = sum(weights.values())
    n = 40_000
    pieces, first = table.encode([text] * n, np.arange(n, dtype=np.uint64) * np.uint64(977))
    seen = collections.Counter(tuple(pieces[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True))
    assert set(seen) <= set(weights)
    for path, w in weights.items():
        expected = n * w / total
        assert abs(seen[path] - expected) < 6 * expected**0.5 + 3


def test_runs_of_spaces_have_pieces(table):
    runs = {k for k in range(2, 17) if S.MARK * k in table.piece}
    assert len(runs) == 14
    pieces, _ = table.encode(["x" + " " * 16 + "y"] * 500, np.arange(500, dtype=np.uint64))
    assert {table.piece[S.MARK * k][0] for k in runs} & set(pieces.tolist())


def test_rows_do_not_depend_on_their_batch(table):
    """Alone, all together, behind many others and with blocks of another size: the same to the bit."""
    rng = np.random.default_rng(3)
    texts = [*TEXTS, *("".join(chr(c) for c in rng.choice([97, 98, 0x4E00, 0x4E8C, 0x1F642, 0xE9], n)) for n in (300, 3000, 3000, 3001))]
    keys = np.arange(len(texts), dtype=np.uint64)
    together, first = table.encode(texts, keys)
    fresh = S.Lattices(PATH, 0.5)
    fresh.encode([" ".join(map(str, rng.integers(0, 1 << 40, 20_000)))], keys[:1])
    for k in reversed(range(len(texts))):
        alone, _ = fresh.encode([texts[k]], keys[k : k + 1])
        assert alone.tolist() == together[first[k] : first[k + 1]].tolist()
    others = [f"{a} {b}" for a, b in zip(map(str, rng.integers(0, 1 << 20, 3000)), "abcde" * 600, strict=True)]
    behind, edge = table.encode(others + texts, np.concatenate([np.full(3000, 9, np.uint64), keys]))
    assert behind[edge[3000] :].tolist() == together.tolist()


def test_long_texts_without_spaces(table):
    text = "".join(map(chr, np.random.default_rng(1).integers(0x4E00, 0x5E00, 200_000)))
    began = time.perf_counter()
    pieces, _ = table.encode([text], np.ones(1, np.uint64))
    assert time.perf_counter() - began < 10
    assert table.decode(pieces.tolist()) == text


def test_spark(spark, sf):
    rows = [(k, t, "c") for k, t in enumerate(TEXTS)] + [(None, "null key", "c"), (99, None, "c"), (7, TEXTS[7], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    encoded = S.encode(docs, PATH)
    back = sorted((r.doc_id or -1, r.text) for r in S.decode(encoded, PATH).collect())
    assert back == sorted((k if k is not None and k != 0 else (-1 if k is None else -1), t or "") for k, t, _ in rows)
    trip = S.round_trip(docs.repartition(3), PATH).collect()
    assert len(trip) == len(rows) and all(r.lossless for r in trip)
    assert len({r.pieces_sha256 for r in trip if r.doc_id == 7}) == 1
    assert S.round_trip(docs.limit(0), PATH).count() == 0
    whole = S.round_trip(spark.read.parquet(f"{sf}/documents.parquet"), PATH).collect()
    assert all(r.lossless for r in whole) and len(whole) == 200
