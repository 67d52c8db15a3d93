import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import Row
from tokenizers import Tokenizer

from tidemark.llm.token_align import Aligner, alignment
from tidemark.llm.token_count import MergeCounter, byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    "", " ", "hello world  a", "<s> x <|endoftext|>y</s> <unk>", " lead", "trail ", "a　 b  c", "x▁y z", None, "北京 大学 zażółć", "a\n b\n\nc \t d   e", "\n\n  x", "x" * 300 + " y", "“quoted” — ‘text’ don't I'LL", "🙂🙂 🙂",
    "hello world  a", "a b  c \x1c d", "\x00\x01 \x00", "ab " * 2000, "   ", "wörter " * 300 + "▁",
]


def links_of(texts):
    """Tokens, groups and links of each text byte by byte, with the libraries."""
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    byte = {letter: k for k, letter in enumerate(byte_letters())}
    for text in texts:
        a, b, groups, links = [], [], [], []
        if text:
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            raw_a = [bytes(byte[x] for x in a_lib.id_to_token(k)) for k in a]
            raw_b = [bytes([int(x[1:-1], 16)]) if b_lib.is_byte(k) else x.replace("▁", " ").encode() for k in b for x in [b_lib.id_to_piece(k)]]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                of_a, of_b = ([k for k, x in enumerate(raw) for _ in x] for raw in (raw_a, raw_b))
                links = [(a[x], b[y]) for x, y in dict.fromkeys(zip(of_a, of_b, strict=True))]
                ends = sorted(set(np.cumsum(list(map(len, raw_a)))) & set(np.cumsum(list(map(len, raw_b)))))
                for lo, hi in zip([0, *ends], ends, strict=False):
                    groups.append(",".join(str(a[k]) for k in dict.fromkeys(of_a[lo:hi])) + "|" + ",".join(str(b[k]) for k in dict.fromkeys(of_b[lo:hi])))
            else:
                a, b = [], []
        yield a, b, groups, links


def brute(texts):
    found = list(links_of(texts))
    count = Counter(x for *_, links in found for x in links)
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    return [(len(a), len(b), len(groups), len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if links else "") for a, b, groups, links in found]


def figures(rows):
    return [tuple(r[x] for x in NAMES) for r in rows]


def test_odd_texts(spark):
    docs = spark.createDataFrame([Row(doc_id=k, text=t, n_a="clash", slice=1, stripe="clash") for k, t in enumerate(TEXTS)]).repartition(3)
    assert figures(alignment(docs, A, B).orderBy("doc_id").collect()) == brute(TEXTS)


def test_documents_and_many_lots(spark, sf, monkeypatch):
    from tidemark.llm import token_align

    monkeypatch.setattr(token_align, "TOGETHER", 3)  # pairs are added up in two rounds
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(9)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert figures(alignment(docs, A, B).orderBy("doc_id").collect()) == brute(texts)


def test_null_and_repeated_keys(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b"), (1, None)], "doc_id long, text string")
    found = alignment(docs, A, B).collect()
    assert sorted(figures(found)) == sorted(brute(["a b c", "a b c", "a b", None])) and sum(r.doc_id is None for r in found) == 2


def test_empty(spark):
    found = alignment(spark.createDataFrame([], "doc_id string, text string"), A, B)
    assert found.columns == ["doc_id", *NAMES] and found.count() == 0


def test_every_entry_is_what_its_merges_make():
    """So merging by the rank of what is made gives what merging by listed pairs gives."""
    counter, side = MergeCounter(A), Aligner(A, B).left
    raw = side.bytes.tobytes()
    entries = [raw[x : x + n] for x, n in zip(side.starts.tolist(), side.sizes.tolist(), strict=True) if n]
    assert all(counter.merged(x) == 1 for x in entries) and len(entries) == 50256


@pytest.mark.parametrize("seed", range(3))
def test_cuts_don_t_change_tokens(seed):
    draw = np.random.default_rng(seed)
    alphabet = list("ab'sé▁　 “北.1") + [" "] * 6 + ["\n", "\t", "  "]
    texts = ["".join(draw.choice(alphabet, draw.integers(1, 60))) for _ in range(400)]
    import pyarrow as pa

    made = Aligner(A, B).slice(pa.array(texts))
    assert [tuple(x[:4]) for x in made["figures"].tolist()] == [(len(a), len(b), len(groups), len(links)) for a, b, groups, links in links_of(texts)]
    assert made["digests"] == [hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "" for _, _, groups, _ in links_of(texts)]
