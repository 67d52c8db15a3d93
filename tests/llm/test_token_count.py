import public_tokenizers
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from tidemark.llm.token_count import MergeCounter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "a", "Hello world", "  two  spaces ", "tab\there\nnew\n\nline", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>",
    "don't we'll I'D", "naïve œuvre Straße 北京 🙂🙂", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x y z 　",
    "3.14159 1,000 ½ ² Ⅷ", "a\x1cb \x85 c", "é́ combining", "\x00\x01", " leading", "trailing ", "ab" * 3000,
]


@pytest.mark.parametrize("text", TEXTS)
def test_counts_as_the_library(text):
    library = Tokenizer.from_file(PATH)
    assert MergeCounter(PATH).count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_rows(spark):
    rows = [Row(doc_id=k, text=t, n_tokens="clash") for k, t in enumerate([*TEXTS, None, "Hello world"])]
    found = {r.doc_id: r for r in token_counts(spark.createDataFrame(rows), PATH).collect()}
    assert len(found) == len(rows) and found[len(TEXTS)].n_tokens == 0 and found[len(TEXTS)].n_bytes == 0
    assert found[3].n_tokens == found[len(TEXTS) + 1].n_tokens == 2 and not found[3].over_limit
    assert found[18].over_limit and found[18].n_bytes == 6000


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    library = Tokenizer.from_file(PATH)
    expected = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, PATH).collect()} == expected


def test_empty(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
