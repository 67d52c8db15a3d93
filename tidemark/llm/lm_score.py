"""Language-model scores by stupid backoff over bigram and word counts, computed relationally.

With c the counts over all documents of the corpus (the scored documents themselves unless another corpus is given), N
its number of words, c(v .) the bigrams that begin with v, and <s> before each document's first word

    S(w | v) = c(v w) / c(v .)        if the bigram occurs in the corpus
             = 0.4 * c(w) / N         if not, but the word does
             = 0.4 * 0.4 / N          otherwise

and a document's score is the mean of log10 S over its words. No count is cut off. Where the corpus is the scored table,
every bigram has been counted and nothing backs off. Method
    1. Word counts: each task counts the words of its slices of text before the shuffle. A word with more than a
       quarter of a bucket's share is hot, as is a pair of hot words with as many occurrences: at most 4 * buckets of
       each, so these counts are broadcast. The share of hot pairs in a document's score is added up where its text is.
    2. All other bigrams of each document, counted, are dealt by the hash of their context into ``buckets``, those of a
       hot context by both words. Packed arrays go through the shuffle, once, and are exploded behind it.
    3. In a bucket the count tables of bigrams and contexts are met with the exploded bigrams by windows over the
       bucket's rows, which is their join without another shuffle; sums of logarithms go to the documents.
    4. Bigrams that the corpus lacks are joined to the word counts by their word.

Words are runs of letters, digits and non-ASCII characters, lower-cased, known by 64-bit hashes.
Defined results: a text without words, null or empty has n_words 0 and a null score; every row has a result of its own,
with repeated and null keys; an empty table gives an empty result, an empty corpus null scores. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, mix, slices
from tidemark.llm.decontaminate import words_of

START = np.uint64(0x5374617274)
BACKOFF = 0.4
#: Bytes of text whose words are in memory at a time.
SLICE = 1 << 20


def _before(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each word; <s> at the beginning of a text."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first[:-1][np.diff(first) > 0]] = START
    return before


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(w + mix(v))


def word_counts(rows: DataFrame) -> DataFrame:
    """(w, c, context, all): counts of words in counted rows, how often each is a context there, and both kinds of rows.

    <s> is a context once for each document with words. rows: (text, counted).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words, first = words_of(part.column("text"))
                counted = np.repeat(part.column("counted").to_numpy(zero_copy_only=False), np.diff(first))
                found, index = np.unique(np.concatenate([words, _before(words, first)]), return_inverse=True)
                word, context = index[: len(words)], index[len(words) :]
                c, ahead = (np.bincount(x[counted], minlength=len(found)) for x in (word, context))
                every = np.maximum(*(np.bincount(x, minlength=len(found)) for x in (word, context)))
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (found.view(np.int64), c, ahead, every)], ["w", "c", "context", "every"])

    return rows.select("text", "counted").mapInArrow(run, "w long, c long, context long, every long").groupBy("w").agg(*(F.sum(x).alias(x) for x in ("c", "context", "every")))


def pair_counts(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """(p, v, c, every): counts in counted and in all rows of the pairs of two hot words, by the pair's hash; v is its first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words, first = words_of(part.column("text"))
                before = _before(words, first)
                counted = np.repeat(part.column("counted").to_numpy(zero_copy_only=False), np.diff(first))
                both = np.flatnonzero(np.isin(words, hot) & np.isin(before, hot))
                found, where, index = np.unique(_pair(before[both], words[both]), return_index=True, return_inverse=True)
                sums = (np.bincount(x, minlength=len(found)).astype(np.int64) for x in (index[counted[both]], index))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found.view(np.int64), before[both][where].view(np.int64), *sums)], ["p", "v", "c", "every"])

    return rows.select("text", "counted").mapInArrow(run, "p long, v long, c long, every long").groupBy("p", "v").agg(F.sum("c").alias("c"), F.sum("every").alias("every"))


def packed_bigrams(rows: DataFrame, buckets: int, hot: np.ndarray, pairs: np.ndarray, logs: np.ndarray) -> DataFrame:
    """Per slice of text and bucket the arrays v, w, r, n, c and x: bigram (v w) occurs n times in row r, c times counted.

    hot: sorted words; pairs: sorted hashes of pairs that are not dealt, as their logs are known. Each scored row also has
    one entry with c = -1: n are its words, x the logarithms of its pairs, v its doc_id and w whether that is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words, first = words_of(part.column("text"))
                size = np.diff(first)
                owner = np.repeat(np.arange(part.num_rows), size).astype(np.int32)
                before = _before(words, first)
                scored, counted = (part.column(x).to_numpy(zero_copy_only=False) for x in ("scored", "counted"))
                both = np.zeros(len(words), np.uint64)
                often = np.isin(before, hot)
                both[often] = _pair(before[often], words[often])
                known = np.flatnonzero(often & np.isin(both, pairs)) if len(pairs) else np.zeros(0, np.int64)
                own = np.bincount(owner[known], logs[np.searchsorted(pairs, both[known])] if len(known) else None, part.num_rows)
                bucket = (np.where(often, both, mix(before)) % np.uint64(buckets)).astype(np.int32)
                left = np.ones(len(words), bool)
                left[known] = False
                bucket, words, before, owner = bucket[left], words[left], before[left], owner[left]
                order = np.lexsort((owner, words, before, bucket))
                bucket, words, before, owner = bucket[order], words[order], before[order], owner[order]
                at = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (before[1:] != before[:-1]) | (words[1:] != words[:-1]) | (owner[1:] != owner[:-1]))[: len(words)])
                n = np.diff(np.append(at, len(words))).astype(np.int32)
                bucket, words, before, owner = bucket[at], words[at], before[at], owner[at]
                c, x = np.where(counted[owner], n, 0).astype(np.int32), np.zeros(len(n), np.float64)
                n = np.where(scored[owner], n, 0).astype(np.int32)
                # the entry of each scored row, in the bucket of its place
                rows, ids = np.flatnonzero(scored), part.column("doc_id")
                place = (rows % buckets).astype(np.int32)
                bucket = np.append(bucket, place)
                order = np.argsort(bucket, kind="stable")
                columns = [
                    np.append(before, ids.fill_null(0).to_numpy().view(np.uint64)[rows]).view(np.int64),
                    np.append(words, ids.is_null().to_numpy(zero_copy_only=False)[rows].astype(np.uint64)).view(np.int64),
                    part.column("row").to_numpy()[np.append(owner, rows)],
                    np.append(n, size[rows].astype(np.int32)).astype(np.int32),
                    np.append(c, np.full(len(rows), -1, np.int32)).astype(np.int32),
                    np.append(x, own[rows]),
                ]
                bucket = bucket[order]
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
                offsets = pa.array(np.append(cuts, len(bucket)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(y[order])) for y in columns]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), *lists], ["bucket", "v", "w", "r", "n", "c", "x"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "scored", "counted")
    return numbered.mapInArrow(run, "bucket int, v array<long>, w array<long>, r array<long>, n array<int>, c array<int>, x array<double>")


def _rows(docs: DataFrame, corpus: DataFrame | None) -> DataFrame:
    """(doc_id, text, scored, counted): the documents to score, and those of another corpus to count."""
    text = F.col("text").cast("string").alias("text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.lit(True).alias("scored"), F.lit(corpus is None).alias("counted"))
    return own if corpus is None else own.unionByName(corpus.select(F.lit(None).cast("long").alias("doc_id"), text, F.lit(False).alias("scored"), F.lit(True).alias("counted")))


def scores(docs: DataFrame, corpus: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, score (mean log10, null without words).

    corpus: the documents that are counted, by default docs; buckets: by default the session's number of shuffle partitions.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = Workspace(spark, "lm")
    texts = _rows(docs, corpus)
    counts = work.put(word_counts(texts), "counts")
    start = F.col("w") == int(START)
    sizes = counts.agg(F.sum(F.when(start, 0).otherwise(F.col("c"))), F.sum(F.when(start, 0).otherwise(F.col("every")))).first()
    total, share = sizes[0] or 0, (sizes[1] or 0) / (4 * buckets)
    hot = counts.filter(F.col("every") > share).select("w", "context")
    held = hot.collect()
    words = np.sort(np.asarray([r.w for r in held], np.int64).view(np.uint64))
    # a pair that the corpus lacks is left to step 4
    often = pair_counts(texts, words).filter((F.col("every") > share) & (F.col("c") > 0)).collect() if len(words) else []
    pairs, logs = _known(often, held)
    packed = packed_bigrams(texts, buckets, words, pairs, logs).repartitionById(buckets, F.col("bucket"))
    rows = packed.select("bucket", F.inline(F.arrays_zip("v", "w", "r", "n", "c", "x")))
    counted = F.sum(F.when(F.col("c") > 0, F.col("c")).otherwise(0))
    bigram, context = Window.partitionBy("bucket", "v", "w"), Window.partitionBy("bucket", "v")
    met = rows.withColumns({"vw": counted.over(bigram), "part": counted.over(context)}).filter("n > 0 or c = -1")
    met = met.join(F.broadcast(hot.select(F.col("w").alias("v"), F.col("context").alias("whole"))), "v", "left")
    row = F.col("c") == -1
    logs_of = F.when(row, F.col("x")).when(F.col("vw") > 0, F.col("n") * F.log10(F.col("vw") / F.coalesce("whole", "part")))
    sums = (F.sum(F.when(row, F.col("n"))).alias("n_words"), F.sum(logs_of).alias("logs"), F.max(F.when(row & (F.col("w") == 0), F.col("v"))).alias("doc_id"))
    if corpus is None:
        summed = met.groupBy("r").agg(*sums)
    else:
        known = work.put(met.select("r", "w", "v", "n", "c", "x", "vw", "part", "whole"), "met")
        unseen = known.filter("c <> -1 and vw = 0").select("r", "w", "n").join(counts.filter(~start).select("w", F.col("c").alias("count")), "w", "left")
        word = F.when(F.col("count") > 0, F.col("count")).otherwise(F.lit(BACKOFF))
        backed = unseen.select("r", F.lit(None).cast("long").alias("n_words"), (F.col("n") * F.log10(F.lit(BACKOFF) * word / F.lit(float(max(total, 1))))).alias("logs"), F.lit(None).cast("long").alias("doc_id"))
        parts = known.groupBy("r").agg(*sums).unionByName(backed)
        summed = parts.groupBy("r").agg(F.max("n_words").alias("n_words"), F.sum("logs").alias("logs"), F.max("doc_id").alias("doc_id"))
    score = F.when((F.col("n_words") > 0) & F.lit(total > 0), F.col("logs") / F.col("n_words"))
    result = Workspace(spark, "lm").put(summed.select("doc_id", F.col("n_words").cast("long").alias("n_words"), score.alias("score")), "scores")
    work.clear()
    return result


def _known(often: list, hot: list) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of the hot pairs, and log10 of their share of the context."""
    contexts = {r.w: r.context for r in hot}
    found = sorted((int(np.int64(r.p).view(np.uint64)), r.c / contexts[r.v]) for r in often)
    return np.asarray([p for p, _ in found], np.uint64), np.log10([x for _, x in found])


#: DuckDB SQL for scores() rounded to six places.
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
p AS (SELECT r, unnest(ws) AS w, unnest(list_prepend('<s>', ws[:-2])) AS v FROM t WHERE len(ws) > 0),
bi AS (SELECT v, w, count(*) AS c FROM p GROUP BY v, w),
ctx AS (SELECT v, sum(c)::DOUBLE AS c FROM bi GROUP BY v),
s AS (SELECT r, count(*) AS n_words, avg(log10(bi.c / ctx.c)) AS score FROM p JOIN bi ON bi.v = p.v AND bi.w = p.w JOIN ctx ON ctx.v = p.v GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(score, 6) AS score FROM t LEFT JOIN s USING (r)
"""
