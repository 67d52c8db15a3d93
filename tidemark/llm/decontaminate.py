"""Benchmark decontamination: a BM25 index of test items, searched by every passage of the corpus.

Method
    1. The test items are cut into units of ``UNIT`` words at most and indexed: per term the units
       that have it with their BM25 share (divided by the unit's score for itself, so 1 is a full
       match), the largest share of the list, and the largest share in each block of ``SPAN`` units.
    2. Every document is read as passages of 2 * ``UNIT`` words, ``UNIT`` apart, so each unit that
       occurs lies whole in one. A passage searches the index by block-max WAND with a fixed
       threshold and gets all units above it; there is no top k. Most passages reach the threshold in
       no block even with each term's largest share there; that bound is computed for all passages at once.
    3. A document and an item that met are verified: parts of the question's and of the answer's word
       trigrams that the whole document has, and a run of ``RUN`` of the item's words (of all, if it has fewer) in the document.
       The answer is the item's last sentence; an item of one sentence has its last third as answer.

Words are runs of letters and digits; what Unicode has as punctuation, symbol or space parts them in every script. In scripts that
are written without spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese, Tibetan) every character is a word.

The index is broadcast, so its items are taken in blocks of ``block_bytes`` of text at most; each
block is one more pass over the documents, with collection statistics of all items. contaminated() holds one block's index at a time.

Defined results: null and empty documents meet nothing; items that are null or have no words match nothing; repeated items and repeated documents are
reported for each row; a null ``doc_id`` or ``item_id`` is carried along. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NOT_WORD, Workspace, distinct, mix, slices, span_hashes, text_bytes, word_spans

UNIT, SPAN, RUN = 64, 4, 5
K1, LENGTH = 1.2, 0.75
_SENTENCE = re.compile(r"(?<=[.!?\u0964\u06d4\u061f])\s+(?=\S)|(?<=[\u3002\uff01\uff1f\uff0e\uff61])\s*(?=\S)")
_UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]"
_PARTING = r"[^\p{L}\p{M}\p{N}]+"
#: First bytes of characters that may be one of these; those of Latin letters with accents and of Cyrillic are not.
_ODD_BYTE = np.zeros(256, bool)
_ODD_BYTE[[0xC2, 0xCB, 0xCD, 0xCE, 0xCF, 0xD2, *range(0xD5, 0xE0)]] = True
_ODD_BYTE[0xE0:] = True
_ODD = list(mix(np.arange(1, RUN + 1, dtype=np.uint64)) | np.uint64(1))


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of letters and digits, and each text's first index."""
    data, offsets = text_bytes(pc.utf8_lower(column))
    sign = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) if len(data) else np.zeros(0, bool)  # × and ÷
    odd = np.flatnonzero(_ODD_BYTE[data] | np.append(sign, np.zeros(len(data) - len(sign), bool)))
    if len(odd):
        # only the texts with such characters are read by patterns
        texts = np.unique(np.searchsorted(offsets, odd, side="right") - 1)
        flagged = np.zeros(len(column), bool)
        flagged[texts] = True
        apart = pc.replace_substring_regex(pc.utf8_lower(column.take(pa.array(texts))), _PARTING, " ")
        apart = pc.replace_substring_regex(apart, f"({_UNSPACED})", r" \1 ")
        whole = pc.replace_with_mask(pc.utf8_lower(column), pa.array(flagged), apart)
        data, offsets = text_bytes(whole)
    starts, ends, first = word_spans(data, offsets, NOT_WORD)
    return span_hashes(data, starts, ends), first


def grams(words: np.ndarray) -> np.ndarray:
    """Distinct hashes of word trigrams; of fewer words, of all of them together."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    width = min(3, len(words))
    n = len(words) - width + 1
    found = np.zeros(n, np.uint64)
    for k in range(width):
        found += words[k : k + n] * _ODD[k]
    return distinct(mix(found))


def answer_start(text: str) -> int:
    """Where the answer begins: the last sentence, or the last third of the words."""
    cuts = [m.end() for m in _SENTENCE.finditer(text.rstrip())]
    if cuts:
        return cuts[-1]
    gaps = [m.end() for m in re.finditer(r"\s+(?=\S)", text)]
    if len(gaps) < 3 and regex.search(_UNSPACED, text):
        return len(text) * 2 // 3
    return gaps[len(gaps) * 2 // 3] if gaps else 0


def item_units(items: DataFrame, item: str, text: str) -> DataFrame:
    """Per unit of an item: item_id, row (one value for each item row), unit, terms, tf, length, run (words of a run), runs, question, answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, row, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = content or ""
                cut = answer_start(content)
                (words, first) = words_of(pa.array([content[:cut], content[cut:]]))
                if len(words) == 0:
                    continue
                question, answer = grams(words[: first[1]]), grams(words[first[1] :])
                run = min(RUN, len(words))
                runs = distinct(_runs(words, run)).view(np.int64).tolist()
                parts = max(1, -(-len(words) // UNIT))
                for unit, some in enumerate(np.array_split(words, parts)):
                    terms, tf = np.unique(some, return_counts=True)
                    rows.append((key, row, unit, *(x.view(np.int64).tolist() for x in (terms, tf.astype(np.int64))), len(some), run, runs, question.view(np.int64).tolist(), answer.view(np.int64).tolist()))
            names = ["item_id", "row", "unit", "terms", "tf", "length", "run", "runs", "question", "answer"]
            longs = pa.list_(pa.int64())
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), longs, longs, pa.int64(), pa.int64(), longs, longs, longs]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 10, kinds, strict=True)], names)

    own = items.select(F.col(item).alias("item_id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    kind = own.schema["item_id"].dataType.simpleString()
    return own.mapInArrow(run, f"item_id {kind}, row long, unit long, terms array<long>, tf array<long>, length long, run long, runs array<long>, question array<long>, answer array<long>")


class Index:
    """An inverted index of units with list and block maxima, and block-max WAND over it."""

    def __init__(self, units: list, frequency: dict[int, int], total: int, mean_length: float):
        self.items = [u.item_id for u in units]
        self.rows = [u.row for u in units]
        self.run = {u.row: (u.run, np.asarray(u.runs, np.int64).view(np.uint64)) for u in units}
        self.parts = {u.row: (np.asarray(u.question, np.int64).view(np.uint64), np.asarray(u.answer, np.int64).view(np.uint64)) for u in units}
        unit = np.repeat(np.arange(len(units)), [len(u.terms) for u in units]).astype(np.int64)
        term = np.concatenate([np.asarray(u.terms, np.int64) for u in units]).view(np.uint64)
        tf = np.concatenate([np.asarray(u.tf, np.float64) for u in units])
        df = np.asarray([frequency[t] for u in units for t in u.terms], np.float64)
        length = np.asarray([u.length for u in units], np.float64)[unit]
        share = np.log1p((total - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - LENGTH + LENGTH * length / mean_length))
        share /= np.bincount(unit, share)[unit]
        order = np.lexsort((unit, term))
        unit, term, share = unit[order], term[order], share[order]
        self.terms, first = np.unique(term, return_index=True)
        self.first = np.append(first, len(term))
        self.units, self.shares = unit, share
        self.most = np.maximum.reduceat(share, first)
        # block maxima: per term one entry for each block of SPAN units in which it occurs
        block = unit // SPAN
        fresh = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (term[1:] != term[:-1])))
        self.blocks, self.block_most = block[fresh], np.maximum.reduceat(share, fresh)
        self.block_first = np.searchsorted(fresh, self.first)
        self.n_blocks = int(block.max()) + 1
        # block maxima of the commoner terms, one dense row each
        common = np.flatnonzero(np.diff(self.block_first) > max(2, self.n_blocks // 8))
        self.dense_row = np.full(len(self.terms), -1)
        self.dense_row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n_blocks))
        for row, k in enumerate(common):
            own = slice(self.block_first[k], self.block_first[k + 1])
            self.dense[row, self.blocks[own]] = self.block_most[own]
        self.lists: dict[int, tuple] = {}

    def _list(self, term: int) -> tuple:
        if term not in self.lists:
            a, b = self.first[term], self.first[term + 1]
            c, d = self.block_first[term], self.block_first[term + 1]
            self.lists[term] = (self.units[a:b].tolist(), self.shares[a:b].tolist(), dict(zip(self.blocks[c:d].tolist(), self.block_most[c:d].tolist(), strict=True)), float(self.most[term]))
        return self.lists[term]

    def hopeful(self, passage: np.ndarray, term: np.ndarray, n: int, threshold: float) -> np.ndarray:
        """The passages whose block maxima reach the threshold in some block.

        passage, term: distinct pairs in the order of passages. The sums over terms are those that WAND
        tests before it moves; here one array operation makes them for many passages.
        """
        found = []
        step = max(1, (1 << 22) // self.n_blocks)
        for lo in range(0, n, step):
            a, b = np.searchsorted(passage, [lo, lo + step])
            who, what = passage[a:b] - lo, term[a:b]
            size = min(step, n - lo)
            often = self.dense_row[what] >= 0
            bound = np.zeros((size, self.n_blocks))
            if often.any():
                rows, first = np.unique(who[often], return_index=True)
                bound[rows] = np.add.reduceat(self.dense[self.dense_row[what[often]]], first)
            who, what = who[~often], what[~often]
            start, count = self.block_first[what], np.diff(self.block_first)[what]
            at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
            bound += np.bincount(np.repeat(who, count) * self.n_blocks + self.blocks[at], self.block_most[at], size * self.n_blocks).reshape(size, self.n_blocks)
            found.append(lo + np.flatnonzero(bound.max(axis=1) >= threshold - 1e-9))
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Every unit whose score reaches the threshold."""
        threshold -= 1e-9
        lists = [[x[0][0], 0, *x] for x in map(self._list, terms)]  # current unit, position, units, shares, block maxima, maximum
        found = []

        def seek(entry: list, unit: int) -> None:
            entry[1] = bisect_left(entry[2], unit, entry[1])
            entry[0] = entry[2][entry[1]] if entry[1] < len(entry[2]) else end

        end = len(self.items)
        while True:
            lists = sorted((x for x in lists if x[0] < end), key=lambda x: x[0])
            bound, pivot = 0.0, -1
            for k, entry in enumerate(lists):
                bound += entry[5]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            unit = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == unit:
                pivot += 1
            block = unit // SPAN
            if sum(x[4].get(block, 0.0) for x in lists[: pivot + 1]) >= threshold:
                if lists[0][0] == unit:
                    score = sum(x[3][x[1]] for x in lists[: pivot + 1])
                    if score >= threshold:
                        found.append((unit, score))
                    for x in lists[: pivot + 1]:
                        seek(x, unit + 1)
                else:
                    for x in lists[:pivot]:
                        if x[0] < unit:
                            seek(x, unit)
            else:
                beyond = (block + 1) * SPAN
                if pivot + 1 < len(lists):
                    beyond = min(beyond, lists[pivot + 1][0])
                for x in lists[: pivot + 1]:
                    seek(x, max(beyond, unit + 1))

    def search(self, column: pa.Array, threshold: float, question: float, answer: float) -> list[tuple]:
        """(text, item_id, score, question overlap, answer overlap) of every verified match."""
        words, first = words_of(column)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        met = np.flatnonzero(self.terms[at] == words)
        if not len(met):
            return []
        text = np.searchsorted(first, met, side="right") - 1
        step = (met - first[text]) // UNIT
        base = np.concatenate([[0], np.cumsum(-(-np.diff(first) // UNIT))])  # one passage begins at every UNIT-th word
        passage = base[text] + step
        both = np.concatenate([passage[step > 0] - 1, passage])
        pairs = distinct(both * len(self.terms) + np.concatenate([at[met][step > 0], at[met]]))
        passage, term = pairs // len(self.terms), pairs % len(self.terms)
        best: dict[tuple[int, int], tuple[int, float]] = {}
        for p in self.hopeful(passage, term, int(base[-1]), threshold):
            a, b = np.searchsorted(passage, [p, p + 1])
            owner = int(np.searchsorted(base, p, side="right")) - 1
            for unit, score in self.wand(term[a:b].tolist(), threshold):
                key = (owner, self.rows[unit])
                if score > best.get(key, (0, 0.0))[1]:
                    best[key] = (unit, score)
        out, last, own, whole = [], -1, None, words[:0]
        for (owner, row), (unit, score) in sorted(best.items()):
            if owner != last:
                whole = words[first[owner] : first[owner + 1]]
                last, own = owner, grams(whole)
            run, runs = self.run[row]
            if not np.isin(_runs(whole, run), runs).any():
                continue
            shares = []
            for part in self.parts[row]:
                if len(part):
                    have = own if len(part) > 1 else np.concatenate([own, *(_runs(whole, w) for w in (1, 2))])
                    shares.append(float(np.isin(part, have).mean()))
                else:
                    shares.append(1.0)
            if shares[0] >= question and shares[1] >= answer:
                out.append((owner, self.items[unit], score, *shares))
        return out


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, as grams() has them for parts of fewer than three words."""
    n = max(0, len(words) - width + 1)
    found = np.zeros(n, np.uint64)
    for k in range(width):
        found += words[k : k + n] * _ODD[k]
    return mix(found)


def indexes(items: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = 1 << 20) -> Iterator[Index]:
    """Indexes of blocks of the items, each of ``block_bytes`` of text at most on average."""
    work = Workspace(items.sparkSession, "items")
    units = work.put(item_units(items, item, text), "units")
    size = items.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    total, mean_length = units.agg(F.count("*"), F.avg("length")).first()
    blocks = max(1, -(-size // block_bytes))
    terms = units.select("row", F.explode("terms").alias("t"))
    frequency = terms.groupBy("t").agg(F.count("*").alias("df"))
    for k in range(blocks if total else 0):
        own = F.pmod(F.xxhash64("row"), F.lit(blocks)) == k
        held = frequency.join(terms.filter(own).select("t").distinct(), "t").collect()
        found = sorted(units.filter(own).collect(), key=lambda u: (u.row, u.unit))
        if found:
            yield Index(found, {r.t: r.df for r in held}, total, float(mean_length))
    work.drop("units")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.6, question: float = 0.5, answer: float = 0.5) -> DataFrame:
    """One row for each verified document and item: doc_id, item_id, score, question_overlap, answer_overlap."""
    spark = docs.sparkSession
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, item_id {kind}, score double, question_overlap double, answer_overlap double"
    work = Workspace(spark, "matches")
    out = spark.createDataFrame([], schema)
    for block, index in enumerate(indexes(items)):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            kind = pa.array(sent.value.items).type
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    found = sent.value.search(part.column("text"), threshold, question, answer)
                    who, item, *shares = zip(*found, strict=True) if found else [[]] * 5
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(who, pa.int64())), pa.array(item, kind), *(pa.array(x, pa.float64()) for x in shares)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(work.put(own.mapInArrow(run, schema), f"block-{block}"))
        sent.destroy()
    return out


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.6, question: float = 0.5, answer: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, without those that hold a test item."""
    for index in indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    held = {x[0] for x in sent.value.search(part.column("text"), threshold, question, answer)}
                    yield part.filter(pa.array([k not in held for k in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
