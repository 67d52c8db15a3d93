"""Training-order materialisation: token sequences in a keyed random order, in fixed-stride binary shards.

Method
    1. Each document becomes tokens and an end mark, cut into sequences of ``length`` tokens (the last is
       filled up with the end mark). A first pass only counts sequences per run of rows that a task
       reads; prefix sums over those runs, in the order of files and rows, number all sequences from 0 to N - 1
       whatever the splits are. An empty text still has its end mark.
    2. A keyed Feistel permutation of the next even number of bits, walked until it falls below N (cycle
       walking), gives each number its slot: a bijection of 0..N-1 computed row by row.
    3. Slots are dealt out by range, one task for each run of shards, sorted and written by Spark's text
       writer, whose commit protocol keeps repeated and speculative tasks apart. A record is a header (slot,
       document, sequence in the document, tokens), the tokens, and an end of two zero bytes that the writer
       puts as line separator; all records have the same stride. A shard holds ``per_shard`` records, so slot s is
       in shard s // per_shard at (s % per_shard) * stride, and a reader resumes anywhere by seeking.

Rows are known by the split of a file that they are read from and their order in it. Where docs is a scan of files with filters and
projections, these are its own splits; anything else (shuffled, sorted, united, joined, made) is written to the shared folder first. Defined results: null texts are empty; a null doc_id is stored as the smallest long and
read back as null; repeated rows have sequences of their own; an empty table writes one empty shard folder. Extra columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, byte_class, mix, slices, span_hashes, text_bytes, word_spans

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = b"\0\0"
NO_ID = -(1 << 63)
#: Pieces of the table; when it has more it is emptied, which only costs time. Bytes of a piece that is
#: remembered. Bits of the place of a piece in the table.
KNOWN, LONG, SLOTS = 1_000_000, 64, 20


_SPACE = byte_class(b" ")
#: White space of one byte, and the white space of more bytes as \\s has it.
_WHITE = byte_class(b" \t\n\v\f\r\x1c\x1d\x1e\x1f")
_WIDE_WHITE = [(0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)]


class Encoder:
    """Tokens (16 bits each) of whole columns of texts.

    Where no two white-space characters meet, every space starts a token of its own pre-token; such
    texts are cut at their spaces and the pieces, known by 64-bit hashes, looked up in a bounded table
    with array operations. Only pieces not met before, and other texts whole, go through the tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.end = len(ranks)
        if self.end >= 1 << 16:
            raise ValueError("the vocabulary needs more than 16 bits")
        self.length = np.zeros(self.end, np.int64)
        self.length[list(ranks.values())] = list(map(len, ranks))
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.clear()

    def clear(self) -> None:
        """Forgets all pieces. seen_hash and seen: a table of hashes, by their highest bits, and places in start and size."""
        self.start, self.size, self.known = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.tokens, self.used = np.zeros(1 << 14, np.uint16), 0
        self.seen_hash, self.seen = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int32)

    def _tokens(self, pieces: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of pieces that each begin with one space and end without white space, and the number of each one's.

        A token begins where each piece does, so many are encoded as one text.
        """
        tokens = np.array(self.encoding.encode_ordinary(b"".join(pieces).decode("utf-8")), np.uint16)
        upto, stops = np.cumsum(lengths), np.cumsum(self.length[tokens])
        last = np.searchsorted(stops, upto)
        if (stops[last] != upto).any():
            raise RuntimeError("a token lies over the end of a piece")
        return tokens, np.diff(last, prepend=-1)

    def _add(self, pieces: list[bytes], apart: np.ndarray) -> np.ndarray:
        """Places of the tokens of the pieces; apart: those that _tokens() takes, the others are encoded one by one."""
        order = np.argsort(~apart, kind="stable")
        listed = [pieces[k] for k in order.tolist()]
        lengths, first = np.fromiter(map(len, listed), np.int64, len(listed)), int(apart.sum())
        found = [self._tokens(listed[lo : min(lo + 512, first)], lengths[lo : min(lo + 512, first)]) for lo in range(0, first, 512)]
        for x in listed[first:]:
            tokens = np.array(self.encoding.encode_ordinary(x.decode("utf-8")), np.uint16)
            found.append((tokens, np.array([len(tokens)])))
        tokens, size = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        made, places = int(size.sum()), np.arange(self.known, self.known + len(pieces))
        while self.known + len(pieces) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + made > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros_like(self.tokens)])
        self.start[places], self.size[places] = self.used + np.cumsum(size) - size, size
        self.tokens[self.used : self.used + made] = tokens
        self.known, self.used = self.known + len(pieces), self.used + made
        return places[back]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts one after the other, and the number of each text's tokens."""
        data, offsets = text_bytes(column)
        n = len(offsets) - 1
        if self.known > KNOWN:
            self.clear()
        starts, ends, first = word_spans(data, offsets, _SPACE)
        hashes = span_hashes(data, starts, ends)
        owner = np.repeat(np.arange(n), np.diff(first))
        begins = starts == offsets[owner]
        hashes[begins] = mix(hashes[begins] + np.uint64(1))  # no space before it
        whole = np.zeros(len(starts), bool)
        hard = self._hard(data, offsets)
        if hard.any():
            easy, texts = ~hard[owner], np.flatnonzero(hard)
            order = np.argsort(np.append(owner[easy], texts), kind="stable")
            both = lambda x, y: np.append(x[easy], y)[order]
            starts, ends, hashes, begins, whole, owner = both(starts, offsets[texts]), both(ends, offsets[texts + 1]), both(hashes, np.zeros(len(texts), np.uint64)), both(begins, np.ones(len(texts), bool)), both(whole, np.ones(len(texts), bool)), both(owner, texts)
        whole |= ends - starts > LONG
        slot = (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        place = self.seen[slot].astype(np.int64)
        missed = np.flatnonzero((self.seen_hash[slot] != hashes) & ~whole)
        blob = data.tobytes()
        raw = lambda found: [blob[a:b] for a, b in zip((starts[found] - ~begins[found]).tolist(), ends[found].tolist(), strict=True)]
        if len(missed):
            values, at, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            places = self._add(raw(missed[at]), ~begins[missed[at]])
            place[missed] = places[back]
            slots = (values >> np.uint64(64 - SLOTS)).astype(np.int64)
            self.seen_hash[slots], self.seen[slots] = values, places
        known, used = self.known, self.used
        if whole.any():
            place[whole] = self._add(raw(np.flatnonzero(whole)), ~begins[whole])
        size = self.size[place]
        at = np.repeat(self.start[place] - np.cumsum(size) + size, size) + np.arange(size.sum())
        found = self.tokens[at]
        self.known, self.used = known, used  # long pieces and whole texts are not remembered
        return found, np.bincount(owner, size, n).astype(np.int64)

    @staticmethod
    def _hard(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The texts in which a space meets other white space or an end, or may do so."""
        space = np.flatnonzero(data == 32)
        white = np.append(_WHITE[data], True)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        bad = space[white[space + 1] | edge[space + 1] | edge[space] | (white[space - 1] & (space > 0))]
        wide = np.flatnonzero((data[:-1] == 0xC2) | ((data[:-1] >= 0xE1) & (data[:-1] <= 0xE3))) if len(data) else bad
        code = data[wide].astype(np.int64) << 8 | data[wide + 1]
        bad = np.append(bad, wide[np.isin(code, [a << 8 | b for a, b in _WIDE_WHITE])])
        hard = np.zeros(len(offsets) - 1, bool)
        hard[np.searchsorted(offsets, bad, side="right") - 1] = True
        return hard


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slots of the indices under a keyed permutation of 0..n-1."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))
    out = np.asarray(index, np.uint64).copy()
    going = np.arange(len(out))
    while len(going):
        x = out[going]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[going] = x = (left << np.uint64(half)) | right
        going = going[x >= n]
    return out.astype(np.int64)


def _dtype(length: int) -> np.dtype:
    return np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("seq", "<i4"), ("n", "<i4"), ("tokens", "<u2", (length,)), ("end", "V2")])


def stride(length: int) -> int:
    return _dtype(length).itemsize


def _read_in_order(docs: DataFrame) -> bool:
    """Whether the plan is a scan of files with filters and projections only, so that each split's rows come in order and in one task."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def _placed(docs: DataFrame, work: Workspace, written: bool) -> DataFrame:
    """doc_id, text, file, block, split: the rows, and the split of a file that each is read from, with its hash.

    written: the rows are written first.
    """

    def place(df: DataFrame) -> DataFrame:
        found = df.select(*own, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        return found.withColumn("split", F.xxhash64("file", "block"))

    own = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    if not written:
        try:
            return place(docs)
        except AnalysisException:  # no table of files
            pass
    return place(work.put(docs.select(*own), "docs"))


def _count(size: int, length: int) -> int:
    """Sequences of a document of ``size`` tokens and its end mark."""
    return size // length + 1


def write_shards(docs: DataFrame, vocabulary: str, folder: str, key: int = 20240229, length: int = 512, per_shard: int = 16_384) -> int:
    """Writes the shards to ``folder``; gives the number of sequences."""
    spark = docs.sparkSession
    work = Workspace(spark, "tokens")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sequences per split of a file; filters leave gaps in it, but its rows come in order and in one task."""
        code = encoder(vocabulary)
        runs: list[list] = []
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                sizes = code.encode(part.column("text"))[1].tolist()
                for size, *at in zip(sizes, *(part.column(x).to_pylist() for x in ("file", "block", "split")), strict=True):
                    if not runs or runs[-1][:3] != at:
                        runs.append([*at, 0])
                    runs[-1][3] += _count(size, length)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in runs], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["file", "block", "split", "n"])

    for written in (not _read_in_order(docs), True):
        placed = _placed(docs, work, written)
        runs = work.put(placed.mapInArrow(counts, "file string, block long, split long, n long"), "runs")
        # 16 bytes for each split of a file, in the order of the files
        held = runs.orderBy("file", "block").select("split", "n").toArrow()
        splits, sizes = (held.column(x).to_numpy() for x in ("split", "n"))
        order = np.argsort(splits)
        if (np.diff(splits[order]) != 0).all():
            break  # else a split came from several tasks, as when a file is read twice
    else:
        raise RuntimeError("rows of one split of a file came from several tasks")
    n = int(sizes.sum())
    sent = spark.sparkContext.broadcast((splits[order], (np.cumsum(sizes) - sizes)[order]))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, kind = encoder(vocabulary), _dtype(length)
        (known, firsts), split, index = sent.value, None, 0
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                tokens, sizes = code.encode(part.column("text"))
                bases, totals = [], sizes + 1
                for size, at in zip(sizes.tolist(), part.column("split").to_pylist(), strict=True):
                    if split != at:
                        split, index = at, int(firsts[np.searchsorted(known, at)])
                    bases.append(index)
                    index += _count(size, length)
                owners = -(-totals // length)
                seq = np.arange(owners.sum()) - np.repeat(np.cumsum(owners) - owners, owners)
                made = np.zeros(len(seq), kind)
                flat = np.full(len(seq) * length, code.end, np.uint16)
                flat[np.repeat((np.cumsum(owners) - owners) * length - np.cumsum(sizes) + sizes, sizes) + np.arange(len(tokens))] = tokens
                made["tokens"] = flat.reshape(-1, length)
                made["slot"] = slot = feistel(np.repeat(np.asarray(bases, np.int64), owners) + seq, n, key)
                made["doc_id"] = np.repeat(part.column("doc_id").fill_null(NO_ID).to_numpy(), owners)
                made["seq"] = seq
                made["n"] = np.minimum(length, np.repeat(totals, owners) - seq * length)
                raw = made.view(np.uint8).reshape(len(made), kind.itemsize)[:, : kind.itemsize - len(END)]
                size = raw.shape[1]
                column = pa.Array.from_buffers(pa.binary(), len(made), [None, pa.py_buffer((np.arange(len(made) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
                yield pa.RecordBatch.from_arrays([pa.array(slot), column], ["slot", "record"])

    shards = max(1, -(-n // per_shard))
    made = placed.select("doc_id", "text", "split").mapInArrow(records, "slot long, record binary").withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    dealt = made.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot").select(F.col("record").cast("string").alias("value"))
    dealt.write.mode("overwrite").option("lineSep", END.decode()).text(folder)
    sent.destroy()
    work.clear()
    return n


def read_shards(spark: SparkSession, folder: str, length: int = 512, per_shard: int = 16_384, tokens: bool = False) -> DataFrame:
    """Per stored record: slot, shard, offset, doc_id, seq, n_tokens (end mark included), tokens_crc32, in_place; with ``tokens`` the tokens too.

    in_place: the record lies in its file where its slot says.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _dtype(length)
        for batch in batches:
            for content in batch.column("content"):
                found = np.frombuffer(content.as_buffer(), kind)
                offset = np.arange(len(found)) * kind.itemsize
                ids = pa.array(found["doc_id"], pa.int64(), mask=found["doc_id"] == NO_ID)
                columns = {
                    "slot": pa.array(found["slot"]), "shard": pa.array(found["slot"] // per_shard), "offset": pa.array(offset), "doc_id": ids, "seq": pa.array(found["seq"]), "n_tokens": pa.array(found["n"]),
                    "tokens_crc32": pa.array([zlib.crc32(x.tobytes()) for x in found["tokens"]], pa.int64()), "in_place": pa.array(found["slot"] % per_shard * kind.itemsize == offset),
                }
                if tokens:
                    columns["tokens"] = pa.ListArray.from_arrays(pa.array((np.arange(len(found) + 1) * length).astype(np.int32)), pa.array(found["tokens"].ravel().astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    more = ", tokens array<int>" if tokens else ""
    return files.mapInArrow(run, f"slot long, shard long, offset long, doc_id long, seq int, n_tokens int, tokens_crc32 long, in_place boolean{more}")


def materialise(docs: DataFrame, vocabulary: str, folder: str | None = None, key: int = 20240229, length: int = 512, per_shard: int = 16_384) -> DataFrame:
    """Writes the shards (by default to the shared folder) and gives what is read back from them."""
    spark = docs.sparkSession
    folder = folder or Workspace(spark, "shards").path("shards")
    write_shards(docs, vocabulary, folder, key, length, per_shard)
    return read_shards(spark, folder, length, per_shard)
