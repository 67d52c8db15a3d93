"""Cross-tokenizer alignment: which tokens of two vocabularies lie over the same bytes, and how often in the corpus.

A is a byte-level BPE file, B a sentencepiece model that puts a space in front. Both encode a space and
the text; byte offsets where tokens of both end cut the text into groups, and each pair of an A and a B
occurrence whose bytes overlap is a link.

Method
    1. Texts are cut at single spaces before which and after which no white space lies; tokens of either kind end
       there, so a segment is encoded and linked on its own, once for each segment of a slice of texts
       (and a bounded table keeps segments already met). A slice writes its distinct pairs of ids with their
       numbers, dealt by stripes of B ids, and the segments of its documents.
    2. Pairs are partitioned by stripe and added into a dense block of counts (B ids of the stripe x A ids) by
       np.add.at; stripes with pairs of very many slices are dealt on, added up twice. Row maxima are each B id's best.
    3. The block of a stripe answers the pairs of each slice; answers are partitioned like the slices' documents, whose
       figures are sums over their segments.

A task holds one block (stripe x A ids) and one slice at a time.

Defined results: null and empty texts, and texts whose joined token bytes of A or B differ from space and text, have no
tokens: zeros and '' for the digest. Strings of special tokens are plain text. Rows are independent of their
keys: repeated rows count each, a null key stays null. An empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import Workspace, byte_class, slices, span_hashes, text_bytes
from tidemark.llm.token_count import PATTERN, byte_letters

#: Segments of the table of a worker, which is emptied when full; bytes of a segment that it keeps; bits of a place in it.
KNOWN, LONG, SLOTS = 400_000, 64, 20
#: Bytes of text in a slice; B ids in a stripe; slices whose pairs of a stripe meet in one group of rows.
SLICE, STRIPE, TOGETHER = 2 << 20, 64, 256
#: After a space: bytes that are white space or control, or may begin white space of several bytes.
_NO_CUT = byte_class(bytes(range(33)) + b"\xc2\xe1\xe2\xe3")
_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


class _Growing:
    """An array that is added to at its end."""

    def __init__(self, kind: type):
        self.data, self.used = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.used + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.used : self.used + len(values)] = values
        self.used += len(values)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each stretch, one stretch after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def planes(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: how many bytes each needs, then all lowest bytes, all second bytes, and so on."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(raw.T).tobytes()


def numbers(raw: bytes) -> np.ndarray:
    width = raw[0]
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<i8").ravel()


class _Side:
    """The entries of one vocabulary: their bytes, one after the other, and their numbers as text with either separator."""

    def __init__(self, entries: list[bytes], last: str):
        self.sizes = np.array([len(x) for x in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        self.names = np.array([f"{k}{end}".encode() for k in range(len(entries)) for end in (",", last)], f"S{len(str(len(entries))) + 1}")

    def spell(self, ids: np.ndarray, owner: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each segment (sizes: of their bytes in data): whether its tokens' joined bytes are its bytes."""
        right = np.bincount(owner, self.sizes[ids], len(sizes)) == sizes
        kept = ids[right[owner]]
        found = self.bytes[ragged(self.starts[kept], self.sizes[kept])]
        of = np.repeat(np.arange(len(sizes)), sizes)
        meant = right[of]
        right[of[meant][found != data[meant]]] = False
        return right


class Aligner:
    """Encodes and links segments of texts; keeps segments already met."""

    def __init__(self, byte_level: str, pieces: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        with open(byte_level, encoding="utf-8") as file:
            spec = json.load(file)["model"]
        byte = {letter: k for k, letter in enumerate(byte_letters())}
        spelt = lambda name: bytes(byte[x] for x in name)
        made = [x.split(" ") if isinstance(x, str) else x for x in spec["merges"]]
        ranks = {bytes([k]): k for k in range(256)}
        for left, right in made:
            ranks.setdefault(spelt(left + right), len(ranks))
        ids = {spelt(name): k for name, k in spec["vocab"].items()}
        # merging by rank of what is made, as each entry's own merges make it
        self.a, self.b = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), SentencePieceProcessor(model_file=pieces)
        self.id = np.array([ids[x] for x in ranks], np.int64)
        entries = [b""] * (max(ids.values()) + 1)
        for name, k in ids.items():
            entries[k] = name
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.left = _Side(entries, "|")
        self.right = _Side([bytes([int(x[1:-1], 16)]) if self.b.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)], ";")
        if any("▁" in x[1:] and x.strip("▁") for x in names):
            raise ValueError("pieces with a space inside: texts can't be cut at spaces")
        self.n_a, self.n_b = len(entries), len(names)
        self.clear()

    def clear(self) -> None:
        self.known, self.strings = 0, []
        self.pairs = _Growing(np.int64)
        self.table = {x: _Growing(np.int64) for x in ("start", *_FIGURES, "right")}
        self.seen_hash, self.seen = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int64)

    def _forget(self, known: int, pairs: int) -> None:
        self.known, self.pairs.used = known, pairs
        del self.strings[known:]
        for x in self.table.values():
            x.used = known

    def _left(self, texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's tokens of all texts, and the number of each text's; many texts are encoded as one where tokens end where they do."""
        ids, counts = [], []
        for lo in range(0, len(texts), 256):
            part = texts[lo : lo + 256]
            joined = self.id[self.a.encode_ordinary("".join(part))]
            stops = np.cumsum(self.left.sizes[joined])
            ends = np.cumsum(sizes[lo : lo + 256])
            at = np.searchsorted(stops, ends)
            if (stops[np.minimum(at, len(stops) - 1)] == ends).all():
                counts.append(np.diff(at, prepend=-1))
            else:
                each = [self.a.encode_ordinary(x) for x in part]
                joined = self.id[list(chain.from_iterable(each))]
                counts.append(np.fromiter(map(len, each), np.int64, len(each)))
            ids.append(joined)
        return np.concatenate(ids), np.concatenate(counts)

    def _add(self, segments: list[bytes]) -> np.ndarray:
        """Encodes and links segments; gives their places."""
        texts = [x.decode("utf-8") for x in segments]
        n = len(texts)
        sizes = np.fromiter(map(len, segments), np.int64, n)
        data = np.frombuffer(b"".join(segments), np.uint8)
        found = self.b.encode([x[1:] for x in texts], num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, n)
        sides = [(*self._left(texts, sizes), self.left), (np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts, self.right)]
        owners = [np.repeat(np.arange(n), x[1]) for x in sides]
        right = sides[0][2].spell(sides[0][0], owners[0], data, sizes) & sides[1][2].spell(sides[1][0], owners[1], data, sizes)
        (a, own_a), (b, own_b) = ((x[0][right[owner]], owner[right[owner]]) for x, owner in zip(sides, owners, strict=True))
        # over the bytes of the segments that are right: where tokens of either side end
        end_a, end_b = np.cumsum(self.left.sizes[a]), np.cumsum(self.right.sizes[b])
        n_bytes = int(end_a[-1]) if len(a) else 0
        by_a, by_b = np.zeros(n_bytes + 1, bool), np.zeros(n_bytes + 1, bool)
        by_a[end_a], by_b[end_b] = True, True
        before = lambda mark: np.cumsum(mark) - mark  # noqa: E731  ends before an offset
        group = before(by_a & by_b)
        group_a, group_b = group[end_a], group[end_b]
        links, groups = np.flatnonzero(by_a | by_b), np.flatnonzero(by_a & by_b)
        link_a, link_b = before(by_a)[links], before(by_b)[links]
        # a text lists the A ids of a group, then its B ids
        size_a, size_b = np.bincount(group_a, minlength=len(groups)), np.bincount(group_b, minlength=len(groups))
        at_a, at_b = np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a], np.arange(len(b)) + np.cumsum(size_a)[group_b]
        width = max(self.left.names.dtype.itemsize, self.right.names.dtype.itemsize)
        names, owner = np.zeros(len(a) + len(b), f"S{width}"), np.zeros(len(a) + len(b), np.int64)
        names[at_a], names[at_b] = self.left.names[2 * a + by_b[end_a]], self.right.names[2 * b + by_a[end_b]]
        owner[at_a], owner[at_b] = own_a, own_b
        raw = names.view(np.uint8).reshape(len(names), width)
        filled = raw > 0
        joined = raw[filled].tobytes()
        stops = np.cumsum(np.bincount(owner, filled.sum(axis=1), n).astype(np.int64)).tolist()
        self.strings += [joined[x:y] for x, y in zip([0, *stops], stops, strict=False)]
        per = {"n_a": np.bincount(own_a, minlength=n), "n_b": np.bincount(own_b, minlength=n), "n_groups": np.bincount(own_a[before(by_a)[groups]], minlength=n), "n_links": np.bincount(own_a[link_a], minlength=n)}
        places = np.arange(self.known, self.known + n)
        for name, values in (per | {"start": self.pairs.used + np.cumsum(per["n_links"]) - per["n_links"], "right": right}).items():
            self.table[name].add(values)
        self.pairs.add(b[link_b] * self.n_a + a[link_a])
        self.known += n
        return places

    def slice(self, column: pa.Array) -> dict:
        """What is stored of a slice of texts.

        figures: per text n_a, n_b, n_groups, n_links and the number of its segments; digests; segments: of the
        texts, as indices of the slice's distinct segments; sizes: pairs of each distinct segment; members: those
        pairs, as indices of pairs, the distinct pairs (b * n_a + a) in order; times: their numbers.
        """
        if self.known > KNOWN:
            self.clear()
        data, offsets = text_bytes(column)
        n = len(offsets) - 1
        empty = np.diff(offsets) == 0
        data = np.insert(data, offsets[:-1][~empty], 32)
        offsets = offsets + np.append(0, np.cumsum(~empty))
        begins = np.zeros(len(data), bool)
        space = np.flatnonzero(data == 32)
        begins[space[~np.append(_NO_CUT[data], True)[space + 1] & (data[space - 1] != 32)]] = True
        begins[offsets[:-1][~empty]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        owner = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, offsets)))
        place = np.zeros(len(starts), np.int64)
        blob = data.tobytes()
        raw = lambda found: [blob[x:y] for x, y in zip(starts[found].tolist(), ends[found].tolist(), strict=True)]
        short = np.flatnonzero(ends - starts <= LONG)
        hashes = span_hashes(data, starts[short], ends[short])
        slot = (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        place[short] = self.seen[slot]
        missed = np.flatnonzero(self.seen_hash[slot] != hashes)
        if len(missed):
            values, at, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            places = self._add(raw(short[missed[at]]))
            place[short[missed]] = places[back]
            slots = (values >> np.uint64(64 - SLOTS)).astype(np.int64)
            self.seen_hash[slots], self.seen[slots] = values, places
        kept, pairs = self.known, self.pairs.used
        if len(short) < len(starts):
            whole = np.flatnonzero(ends - starts > LONG)
            place[whole] = self._add(raw(whole))
        table = {x: y.data for x, y in self.table.items()}
        right = ~empty & (np.bincount(owner, 1 - table["right"][place], n) == 0)
        used = right[owner]
        place, owner = place[used], owner[used]
        strings = [self.strings[k] for k in place.tolist()]
        sizes = np.bincount(owner, minlength=n)
        ends = np.cumsum(sizes)
        digests = [hashlib.sha256(b"".join(strings[x:y])[:-1]).hexdigest() if y > x else "" for x, y in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        figures = np.stack([*(np.bincount(owner, table[x][place], n).astype(np.int64) for x in _FIGURES), sizes], axis=1)
        often = np.bincount(place, minlength=self.known)
        distinct = np.flatnonzero(often)
        distinct = distinct[np.argsort(-often[distinct], kind="stable")]  # small numbers for the frequent ones
        index = np.zeros(self.known, np.int32)
        index[distinct] = np.arange(len(distinct))
        often, segments = often[distinct], index[place]
        links = table["n_links"][distinct]
        found, members = np.unique(self.pairs.data[ragged(table["start"][distinct], links)], return_inverse=True)
        times = np.zeros(len(found), np.int64)
        np.add.at(times, members, np.repeat(often, links))
        self._forget(kept, pairs)  # long segments are not kept
        return {"figures": figures, "digests": digests, "segments": segments, "sizes": links, "members": members, "pairs": found, "times": times}


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_level: str, pieces: str) -> Aligner:
    """One for each pair of vocabularies in a worker process."""
    key = (byte_level, pieces)
    if key not in _aligners:
        _aligners[key] = Aligner(byte_level, pieces)
    return _aligners[key]


def _groups(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows with equal values in ``by``, row by row, of batches that are sorted by them."""
    rows = (row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist())
    return groupby(rows, lambda row: tuple(row[x] for x in by))


def alignment(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    byte_level, pieces: paths of the vocabularies, readable on the executors.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "align")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    one = Aligner(byte_level, pieces)
    n_a, stripes = one.n_a, -(-one.n_b // STRIPE)
    cells = STRIPE * n_a

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each slice one row of its documents (stripe -1) and one for each stripe of its pairs."""
        code, number = aligner(byte_level, pieces), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                made = code.slice(part.column("text"))
                bounds = np.searchsorted(made["pairs"], np.arange(stripes + 1) * cells)
                full = np.flatnonzero(np.diff(bounds))
                first, last = bounds[full], bounds[full + 1]
                base, below = full * cells, len(full)
                own = made["pairs"] - np.repeat(base, last - first)
                out = lambda whole, each, t: pa.array([whole, *each], t)
                lone = lambda value, t: pa.array([value, *[None] * below], t)
                keys = pa.ListArray.from_arrays(pa.array([0, *[part.num_rows] * (below + 1)], pa.int32()), part.column("key"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * (below + 1), pa.int64()), out(-1, full.tolist(), pa.int32()), out(len(own), first.tolist(), pa.int32()),
                        out(None, [planes(own[x:y]) for x, y in zip(first, last, strict=True)], pa.binary()), out(None, [planes(made["times"][x:y]) for x, y in zip(first, last, strict=True)], pa.binary()),
                        keys, lone(made["digests"], pa.list_(pa.string())), *(lone(planes(made[x].ravel()), pa.binary()) for x in ("figures", "segments", "sizes", "members")),
                    ],
                    ["slice", "stripe", "first", "pairs", "times", "keys", "digests", "figures", "segments", "sizes", "members"],
                )
                number += 1

    shape = f"slice long, stripe int, first int, pairs binary, times binary, keys array<{kind}>, digests array<string>, figures binary, segments binary, sizes binary, members binary"
    stored = work.put(rows.mapInArrow(encoded, shape), "encoded")
    own, asked = stored.filter("stripe < 0"), stored.filter("stripe >= 0")
    lots = 1 + own.count() // TOGETHER

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of each stripe and lot."""
        _aligners.clear()  # their memory is needed here
        block = np.zeros(cells, np.int64)
        for (stripe, lot), group in _groups(batches, "stripe", "lot"):
            for row in group:
                np.add.at(block, numbers(row["pairs"]), numbers(row["times"]))
            found = np.flatnonzero(block)
            yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([lot], pa.int64()), pa.array([planes(found)], pa.binary()), pa.array([planes(block[found])], pa.binary())], ["stripe", "lot", "pairs", "times"])
            block[found] = 0

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For the pairs of each slice in a stripe: the corpus's count, and whether it is its B id's highest."""
        block = np.zeros(cells, np.int64)
        for _, group in _groups(batches, "stripe", "lot"):
            held = next(group)
            at = numbers(held["pairs"])
            block[at] = numbers(held["times"])
            highest = block.reshape(STRIPE, n_a).max(axis=1)
            for row in group:
                pair = numbers(row["pairs"])
                count = block[pair]
                yield pa.RecordBatch.from_arrays([pa.array([row["slice"]], pa.int64()), pa.array([row["first"]], pa.int32()), pa.array([planes(count)], pa.binary()), pa.array([np.packbits(count == highest[pair // n_a]).tobytes()], pa.binary())], ["slice", "first", "counts", "best"])
            block[at] = 0

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, "slice"):
            held = next(group)
            count, best = np.zeros(held["first"], np.int64), np.zeros(held["first"], np.int64)
            for row in group:
                found = numbers(row["counts"])
                span = slice(row["first"], row["first"] + len(found))
                count[span] = found
                best[span] = np.unpackbits(np.frombuffer(row["best"], np.uint8), count=len(found))
            figures = numbers(held["figures"]).reshape(-1, 5)
            members, sizes, segments = (numbers(held[x]) for x in ("members", "sizes", "segments"))
            sums = []
            for values in (best, count):
                over = np.append(0, np.cumsum(values[members]))
                ends = np.cumsum(sizes)
                each = over[ends] - over[ends - sizes]
                over = np.append(0, np.cumsum(each[segments]))
                ends = np.cumsum(figures[:, 4])
                sums.append(over[ends] - over[ends - figures[:, 4]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(held["keys"], to_arrow), *(pa.array(figures[:, k]) for k in range(4)), *map(pa.array, sums), pa.array(held["digests"], pa.string())],
                ["key", *_FIGURES, "n_best", "count_sum", "groups_sha256"],
            )

    to_arrow = to_arrow_type(rows.schema["key"].dataType)
    lot = F.pmod(F.xxhash64("slice"), F.lit(lots))
    dealt = lambda df, *by: df.repartition(*map(F.col, by))
    sums, shape = asked.select("stripe", lot.alias("lot"), "pairs", "times"), "stripe int, lot long, pairs binary, times binary"
    for level in range(1 if lots == 1 else 2):
        sums = sums if level == 0 else sums.withColumn("lot", F.lit(0).cast("long"))
        sums = dealt(sums, "stripe", "lot").sortWithinPartitions("stripe", "lot").mapInArrow(added, shape)
    counts = work.put(sums, "counts")
    blocks = counts.select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))).alias("lot"), F.lit(-1).cast("long").alias("slice"), F.lit(0).alias("first"), "pairs", "times")
    both = blocks.unionByName(asked.select("stripe", lot.alias("lot"), "slice", "first", "pairs", F.lit(None).cast("binary").alias("times")))
    answers = dealt(both, "stripe", "lot").sortWithinPartitions("stripe", "lot", "slice").mapInArrow(answered, "slice long, first int, counts binary, best binary")
    halves = own.select("slice", F.lit(0).alias("order"), "first", "keys", "digests", "figures", "segments", "sizes", "members")
    both = halves.unionByName(answers.withColumn("order", F.lit(1)), allowMissingColumns=True)
    names = ", ".join(f"{x} long" for x in (*_FIGURES, "n_best", "count_sum"))
    result = dealt(both, "slice").sortWithinPartitions("slice", "order").mapInArrow(scored, f"key {kind}, {names}, groups_sha256 string")
    result = work.put(result.withColumnRenamed("key", key), "scores")
    work.drop("encoded", "counts")
    return result
