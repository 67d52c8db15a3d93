"""Sampled segmentations over a SentencePiece vocabulary, and lossless decoding.

A text is normalised as the vocabulary wants it (a space in front, spaces as U+2581). Pieces hold
U+2581 at their beginning only, so the piece lattice falls apart at the start of each run of spaces, into one
lattice for each segment (a run of spaces and the word behind it). Forward filtering gives, per distinct
segment of a slice of text, the total weight of all paths to each node; backward sampling then draws a path from
the end: at a node the edge (i, piece) has probability ``forward(i) * weight(piece) / forward(node)``.

All distinct segments of a slice are worked on together: a trie of the pieces is walked from every character at
once, forward sums go character by character over all segments, and all occurrences are sampled together, one
edge each a step. A node's edges have 32-bit thresholds that depend on its segment alone, and a uniform draw is
a hash of the row key, the segment's place in the text and the step, so a row gets the same
segmentation to the bit wherever and whenever it is encoded. Nothing is kept from slice to slice.

The weight of a piece is Zipf's ``1 / (2.4 + rank)``, to the power ``alpha``: 0 draws all paths
alike, larger values prefer few frequent pieces. A character without a piece is spelled in byte pieces, as is a
literal U+2581 of the text; this makes decoding exact for every text.

Defined results: a null text is encoded as the empty text, which has no pieces; decoding gives the empty text.
A null key counts as one more key. Rows with equal key and text have equal pieces. Extra columns
are not read; an empty table gives an empty result. A text without spaces, however long, is one
segment: it takes time in proportion to its length, and about 150 bytes of memory a character.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix, slices, span_hashes

MARK = "▁"
#: Bytes of text whose distinct segments are found together.
SLICE = 1 << 20
#: Characters of distinct segments whose lattices are in memory together; a longer segment is alone.
BLOCK = 60_000
#: Where so few segments go on, the forward sums are made one character at a time; they are the same.
FEW = 24


def _utf8(code: np.ndarray) -> list[np.ndarray]:
    """The bytes of characters in UTF-8 from the last to the first of four; -1 where there is none."""
    lead = np.where(code < 0x80, code, np.where(code < 0x800, 0xC0 | code >> 6, np.where(code < 0x10000, 0xE0 | code >> 12, 0xF0 | code >> 18)))
    more = np.where(code < 0x80, 0, np.where(code < 0x800, 1, np.where(code < 0x10000, 2, 3)))
    return [np.where(more > k, 0x80 | (code >> 6 * k) & 0x3F, np.where(more == k, lead, -1)) for k in range(4)]


class Lattices:
    """The pieces of a vocabulary as a trie, their weights, and sampled paths through the lattices of texts."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.zeros(256, np.int32)
        self.bytes: list[bytes] = []
        self.piece: dict[str, tuple[int, float]] = {}
        ranked = []
        for k in range(model.get_piece_size()):
            name = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte[int(name[3:-1], 16)] = k
                self.bytes.append(bytes([int(name[3:-1], 16)]))
                continue
            special = model.is_control(k) or model.is_unknown(k)
            self.bytes.append(b"" if special else name.replace(MARK, " ").encode())
            if not special and name and MARK not in name.lstrip(MARK):
                ranked.append((-model.get_score(k), name, k))
        for rank, (_, name, k) in enumerate(sorted(ranked)):
            self.piece[name] = (k, (2.4 + rank) ** -alpha)
        self.spelled = (2.4 + len(ranked)) ** -alpha
        self.longest = max(map(len, self.piece), default=1)
        self._trie()

    def _trie(self) -> None:
        """Nodes by number; a transition (node, character) is looked up in a hash table of open addresses."""
        letters = sorted({c for name in self.piece for c in name})
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.letter[[0x20 if c == MARK else ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        number = {c: k + 1 for k, c in enumerate(letters)}
        self.fan = len(letters) + 1
        found: dict[int, int] = {}
        ids, weights = [-1], [0.0]
        for name, (k, w) in self.piece.items():
            at = 0
            for c in name:
                key = at * self.fan + number[c]
                if key not in found:
                    found[key] = len(ids)
                    ids.append(-1)
                    weights.append(0.0)
                at = found[key]
            ids[at], weights[at] = k, w
        self.ids, self.weights = np.asarray(ids, np.int32), np.asarray(weights)
        self.shift = 64 - max(4, (4 * len(found)).bit_length())
        self.keys, self.to = np.full((1 << (64 - self.shift)) + 64, -1, np.int64), np.zeros((1 << (64 - self.shift)) + 64, np.int32)
        keys = np.fromiter(found, np.int64, len(found))
        for key, slot in zip(keys.tolist(), self._slots(keys).tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot += 1
            self.keys[slot], self.to[slot] = key, found[key]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def _step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes behind a character; 0 where there is none."""
        keys = node.astype(np.int64) * self.fan + letter
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.to[slot], 0)
        going = np.flatnonzero((held != keys) & (held >= 0))
        while len(going):
            slot[going] += 1
            held = self.keys[slot[going]]
            same = held == keys[going]
            out[going[same]] = self.to[slot[going[same]]]
            going = going[~same & (held >= 0)]
        return out

    def _edges(self, letter: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, size, piece, weight) of every edge; left: characters of the segment from each character on.

        An edge of piece -1 is a character in bytes.
        """
        at = np.flatnonzero(letter)
        node = self._step(np.zeros(len(at), np.int32), letter[at])
        single = np.zeros(len(letter), bool)
        found = []
        for size in range(1, self.longest + 1):
            good = node > 0
            at, node = at[good], node[good]
            whole = np.flatnonzero(self.ids[node] >= 0)
            if size == 1:
                single[at[whole]] = True
            found.append((at[whole], np.full(len(whole), size, np.int32), self.ids[node[whole]], self.weights[node[whole]]))
            more = left[at] > size
            at, node = at[more], node[more]
            if not len(at):
                break
            node = self._step(node, letter[at + size])
        bare = np.flatnonzero(~single)
        found.append((bare, np.ones(len(bare), np.int32), np.full(len(bare), -1, np.int32), np.full(len(bare), self.spelled)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _paths(self, code: np.ndarray, size: np.ndarray, repeats: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of sampled paths one after the other, and how many each occurrence has.

        code: the characters of distinct segments one after the other; size: how many each has; repeats: occurrences
        of each, whose seeds are in the order of the segments.
        """
        # the longest segment first: those that go on to a depth are always the first ones; a node's number is
        # that of its depth's first node plus the segment's rank
        rank = np.empty(len(size), np.int64)
        order = np.argsort(-size, kind="stable")
        rank[order] = np.arange(len(size))
        own = np.repeat(np.arange(len(size)), size)
        depth = np.arange(len(code)) - (np.cumsum(size) - size)[own]
        going = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
        level = np.concatenate([[0], np.cumsum(going)])
        start, length, piece, weight = self._edges(self.letter[code], size[own] - depth)
        end = start + length - 1
        who, deep = rank[own[end]], depth[end]
        node = level[deep] + who
        at = np.argsort(node * 64 + (63 - length))
        length, piece, weight, who, deep, node = length[at], piece[at], weight[at], who[at], deep[at], node[at]
        edge_first = np.searchsorted(node, np.arange(len(code) + 1))
        value = self._forward(who, deep, length, weight, going, edge_first[level])
        # thresholds of a node's edges, from sums in the edges' order
        nth = (np.arange(len(node)) - edge_first[node]).astype(np.uint8)
        by_nth = np.argsort(nth, kind="stable")
        total, upto = np.zeros(len(code)), np.empty(len(node))
        for some in np.split(by_nth, np.cumsum(np.bincount(nth))[:-1]):
            here = node[some]
            total[here] += value[some]
            upto[some] = total[here]
        limit = np.minimum(np.floor(upto / total[node] * 2.0**32), 2.0**32 - 1).astype(np.uint64)
        key = (node.astype(np.uint64) << np.uint64(32)) | limit
        before = np.where(deep >= length, level[deep - length] + who, -1)
        letters = np.empty(len(code), np.int64)
        letters[level[depth] + rank[own]] = code
        raw = np.where(letters < 0x80, 1, np.where(letters < 0x800, 2, np.where(letters < 0x10000, 3, 4)))
        # backwards from the end of each occurrence
        at = np.repeat(level[size - 1] + rank, repeats)
        active, taken, drawn, step = np.arange(len(at)), np.zeros(len(at), np.int64), [], 0
        while len(active) > FEW or (len(active) and step < 2 * self.longest):
            u = mix(seed[active] + np.uint64(step)) >> np.uint64(32)
            edge = np.minimum(np.searchsorted(key, (at.astype(np.uint64) << np.uint64(32)) | u, side="right"), edge_first[at + 1] - 1)
            drawn.append((active, at, edge))
            at = before[edge]
            active, at = active[at >= 0], at[at >= 0]
            step += 1
        if len(active):  # the few longest paths, one after the other
            lists = [x.tolist() for x in (edge_first, limit, before)]
            for one, node in zip(active, at.tolist(), strict=True):
                drawn.append(self._walk(one, node, step, seed[one], *lists))
        for k, (who, at, edge) in enumerate(drawn):
            found = piece[edge]
            bare = found < 0
            many = np.where(bare, raw[at], 1)
            behind = taken[who]
            if len(who) > 1 and who[0] == who[-1]:  # the rest of one path
                behind = behind + np.cumsum(many) - many
                taken[who[0]] += many.sum()
            else:
                taken[who] += many
            drawn[k] = (who, found, behind, letters[at[bare]])
        ends = np.cumsum(taken)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for who, found, behind, code in drawn:
            place = ends[who] - 1 - behind
            out[place] = found
            place = place[found < 0]
            for back, one in enumerate(_utf8(code)):  # the last byte first
                some = one >= 0
                out[place[some] - back] = self.byte[one[some]]
        return out, taken

    @staticmethod
    def _walk(one: int, at: int, step: int, seed: np.uint64, edge_first: list[int], limit: list[int], before: list[int]) -> tuple[np.ndarray, ...]:
        """The rest of one path: its occurrence, nodes and edges."""
        nodes, edges, draws = [], [], []
        while at >= 0:
            if not draws:
                draws = (mix(seed + np.arange(step, step + 4096, dtype=np.uint64)) >> np.uint64(32)).tolist()[::-1]
            edge = min(bisect_right(limit, draws.pop(), edge_first[at], edge_first[at + 1]), edge_first[at + 1] - 1)
            nodes.append(at)
            edges.append(edge)
            at, step = before[edge], step + 1
        return np.full(len(nodes), one), np.asarray(nodes), np.asarray(edges)

    def _forward(self, who: np.ndarray, deep: np.ndarray, length: np.ndarray, weight: np.ndarray, going: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """forward(start) * weight of each edge, up to one factor for each node.

        The edges are in the order of (deep, who), those of a depth begin at its cut; going: how many segments have
        the depth. Of a segment only the last sums are at hand, in a ring; where they leave the range
        of doubles all are divided by the newest.
        """
        ring = self.longest + 1
        held = np.zeros((int(going[0]) if len(going) else 0, ring))
        held[:, 0] = 1
        value = np.empty(len(who))
        j = 0
        while j < len(going) and (going[j] > FEW or j < 2 * ring):
            a, b, n = cuts[j], cuts[j + 1], going[j]
            value[a:b] = held[who[a:b], (j + 1 - length[a:b]) % ring] * weight[a:b]
            total = np.bincount(who[a:b], value[a:b], n)
            held[:n, (j + 1) % ring] = total
            off = np.flatnonzero((total < 1e-100) | (total > 1e100))
            if len(off):
                held[off] /= total[off, None]
            j += 1
        if j < len(going):  # the few longest segments, one after the other
            order = cuts[j] + np.argsort(who[cuts[j] :], kind="stable")
            edges = np.searchsorted(who[order], np.arange(going[j] + 1))
            for k in range(int(going[j])):
                some = order[edges[k] : edges[k + 1]]
                value[some] = self._forward_one(deep[some].tolist(), length[some].tolist(), weight[some].tolist(), held[k].tolist())
        return value

    def _forward_one(self, deep: list[int], length: list[int], weight: list[float], held: list[float]) -> list[float]:
        """The values of the edges of one segment, in order, from the ring held on."""
        ring, out = self.longest + 1, []
        now, total = deep[0], 0.0
        for d, n, w in zip(deep, length, weight, strict=True):
            if d != now:
                held[(now + 1) % ring] = total
                if total < 1e-100 or total > 1e100:
                    held = [x / total for x in held]
                now, total = d, 0.0
            x = held[(d + 1 - n) % ring] * w
            total += x
            out.append(x)
        return out

    def encode(self, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts one after the other, and the n + 1 offsets of the texts."""
        full = [" " + x if x else "" for x in texts]
        data = np.frombuffer("".join(full).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x.encode()) for x in full])]).astype(np.int64)
        space = data == 0x20
        fresh = space & ~np.append(False, space[:-1])
        fresh[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(data))
        text = np.searchsorted(offsets, starts, side="right") - 1
        position = np.arange(len(starts)) - np.searchsorted(starts, offsets[:-1])[text]
        seed = mix(keys[text] + position.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        where, index = self._distinct(data, starts, ends)
        order = np.argsort(index, kind="stable")
        repeats = np.bincount(index, minlength=len(where))
        # characters of the distinct segments
        a, n = starts[where], (ends - starts)[where]
        flat = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        picked = data[flat]
        code = np.frombuffer(picked.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        chars = np.add.reduceat((picked & 0xC0) != 0x80, np.cumsum(n) - n, dtype=np.int64) if len(n) else np.zeros(0, np.int64)
        upto, met = np.concatenate([[0], np.cumsum(chars)]), np.concatenate([[0], np.cumsum(repeats)])
        parts, taken, lo = [], np.empty(len(starts), np.int64), 0
        while lo < len(chars):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + BLOCK, side="right")) - 1)
            some = order[met[lo] : met[hi]]
            found, count = self._paths(code[upto[lo] : upto[hi]], chars[lo:hi], repeats[lo:hi], seed[some])
            parts.append(found)
            taken[some] = count
            lo = hi
        # from the order of distinct segments to that of the texts
        made = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        there = np.cumsum(taken[order]) - taken[order]
        source = np.empty(len(starts), np.int64)
        source[order] = there
        begin = np.cumsum(taken) - taken
        out = made[np.repeat(source - begin, taken) + np.arange(len(made))]
        return out, np.concatenate([[0], np.cumsum(np.bincount(text, taken, len(texts)))]).astype(np.int64)

    @staticmethod
    def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each distinct segment first occurs, and the distinct segment of each occurrence."""
        _, where, index = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        size = ends - starts
        first = where[index]
        if len(starts) and (size != size[first]).any() or (data[np.repeat(starts[first] - starts, size) + np.arange(len(data))] != data).any():
            # equal hashes of different segments
            found: dict[bytes, int] = {}
            index = np.asarray([found.setdefault(data[a:b].tobytes(), len(found)) for a, b in zip(starts, ends, strict=True)])
            where = np.unique(index, return_index=True)[1]
        return where, index

    def decode(self, pieces: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, pieces))[1:].decode("utf-8")


_lattices: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, alpha: float) -> Lattices:
    """One trie for each vocabulary in a worker process."""
    if (path, alpha) not in _lattices:
        _lattices[path, alpha] = Lattices(path, alpha)
    return _lattices[path, alpha]


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.lit(seed), F.col("doc_id")).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, vocabulary: str, alpha: float = 0.5, seed: int = 1) -> DataFrame:
    """Per row: doc_id, pieces (array of identifiers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lattices(vocabulary, alpha)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                pieces, first = table.encode(part.column("text").to_pylist(), part.column("key").to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(pieces))], ["doc_id", "pieces"])

    rows = _rows(docs, seed)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, pieces array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of encode(): doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lattices(vocabulary, 0.5)
        for batch in batches:
            texts = [table.decode(x.as_py() or []) for x in batch.column("pieces")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "pieces").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, vocabulary: str, alpha: float = 0.5, seed: int = 1) -> DataFrame:
    """Per row: doc_id, n_bytes, n_pieces, pieces_sha256 (of the identifiers, 4 bytes each), lossless (the pieces decode to the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lattices(vocabulary, alpha)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = part.column("text").to_pylist()
                pieces, first = table.encode(texts, part.column("key").to_numpy().view(np.uint64))
                own = [pieces[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
                columns = [
                    part.column("doc_id"),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in own], pa.string()),
                    pa.array([table.decode(x.tolist()) == text for x, text in zip(own, texts, strict=True)], pa.bool_()),
                    pa.array([len(text.encode()) for text in texts], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "pieces_sha256", "lossless", "n_bytes"])

    rows = _rows(docs, seed)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_pieces long, pieces_sha256 string, lossless boolean, n_bytes long")
