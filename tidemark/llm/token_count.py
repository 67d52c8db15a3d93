"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut into pre-tokens by the vocabulary's pattern; in each pre-token the adjacent pair of
lowest rank is popped from a heap and merged in a linked list until none is left. The count is the
number of initial symbols minus the number of merges; no identifiers are made. Counts of pre-tokens
already met are kept in a bounded table of the worker process.

Null and empty texts have 0 tokens. The string of an added token inside a text counts as one token,
as in the library the vocabulary comes from. Rows are independent, so ties, repeated rows, extra
columns and empty tables need nothing special; a null ``doc_id`` stays null.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of each table of known counts; a full table is emptied, which only costs time.
KNOWN = 400_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts tokens of texts under the merges of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.letters = byte_letters()
        ids = {x: k for k, x in enumerate(self.letters)}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            made = ids.setdefault(left + right, len(ids))
            self.ranks.setdefault((ids[left], ids[right]), (rank, made))
        added = sorted((x["content"] for x in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pattern = regex.compile(PATTERN)
        self.twice = re.compile(r"\s\s|^\s|\s$")
        self.tokens: dict[str, int] = {}
        self.spaced = _Counts(lambda piece: self.run(" " + piece))

    def merged(self, raw: bytes) -> int:
        """Tokens of one pre-token."""
        symbols, ranks = list(raw), self.ranks
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], k, a, b, found[1]) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (found := ranks.get((a, b)))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, k, a, b, made = heapq.heappop(heap)
            if symbols[k] != a or (right := after[k]) >= n or symbols[right] != b:
                continue  # one of the two has gone into another merge
            merges += 1
            symbols[k], symbols[right] = made, -1
            beyond = after[k] = after[right]
            if beyond < n:
                before[beyond] = k
                if found := ranks.get((made, symbols[beyond])):
                    heapq.heappush(heap, (found[0], k, made, symbols[beyond], found[1]))
            if (left := before[k]) >= 0 and (found := ranks.get((symbols[left], made))):
                heapq.heappush(heap, (found[0], left, symbols[left], made, found[1]))
        return n - merges

    def run(self, text: str) -> int:
        """Tokens of a text without added tokens, pre-token by pre-token."""
        total, known = 0, self.tokens
        for token in self.pattern.findall(text):
            count = known.get(token)
            if count is None:
                if len(known) >= KNOWN:
                    known.clear()
                count = self.merged(token.encode("utf-8", "surrogatepass"))
                if len(token) < 64:
                    known[token] = count
            total += count
        return total

    def plain(self, text: str) -> int:
        """As run(). Where no two white-space characters meet, every space starts a pre-token, so the pieces between spaces are counted one by one."""
        if self.twice.search(text):
            return self.run(text)
        first, *pieces = text.split(" ")
        return self.run(first) + sum(map(self.spaced.__getitem__, pieces))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(self.plain(x) for x in parts if x)


class _Counts(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        count = self.make(key)
        if len(key) < 64:
            self[key] = count
        return count


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One counter for each vocabulary in a worker process."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", limit: int = 512) -> DataFrame:
    """Per row: key, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    vocabulary: path of a byte-level BPE file, readable on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([count(x.as_py()) for x in batch.column(2)], pa.int64())],
                ["key", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
