"""What the operators share: tables in the shared folder, and words of Arrow text columns as hashes.

Words are found and hashed with whole-array numpy operations on the bytes of an Arrow column, in
blocks of bounded size, so no operator loops over words in Python.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

#: Bytes of text whose words are hashed at a time.
BLOCK = 1 << 19
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder; any other session is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tidemark.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.tidemark.dir", made)  # the other setting is fixed once the session runs
    return made


class Workspace:
    """Intermediate tables of one run, written to the shared folder and read again.

    A written table cuts the lineage: when an executor is lost, nothing before it is repeated.
    slim: the shuffle files behind a table go once it is written, not when the driver collects its garbage.
    """

    def __init__(self, spark: SparkSession, purpose: str, slim: bool = False):
        self.spark = spark
        self.slim = slim
        self.root = f"{shared_dir(spark)}/tidemark-{purpose}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        before = self.spark.conf.get(_CLEANUP, None)
        try:
            if self.slim:
                self.spark.conf.set(_CLEANUP, "true")
            df.write.mode("overwrite").partitionBy(*partition_by).parquet(self.path(name)) if partition_by else df.write.mode("overwrite").parquet(self.path(name))
        finally:
            if self.slim:
                self.spark.conf.set(_CLEANUP, before) if before is not None else self.spark.conf.unset(_CLEANUP)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def clear(self) -> None:
        """Drops all tables of the run."""
        self._delete(self.root)

    def uri(self, path: str) -> str:
        """The path with its file system, for readers and writers outside Hadoop."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        whole = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
        return re.sub(r"^file:/(?!/)", "file:///", whole)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def met_by_sorting(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the documents: neither is broadcast through the driver, whatever size Spark guesses from compressed files."""
    return left.hint("merge").join(right.hint("merge"), on, how)


# ---------------------------------------------------------------------------------------------
# words as hashes

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK + 1)
        for k, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the n + 1 offsets of the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (n + 1 entries).

    separator: 256 booleans; a word is a maximal run of other bytes inside one text.
    """
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separator[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (edge[:-1] | ~inside[:-2]))
    ends = np.flatnonzero(inside[1:-1] & (edge[1:] | ~inside[2:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans don't overlap and are in order."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        piece = data[base : ends[last - 1]]
        powers, inverse = _power_tables(len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * powers[: len(piece)], out=sums[1:])
        a, b = starts[first:last] - base, ends[first:last] - base
        out[first:last] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        first = last
    return out


def byte_class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: The separators of ``[^\x20\x09-\x0D]+``.
SPACES = byte_class(b" \t\n\v\f\r")
#: Every ASCII byte but letters and digits; bytes of other characters belong to words.
NOT_WORD = byte_class(bytes(b for b in range(128) if not chr(b).isalnum()))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    if len(values) < 2:
        return values.copy()
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])]


def hashed_words(column: pa.Array, separator: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and each text's first index (n + 1 entries)."""
    data, offsets = text_bytes(column)
    data = ascii_lower(data)
    starts, ends, first = word_spans(data, offsets, separator)
    return span_hashes(data, starts, ends), first


def shingle_sets(column: pa.Array, width: int, separator: np.ndarray = SPACES) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes (int64) of its shingles of ``width`` words.

    A text of fewer words has its whole sequence as one shingle; without words the set is empty.
    """
    words, first = hashed_words(column, separator)
    odd = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)  # of one factor's multiples, a b c b a and b a c a b would be one
    full = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        full += words[k : k + len(full)] * odd[k]
    full = mix(full)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= width:
            yield distinct(full[lo : hi - width + 1].view(np.int64))
        elif hi > lo:
            short = np.full(1, hi - lo, np.uint64)  # arrays wrap around without a warning
            for k in range(hi - lo):
                short = mix(short + words[lo + k : lo + k + 1] * odd[k])
            yield short.view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def slices(batch: pa.RecordBatch, column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about ``limit`` bytes at most, or one text."""
    if batch.num_rows == 0:
        return
    ends = text_bytes(batch.column(column))[1][1:]
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
