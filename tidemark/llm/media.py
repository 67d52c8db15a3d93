"""Media columns: content-addressed payloads in tar shards, with metadata from header-only range reads.

A text becomes a payload (UTF-8, zero bytes up to a positive multiple of 64), stored losslessly as an 8-bit grey-scale
PNG of 64 samples a row, named by the SHA-256 of the payload. A task writes the payloads of its rows straight into tar
shards of the shared folder through file-system calls of Arrow, each digest once; only digests and places are
shuffled. Where equal digests of several tasks meet, the first place is the one that counts, so all rows of a digest
carry the same place; the others are left to a later compaction. A shard's name holds the attempt of its task, so a
repeated or speculative task never writes into the shard of another. Rows carry digest, shard, offset and length.

Metadata columns (width, height, depth) come from range reads of the 33 bytes of PNG signature and header at the
row's offset; features and digests come from reading whole payloads back, shard by shard.

Defined results: null texts are empty; equal texts have equal values; every row of the input has a row, with repeated or
null keys too; an empty table writes no shard. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, slices

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a shard after which a task begins another.
SHARD = 64 << 20
#: Digests whose places a task remembers; it forgets them all when it has more.
KNOWN = 200_000
#: Bytes of the PNG that hold its header.
HEADER = 33


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8")
    return raw + bytes(WIDTH - len(raw) % WIDTH if len(raw) % WIDTH or not raw else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_of(payload: bytes) -> bytes:
    """The payload as the samples of a grey-scale PNG."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # each line begins with the byte of its filter, none
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER bytes."""
    if len(head) < HEADER or head[:8] != SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not the header of a PNG")
    return struct.unpack(">IIB", head[16:25])


def samples_of(png: bytes) -> bytes:
    """The samples of a PNG written by png_of()."""
    width, height, depth = png_header(png[:HEADER])
    at, data = HEADER, []
    while at < len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        if kind == b"IDAT":
            data.append(png[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if depth != 8 or lines[:, 0].any():
        raise ValueError("not an unfiltered 8-bit image")
    return lines[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    """The 512 bytes before a member (ustar); sizes beyond 8 GB are written in base 256."""
    length = b"%011o\0" % size if size < 8 << 30 else b"\x80" + size.to_bytes(11, "big")
    head = bytearray(512)
    for at, value in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, length), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        head[at : at + len(value)] = value
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


def features(payload: bytes) -> str:
    """Mean, deviation, entropy and shares of letters, white space and non-ASCII of the samples."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    value = np.arange(256)
    mean = float((share * value).sum())
    deviation = float((share * (value - mean) ** 2).sum()) ** 0.5
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    letters = float(share[65:91].sum() + share[97:123].sum())
    return f"mean={mean:.4f};sd={deviation:.4f};bits={entropy:.4f};letters={letters:.4f};space={share[[9, 10, 11, 12, 13, 32]].sum():.4f};high={share[128:].sum():.4f}"


def place_media(docs: DataFrame, folder: str) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, digest, shard, offset, length: where its task has stored the PNG of its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        seen: dict[bytes, tuple] = {}  # places of digests of the partition
        stream, name, at, shards = None, None, 0, 0
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                found = []
                for text in part.column("text"):
                    text = text.as_py()
                    payload = payload_of(text)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in seen:
                        if len(seen) >= KNOWN:
                            seen.clear()  # some payloads are stored again; first_places() settles which one counts
                        if stream is None:
                            name, at, shards = f"{task.partitionId():06d}-{task.taskAttemptId()}-{shards}.tar", 0, shards + 1
                            stream = store.open_output_stream(f"{root}/{name}")
                        content = png_of(payload)
                        stream.write(tar_header(digest.hex(), len(content)))
                        stream.write(content)
                        stream.write(bytes(-len(content) % 512))
                        seen[digest] = (name, at + 512, len(content))
                        at += 512 + len(content) + -len(content) % 512
                    found.append((len(text.encode()), digest, *seen[digest]))
                    if at >= SHARD and stream is not None:
                        stream.write(bytes(1024))
                        stream.close()
                        stream = None
                kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
                columns = [pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if stream is not None:
            stream.write(bytes(1024))
            stream.close()

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, digest binary, shard string, offset long, length long")


def first_places(placed: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): one place for each digest."""
    first = placed.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return first.select("digest", "at.shard", "at.offset", "at.length")


def _ranges(batch: pa.RecordBatch, folder: str, size: int | None) -> Iterator[bytes]:
    """The bytes of each row's member, or its first ``size`` bytes, by range reads."""
    store, root = fs.FileSystem.from_uri(folder)
    name, file = None, None
    for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
        if shard != name:
            if file:
                file.close()
            name, file = shard, store.open_input_file(f"{root}/{shard}")
        yield bytes(file.read_at(min(length, size or length), offset))
    if file:
        file.close()


def with_header_columns(stored: DataFrame, folder: str) -> DataFrame:
    """stored with width, height and depth, read from the headers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [png_header(x) for x in _ranges(batch, folder, HEADER)]
            columns = [pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ([], [], []))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "width", "height", "depth"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema)
    return stored.mapInArrow(run, f"{schema}, width long, height long, depth long")


def with_payload_columns(stored: DataFrame, folder: str) -> DataFrame:
    """stored with what whole payloads give: payload_bytes, payload_sha256, tail_crc32, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in _ranges(batch, folder, None):
                payload = samples_of(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(media).hexdigest(), features(payload)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema)
    return stored.mapInArrow(run, f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, digest, shard, offset, media_bytes and all columns of the two reads.

    folder: where the shards go, in the default file system if it names none; by default one of the shared folder.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "media")
    folder = work.uri(folder or work.path("shards"))
    placed = work.put(place_media(docs, folder), "placed")
    stored = work.put(first_places(placed), "stored")
    # one task for a run of a shard's members: reads are sequential, payloads are read once
    ordered = stored.repartition("shard", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("shard", "offset")
    read = work.put(with_payload_columns(with_header_columns(ordered, folder), folder), "read")
    work.drop("stored")
    return placed.select("doc_id", "n_bytes", "digest").join(read.withColumnRenamed("length", "media_bytes"), "digest")


def digest_columns(columns: DataFrame) -> DataFrame:
    """The columns of the thin query."""
    return columns.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "shard", "offset")
