"""Vector code compression: codebooks for the parts of vectors by filtering Lloyd rounds.

Method
    1. Vectors become integers and are cut into equal parts. Every task builds, for each part and each run of
       vectors of ``CELLS`` components, a kd-tree whose nodes hold the box, the sum and the count of their points; the trees are
       written to the shared folder, so the rounds neither build them again nor lose them with an executor.
    2. A round takes the codebooks down each tree, level by level. The entry nearest to a box's centre eliminates every entry
       that no point of the box is nearer to; when one is left, the node's sum and count go to it at once, else
       the leaf's points are compared with the entries left. Sums and counts are added by entry in Spark.
    3. After the last round the same descent gives each vector's entries and distances.

All arithmetic is on integers that floats hold exactly, so ties go to the lower index whatever the trees are. The driver holds
the codebooks (entries x components) only. Of a column of labels, the sums of errors are joined back by label.

Defined results: vectors that are null or hold null or non-finite components are dropped. Shorter vectors, and lengths that are
no multiple of the parts, are filled up with zeros. Null keys come last when the first codebook is chosen, repeated
keys by their vectors. With fewer vectors than entries the codebooks are as small. An empty table gives an
empty result. Extra columns are not read. Components of such a size that squared distances pass 2^53 raise a ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace
from tidemark.llm.vectors import integers, kept, shape

#: Components of the vectors of one tree, and points of a leaf.
CELLS, LEAF = 1 << 20, 32


class Tree:
    """A kd-tree of integer points with the boxes, sums and counts of its nodes.

    Every node's range of points is halved, so the shape follows from the number of points: node k of a level has the
    nodes 2k and 2k + 1 below it.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """points: in the order of the tree; order: their rows; nodes: by level low, high and sum."""
        self.points, self.order, self.nodes = points, order, nodes
        self.bounds = _halves(len(points))

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        order, levels = np.arange(len(points)), _halves(len(points))
        for bounds, below in zip(levels, levels[1:], strict=False):
            for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                own = points[order[lo:hi]]
                axis = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if own.shape[1] else 0
                if own.shape[1]:
                    order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], below[2 * k + 1] - lo)]
        points = points[order]
        starts = levels[-1][:-1]
        nodes = [(np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts), np.add.reduceat(points, starts))]
        for _ in levels[1:]:
            low, high, total = nodes[0]
            nodes.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), total[::2] + total[1::2]))
        return cls(points, order, nodes)

    def pack(self) -> bytes:
        """Points and boxes in 32 bits, sums in 64."""
        pieces = [self.points.astype("<i4"), self.order.astype("<i4")]
        for low, high, total in self.nodes:
            pieces += [low.astype("<i4"), high.astype("<i4"), total.astype("<i8")]
        return b"".join(x.tobytes() for x in pieces)

    @classmethod
    def unpack(cls, raw: bytes, n: int, width: int) -> Tree:
        at = 0

        def take(kind: str, *shape: int) -> np.ndarray:
            nonlocal at
            size = int(np.prod(shape))
            found = np.frombuffer(raw, kind, size, at).reshape(shape)
            at += found.nbytes
            return found

        points, order, nodes = take("<i4", n, width).astype(np.float64), take("<i4", n), []
        for bounds in _halves(n):
            k = len(bounds) - 1
            nodes.append((take("<i4", k, width).astype(np.float64), take("<i4", k, width).astype(np.float64), take("<i8", k, width)))
        return cls(points, order, nodes)

    def descend(self, book: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], list[tuple[int, int, np.ndarray]]]:
        """Where the entries of a codebook lead: (level, nodes, their one entry), and (from, to, entries left) of leaves.

        For a node with centre c and half widths h an entry z is nowhere nearer than z* if max over the box of
        |x - z*|^2 - |x - z|^2 = 2 c(z - z*) + 2 h|z - z*| + |z*|^2 - |z|^2 is negative, or 0 and z has the higher index.
        """
        whole, leaves = [], []
        squares = (book * book).sum(axis=1)
        index = np.arange(len(book))
        at, left = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
        for level, (low, high, _) in enumerate(self.nodes):
            twice, width = low[at] + high[at], high[at] - low[at]
            far = squares - twice @ book.T
            best = np.where(left, far, np.inf).argmin(axis=1)
            for z in np.unique(best):
                of = np.flatnonzero(best == z)
                most = far[of, z][:, None] - far[of] + width[of] @ np.abs(book - book[z]).T
                left[of] &= (most > 0) | ((most == 0) & (index <= z))
            done = left.sum(axis=1) == 1
            if done.any():
                whole.append((level, at[done], best[done]))
            at, left = at[~done], left[~done]
            if level + 1 < len(self.nodes):
                at, left = np.repeat(2 * at, 2) + np.tile([0, 1], len(at)), np.repeat(left, 2, axis=0)
        bounds = self.bounds[-1]
        for k, row in zip(at, left, strict=True):
            leaves.append((int(bounds[k]), int(bounds[k + 1]), np.flatnonzero(row)))
        return whole, leaves

    def _nearest(self, lo: int, hi: int, book: np.ndarray, squares: np.ndarray, entries: np.ndarray) -> np.ndarray:
        return entries[(squares[entries] - 2 * (self.points[lo:hi] @ book[entries].T)).argmin(axis=1)]

    def sums(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry the sum and the count of the points nearest to it."""
        total, count = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
        squares = (book * book).sum(axis=1)
        whole, leaves = self.descend(book)
        for level, nodes, entry in whole:
            np.add.at(total, entry, self.nodes[level][2][nodes])
            np.add.at(count, entry, np.diff(self.bounds[level])[nodes])
        for lo, hi, entries in leaves:
            entry = self._nearest(lo, hi, book, squares, entries)
            np.add.at(total, entry, self.points[lo:hi].astype(np.int64))
            np.add.at(count, entry, 1)
        return total, count

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row its entry and the squared distance to it."""
        found = np.zeros(len(self.points), np.int64)
        squares = (book * book).sum(axis=1)
        whole, leaves = self.descend(book)
        for level, nodes, entry in whole:
            for k, z in zip(nodes, entry, strict=True):
                found[self.bounds[level][k] : self.bounds[level][k + 1]] = z
        for lo, hi, entries in leaves:
            found[lo:hi] = self._nearest(lo, hi, book, squares, entries)
        far = ((self.points - book[found]) ** 2).sum(axis=1)
        entry, distance = np.empty_like(found), np.empty(len(found), np.int64)
        entry[self.order], distance[self.order] = found, far
        return entry, distance


def _halves(n: int) -> list[np.ndarray]:
    """Bounds of the nodes' ranges, level by level, until leaves have LEAF points at most."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > LEAF:
        bounds = levels[-1]
        out = np.empty(2 * len(bounds) - 1, np.int64)
        out[::2], out[1::2] = bounds, (bounds[:-1] + bounds[1:]) // 2
        levels.append(out)
    return levels


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", factor: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """Per kept row: key, code (two hex digits a part), error, label_error (errors of all rows of the label), codebooks_sha256.

    entries: 256 at most, so that an index has two hex digits.
    """
    if entries > 256:
        raise ValueError("an index has two hex digits")
    spark = vectors.sparkSession
    work = Workspace(spark, "codes")
    rows = kept(vectors, column).select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(column).alias("vector"))
    kinds = {x: rows.schema[x].dataType.simpleString() for x in ("key", "label")}
    _, longest, size = shape(rows, "vector", factor)
    width = -(-longest // parts)
    if (2 * size) ** 2 * max(1, width) * 4 >= 1 << 53 or size >= 1 << 31:
        raise ValueError("components are too large for exact squared distances")
    step = max(LEAF, CELLS // max(1, parts * width))

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                whole = integers(part.column("vector"), parts * width, factor)
                trees = [Tree.build(x).pack() for x in np.split(whole, parts, axis=1)]
                one = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), *(pa.ListArray.from_arrays(one, part.column(x)) for x in ("key", "label")), pa.array([trees], pa.list_(pa.binary()))], ["n", "keys", "labels", "trees"])

    held = work.put(rows.mapInArrow(built, f"n int, keys array<{kinds['key']}>, labels array<{kinds['label']}>, trees array<binary>"), "trees")
    first = rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    start = integers(first.column("vector").combine_chunks(), parts * width, factor) if len(first) else np.zeros((0, parts * width))
    books = np.split(start, parts, axis=1)

    def trees_of(batch: pa.RecordBatch) -> Iterator[tuple[int, list[Tree]]]:
        for k in range(batch.num_rows):
            n = batch.column("n")[k].as_py()
            yield k, [Tree.unpack(x, n, width) for x in batch.column("trees")[k].as_py()]

    def summed(books: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One row for each part and entry of the task."""
            total, count = np.zeros((parts, len(books[0]), width), np.int64), np.zeros((parts, len(books[0])), np.int64)
            for batch in batches:
                for _, trees in trees_of(batch):
                    for part, tree in enumerate(trees):
                        found = tree.sums(books[part])
                        total[part] += found[0]
                        count[part] += found[1]
            part, entry = np.nonzero(count)
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(total[part, entry].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), sums], ["part", "entry", "n", "sums"])

        return run

    for _ in range(rounds if len(start) else 0):
        found = held.select("n", "trees").mapInArrow(summed(books), "part int, entry int, n long, sums array<long>")
        table = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[k]) for k in range(width))).cast("array<long>").alias("sums")).collect()  # parts x entries rows
        books = [x.copy() for x in books]
        for row in table:
            books[row.part][row.entry] = [x // row.n for x in row.sums]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, trees in trees_of(batch):
                found = [tree.assign(book) for tree, book in zip(trees, books, strict=True)]
                text = np.stack([x[0] for x in found], axis=1).astype(np.uint8).tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("keys")[k].values, batch.column("labels")[k].values, pa.array([text[x : x + 2 * parts] for x in range(0, len(text), 2 * parts)], pa.string()), pa.array(sum(x[1] for x in found))],
                    ["key", "label", "code", "error"],
                )

    whole = ",".join(str(int(x)) for book in books for x in book.ravel())
    out = work.put(held.mapInArrow(coded, f"key {kinds['key']}, label {kinds['label']}, code string, error long"), "coded")
    totals = work.put(out.groupBy("label").agg(F.sum("error").alias("label_error")), "totals").withColumnRenamed("label", "other")
    work.drop("trees")
    digest = hashlib.sha256(whole.encode()).hexdigest()
    return out.join(totals, F.col("label").eqNullSafe(F.col("other"))).select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(parts: int = 4, entries: int = 256, rounds: int = 4, factor: int = 1024) -> str:
    """The rounds one after the other; every distance of a part to every entry. Vectors are of one length that the parts divide."""
    near = """SELECT p.id, p.part, p.x, arg_min(b.entry, d * 256 + b.entry) AS entry, min(d) AS d
        FROM pieces p JOIN {books} b USING (part), LATERAL (SELECT list_sum(list_transform(list_zip(p.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d)
        GROUP BY ALL"""
    steps = [f"""WITH sound AS (
        SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor({factor} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pieces AS MATERIALIZED (
        SELECT id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x FROM sound, range({parts}) r(part)
    ), book0 AS MATERIALIZED (SELECT part, id - 1 AS entry, x FROM pieces WHERE id <= {entries})"""]
    for k in range(rounds):
        steps.append(f"""near{k} AS MATERIALIZED ({near.format(books=f"book{k}").replace("GROUP BY ALL", "GROUP BY p.id, p.part, p.x")}
    ), spread{k} AS (
        SELECT part, entry, k, floor_div FROM (SELECT part, entry, k, sum(x[k]) AS s, count(*) AS n FROM near{k}, range(1, 1 + len(x)) r(k) GROUP BY part, entry, k), LATERAL (SELECT (s - ((s % n) + n) % n) // n AS floor_div)
    ), moved{k} AS (SELECT part, entry, list(floor_div::BIGINT ORDER BY k) AS x FROM spread{k} GROUP BY part, entry
    ), book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN moved{k} m USING (part, entry))""")
    steps.append(f"""last AS MATERIALIZED ({near.format(books=f"book{rounds}").replace("GROUP BY ALL", "GROUP BY p.id, p.part, p.x")}
    ), coded AS (SELECT id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM last GROUP BY id
    ), digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN sound USING (id), digest""")
    return ", ".join(steps)


ORACLE = _oracle()
