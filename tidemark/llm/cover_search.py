"""Exact top-k search by inner product: queries and data in cover trees, searched together.

Method
    1. Vectors become integers. Rows are ordered by the nearest of ``PIVOTS`` vectors and dealt by range, so that near rows
       lie together; each run of rows of a task becomes a block with a cover tree, written to the shared
       folder. A row's number is its block and its place in the tree.
    2. The queries are rows of those blocks. Within its own block each query gets a first kth score; queries are then dealt by
       range like the rows and become cover trees too.
    3. Queries go out in passes of at most ``PASS`` bytes; their trees are broadcast, and every block is
       searched for all of a pass: pairs of a query node and a data node, best bound first. The inner product
       of any two of their points is at most c_q c_r + |c_q| R_r + |c_r| R_q + R_q R_r, with centres c and covering
       radii R. Where that is below the worst kth score of the node's queries, the pair is dropped; pairs of leaves are
       compared point by point. A task gives its best k of each query, Spark the best k of those.

A cover tree node's children lie at least half its radius apart and cover its points within half its radius. Where that would
need more than one child for ``THIN`` points, distances tell nothing, and the node stays one leaf.

Defined results: vectors that are null or hold null or non-finite components take no part. Shorter vectors are filled up with
zeros. Ties go to the smaller key, null keys last, then to either row, which shows nowhere. A row isn't its own
candidate, but others of the same key are; repeated query rows have results each. A null key is no query if the condition on it is
null. With fewer candidates than k all are given. An empty table gives an empty result. Extra columns are not
read. Components of such a size that products pass 2^53 raise a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace
from tidemark.llm.vectors import integers, kept, shape

#: Vectors that order the rows; rows of a block; points of a leaf; points for each child at least; bytes of the
#: queries of a pass; scores compared at a time.
PIVOTS, ROWS, LEAF, THIN, PASS, SCORES = 64, 4096, 64, 16, 32 << 20, 1 << 20
_LAST = np.iinfo(np.int64).max


class CoverTree:
    """Points in the order of the tree; by node its centre (a place), radius, range of places and children."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray):
        self.points, self.nodes = points, nodes
        self.centres = points[nodes["centre"]]
        self.norms = np.sqrt((self.centres**2).sum(axis=1))

    NODE = np.dtype([("centre", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("child", "<i4"), ("last", "<i4"), ("radius", "<f8")])

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[CoverTree, np.ndarray]:
        """The tree, and the rows of the points in its order."""

        def distance(centre: int, members: np.ndarray) -> np.ndarray:
            return np.sqrt(((points[members] - points[centre]) ** 2).sum(axis=1))

        def cover(centre: int, members: np.ndarray, far: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
            """Children (centre, members, their distances); none where too many would be needed."""
            reach, found = far.max() / 2, []
            near = far <= reach
            found.append((centre, members[near], far[near]))
            rest, left = members[~near], far[~near]
            while len(rest):
                if len(found) * THIN >= len(members):
                    return []
                centre = rest[int(left.argmax())]
                far = distance(centre, rest)
                near = far <= reach
                found.append((centre, rest[near], far[near]))
                rest, left = rest[~near], np.minimum(left, far)[~near]
            return found

        whole = np.arange(len(points))
        nodes, order, level = [], np.empty(len(points), np.int64), [(0, whole, distance(0, whole), 0)]
        nodes.append([0, 0, len(points), 0, 0, 0.0])
        at = 0
        while level:
            below = []
            for centre, members, far, lo in level:
                node = nodes[at]
                node[5] = float(far.max())
                order[lo : lo + len(members)] = members
                children = cover(centre, members, far) if len(members) > LEAF and node[5] > 0 else []
                node[3] = len(nodes)
                for child, own, near in children:
                    nodes.append([child, lo, lo + len(own), 0, 0, 0.0])
                    below.append((child, own, near, lo))
                    lo += len(own)
                node[4] = len(nodes)
                at += 1
            level = below
        place = np.empty(len(points), np.int64)
        place[order] = whole
        made = np.array([tuple(x) for x in nodes], cls.NODE)
        made["centre"] = place[made["centre"]]
        made["radius"] *= 1 + 1e-12
        return cls(points[order], made), order

    def pack(self, kind: str) -> tuple[bytes, bytes]:
        return self.points.astype(kind).tobytes(), self.nodes.tobytes()

    @classmethod
    def unpack(cls, points: bytes, nodes: bytes, width: int, kind: str) -> CoverTree:
        found = np.frombuffer(nodes, cls.NODE)
        return cls(np.frombuffer(points, kind).reshape(int(found["hi"][0]), width).astype(np.float64), found)


class Best:
    """The best k of each of n queries: scores, keys, null flags and rows, in order."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        """least: scores below which nothing is wanted."""
        self.score = np.full((n, k), -np.inf)
        self.key, self.null, self.row = np.full((n, k), _LAST), np.ones((n, k), bool), np.full((n, k), -1)
        self.least = np.full(n, -np.inf) if least is None else least
        self.worst = self.least.copy()

    def offer(self, query: np.ndarray, score: np.ndarray, key: np.ndarray, null: np.ndarray, row: np.ndarray) -> None:
        k = self.score.shape[1]
        own = np.unique(query)
        of = np.concatenate([np.repeat(own, k), query])
        columns = [np.concatenate([x[own].ravel(), y]) for x, y in ((self.score, score), (self.key, key), (self.null, null), (self.row, row))]
        order = np.lexsort((columns[3], columns[1], columns[2], -columns[0], of))
        first = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))
        picked = order[(first[:, None] + np.arange(k)).ravel()]
        self.score[own], self.key[own], self.null[own], self.row[own] = (x[picked].reshape(-1, k) for x in columns)
        self.worst[own] = np.maximum(self.least[own], self.score[own, -1])


class Block:
    """The rows of a block: tree, keys in its order, and the number of the first row."""

    def __init__(self, tree: CoverTree, keys: np.ndarray, nulls: np.ndarray, base: int):
        self.tree, self.keys, self.nulls, self.base = tree, keys, nulls, base


def search(queries: CoverTree, rows: np.ndarray, block: Block, best: Best, first: int = 0) -> int:
    """Offers the points of the block to the queries (rows: their numbers; first: the place in best of the first). Gives the number of compared pairs."""
    data, compared = block.tree, 0

    def bounds(q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Of the inner products of every pair of nodes; a little more, as floats round."""
        rq, rr, nq, nr = queries.nodes["radius"][q], data.nodes["radius"][r], queries.norms[q], data.norms[r]
        found = queries.centres[q] @ data.centres[r].T + nq[:, None] * rr + rq[:, None] * (nr + rr)
        return found + 1e-9 * (nq[:, None] + rq[:, None] + 1) * (nr + rr + 1)

    def compare(q: np.void, r: np.void) -> int:
        n, step = int(r["hi"] - r["lo"]), max(1, SCORES // int(r["hi"] - r["lo"]))
        points, keys, nulls = data.points[r["lo"] : r["hi"]], block.keys[r["lo"] : r["hi"]], block.nulls[r["lo"] : r["hi"]]
        k = best.score.shape[1]
        for lo in range(q["lo"], q["hi"], step):
            hi = min(lo + step, int(q["hi"]))
            own = slice(first + lo, first + hi)
            score = queries.points[lo:hi] @ points.T
            place = rows[lo:hi] - block.base - int(r["lo"])
            self_at = np.flatnonzero((place >= 0) & (place < n))
            score[self_at, place[self_at]] = -np.inf
            least = best.worst[own]
            if not (score.max(axis=1) >= least).any():
                continue
            wanted = score >= least[:, None]
            if n > k and wanted.sum() > 4 * k * (hi - lo):
                wanted &= score >= np.partition(score, n - k, axis=1)[:, n - k][:, None]
            # of those that tie with the kth so far, only smaller keys
            full = best.score[own, -1] == least
            wanted &= (score > least[:, None]) | ~full[:, None] | (keys <= best.key[own, -1][:, None])
            wanted &= score > -np.inf
            at, of = np.nonzero(wanted)
            if len(at):
                best.offer(first + lo + at, score[at, of], keys[of], nulls[of], block.base + int(r["lo"]) + of)
        return n * int(q["hi"] - q["lo"])

    def worst(q: int) -> float:
        node = queries.nodes[q]
        return best.worst[first + node["lo"] : first + node["hi"]].min()

    open_pairs = [(0, 0, float(bounds(np.array([0]), np.array([0]))[0, 0]))]
    while open_pairs:
        q, r, bound = open_pairs.pop()
        if bound < worst(q):
            continue
        a, b = queries.nodes[q], data.nodes[r]
        below = [np.arange(x["child"], x["last"]) for x in (a, b)]
        if not len(below[0]) and not len(below[1]):
            compared += compare(a, b)
            continue
        ours, theirs = (x if len(x) else np.array([node]) for x, node in zip(below, (q, r), strict=True))
        table = bounds(ours, theirs)
        least = np.array([worst(x) for x in ours])
        x, y = np.nonzero(table >= least[:, None])
        order = np.argsort(table[x, y], kind="stable")
        open_pairs += zip(ours[x[order]].tolist(), theirs[y[order]].tolist(), table[x[order], y[order]].tolist(), strict=True)
    return compared


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", column: str = "embedding", factor: int = 256) -> DataFrame:
    """Per query row: query_id, rank (from 1), key, score; candidates are all rows but the query's own.

    is_query: a condition on the rows.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "search")
    rows = kept(vectors, column).select(F.col(key).cast("long").alias("key"), F.col(column).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n, width, size = shape(rows, "vector", factor)
    if size * size * max(1, width) >= 1 << 53 or size >= 1 << 31:
        raise ValueError("components are too large for exact inner products")
    kind = "<i2" if size < 1 << 15 else "<i4"
    per_block = max(1, min(ROWS, (32 << 20) // (8 * max(1, width))))
    some = rows.orderBy(F.xxhash64("vector"), "key").limit(PIVOTS).select("vector").toArrow()  # a fixed number of rows
    pivots = integers(some.column("vector").combine_chunks(), width, factor) if len(some) else np.zeros((1, width))
    # as many tasks as there are blocks, up to some for each core
    tasks = max(1, min(-(-n // per_block), max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(TaskContext.get().partitionId())  # the same when a task is repeated
        for batch in batches:
            for lo in range(0, batch.num_rows, per_block):
                part = batch.slice(lo, per_block)
                points = integers(part.column("vector"), width, factor)
                cell = ((pivots**2).sum(axis=1) - 2 * points @ pivots.T).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("asks"), pa.array(cell.astype(np.int32)), pa.array(draw.integers(1 << 30, size=len(cell), dtype=np.int32)), binaries(points.astype(kind))], ["key", "asks", "cell", "lot", "point"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each block."""
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, per_block):
                part = batch.slice(lo, per_block)
                tree, order = CoverTree.build(points_of(part.column("point")))
                own = part.take(pa.array(order))
                points, nodes = tree.pack(kind)
                keys, nulls = own.column("key").fill_null(_LAST).to_numpy(), own.column("key").is_null().to_numpy(zero_copy_only=False)
                asks = own.column("asks").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict({"block": pa.array([number]), "cell": pa.array([own.column("cell")[0].as_py()], pa.int32()), **{x: pa.array([y], pa.binary()) for x, y in (("points", points), ("nodes", nodes), ("keys", keys.tobytes()), ("nulls", nulls.tobytes()), ("asks", asks.tobytes()))}})
                number += 1

    def points_of(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width).astype(np.float64)

    def binaries(points: np.ndarray) -> pa.Array:
        each = points.shape[1] * points.itemsize
        return pa.Array.from_buffers(pa.binary(), len(points), [None, pa.py_buffer((np.arange(len(points) + 1) * each).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(points))])

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
        for batch in batches:
            for row in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                yield row, Block(CoverTree.unpack(row["points"], row["nodes"], width, kind), np.frombuffer(row["keys"], np.int64), np.frombuffer(row["nulls"], bool), row["block"] * ROWS)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of each block, with the kth score within the block."""
        for row, block in blocks_of(batches):
            at = np.flatnonzero(np.frombuffer(row["asks"], bool))
            if not len(at):
                continue
            tree, order = CoverTree.build(block.tree.points[at])
            best, at = Best(len(at), k), at[order]
            search(tree, block.base + at, block, best)
            keys = pa.array(block.keys[at], pa.int64(), mask=block.nulls[at])
            yield pa.RecordBatch.from_arrays([keys, pa.array(block.base + at), pa.array([row["cell"]] * len(at), pa.int32()), pa.array(best.score[:, -1]), binaries(tree.points.astype(kind))], ["key", "row", "cell", "least", "point"])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each tree of queries."""
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, per_block):
                part = batch.slice(lo, per_block)
                tree, order = CoverTree.build(points_of(part.column("point")))
                own = part.take(pa.array(order))
                points, nodes = tree.pack(kind)
                yield pa.RecordBatch.from_pydict({"tree": pa.array([number]), "n": pa.array([part.num_rows], pa.int32()), "keys": pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), own.column("key")), **{x: pa.array([y], pa.binary()) for x, y in (("points", points), ("nodes", nodes), ("rows", own.column("row").to_numpy().tobytes()), ("least", own.column("least").to_numpy().tobytes()))}})
                number += 1

    # lots deal a cell of very many rows to several tasks
    dealt = rows.mapInArrow(celled, "key long, asks boolean, cell int, lot int, point binary").repartitionByRange(tasks, "cell", "lot")
    blocks = work.put(dealt.sortWithinPartitions("cell").mapInArrow(built, "block long, cell int, points binary, nodes binary, keys binary, nulls binary, asks binary"), "blocks")
    lone = work.put(blocks.mapInArrow(asked, "key long, row long, cell int, least double, point binary"), "queries")
    m = lone.count()
    trees = lone.repartitionByRange(max(1, -(-m // ROWS)), "cell", "row").sortWithinPartitions("cell", "row").mapInArrow(grown, "tree long, n int, keys array<long>, points binary, nodes binary, rows binary, least binary")
    trees = work.put(trees, "trees")
    weight = F.length("points") + F.length("nodes") + F.length("rows") + F.length("least")
    passes, held = 1, None
    while held is None or (held > PASS and passes < m):
        passes = 1 if held is None else passes * 2
        turn = F.pmod(F.xxhash64("tree"), F.lit(passes))
        held = trees.groupBy(turn.alias("turn")).agg(F.sum(weight).alias("bytes")).agg(F.max("bytes").alias("bytes")).first().bytes or 0

    def looked(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = [(CoverTree.unpack(points, nodes, width, kind), np.frombuffer(rows, np.int64), np.frombuffer(least, np.float64)) for points, nodes, rows, least in sent.value]
            best = [Best(len(rows), k, least) for _, rows, least in queries]
            for _, block in blocks_of(batches):
                for (tree, rows, _), found in zip(queries, best, strict=True):
                    search(tree, rows, block, found)
            for (_, rows, _), found in zip(queries, best, strict=True):
                at, of = np.nonzero(found.row >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(found.row[at, of]), pa.array(found.key[at, of], pa.int64(), mask=found.null[at, of]), pa.array(found.score[at, of].astype(np.int64))], ["asking", "row", "vec", "score"])

        return run

    slim = blocks.select("block", "points", "nodes", "keys", "nulls")
    for turn in range(passes):
        own = trees.filter(F.pmod(F.xxhash64("tree"), F.lit(passes)) == turn).select("points", "nodes", "rows", "least")
        sent = spark.sparkContext.broadcast([tuple(map(bytes, x)) for x in own.collect()])  # of PASS bytes at most
        work.put(slim.mapInArrow(looked(sent), "asking long, row long, vec long, score long"), f"found/turn={turn}")
        sent.destroy()
    found = spark.read.schema("asking long, row long, vec long, score long").parquet(work.path("found"))
    order = "PARTITION BY asking ORDER BY score DESC, vec ASC NULLS LAST, row"
    ranked = found.withColumn("rank", F.expr(f"row_number() OVER ({order})")).filter(F.col("rank") <= k)
    named = lone.select(F.col("key").alias("query_id"), F.col("row").alias("asking"))
    result = work.put(ranked.join(named, "asking").select("query_id", "rank", F.col("vec").alias(key), "score"), "result")
    work.drop("blocks", "queries", "trees", "found")
    return result


ORACLE = """WITH sound AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM sound q JOIN sound c ON q.row <> c.row WHERE q.vec_id % 50 = 0
), ranked AS (SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5"""
