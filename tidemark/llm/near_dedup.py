"""Near-duplicate documents by bottom-k sketches from one hash function.

Method
    1. One pass over the texts makes of each document the number of its distinct word shingles, a
       128-bit digest of the set and the set's k smallest hashes (the sketch). Documents with equal
       sets are one class from here on; copies are never expanded into pairs.
    2. Inverted lists of the retained values generate overlaps. A class is listed under its rarest
       values only: to share a part t of the sketch with another class it must share one of its
       k - ceil(t k) + 1 rarest values (t is the similarity less ``ERRORS`` standard errors of a sketch's
       estimate; a linked pair lies below it with a probability of about 1e-7). Values of one class need no list.
    3. In a list, the leader - the class whose values are the commonest, as an original's are - is
       compared with all the others, so the pairs grow with the list and not with its square.
    4. The sketch of the union of two classes estimates their similarity and filters; the exact
       Jaccard similarity of the full shingle sets, made again from the texts, decides.
    5. Lists whose members are not in one component after that are open. Their members are listed anew under the
       rarest shingles of their full sets: similar sets share one of their n - ceil(similarity n) + 1 rarest, so
       pages that share a template but not enough of their text fall apart. What is still open is settled block by
       block: a task compares two blocks of members by exact similarity and returns a spanning forest of the links.
       Each block goes out once for each block that it meets, so these tasks run in waves, none of which shuffles
       more than a share of the input. No list is cut.
    6. Links give components by large-star and small-star steps, round by round.

Defined results: null and empty texts, and texts of separators only, have an empty set and are linked
with nothing. Rows with the same ``doc_id`` are rows of their own, each with the component of its
own text. A null ``doc_id`` never names a component unless all its members have none (then the
component is null and ``kept`` false). An empty table gives an empty result; extra columns are not
read. A component's name is its smallest ``doc_id``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, Workspace, distinct, met_by_sorting, shingle_sets, slices

#: Retained values of a sketch.
SKETCH = 64
#: The estimate of a pair may be this many standard errors below the similarity asked for.
ERRORS = 5.5
#: Members and shingles of a block, at most, when what the leaders left open is settled.
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1 << 18
#: A wave of blocks shuffles texts of this part of all shingles at most, or of ``LEAST_WAVE`` shingles.
WAVE_PART = 8
LEAST_WAVE = 1 << 24


def signatures(docs: DataFrame, width: int, text: str = "text", key: str = "doc_id", k: int = SKETCH) -> DataFrame:
    """Per row: doc_id, hash (of the text), n (distinct shingles), cid (16 bytes, null if empty), sketch (the k smallest hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, digests, sketches = [], [], []
                for found in shingle_sets(part.column("text"), width, SPACES):
                    counts.append(len(found))
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    sketches.append(found[:k])
                ends = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
                values = pa.array(np.concatenate(sketches) if sketches else np.zeros(0, np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("hash"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), values)],
                    ["doc_id", "hash", "n", "cid", "sketch"],
                )

    return _sources(docs, text, key).mapInArrow(run, "doc_id long, hash long, n long, cid binary, sketch array<long>")


def _sources(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, text, hash): a row is found again by its key and the hash of its text, where keys are null or repeated too."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("hash"))


def least_share(percent: int, k: int) -> int:
    """The share of a sketch, in percent, that a linked pair has in common all but certainly."""
    t = percent / 100
    return max(1, int(100 * (t - ERRORS * (t * (1 - t) / k) ** 0.5)))


def prefix_lists(classes: DataFrame, percent: int) -> DataFrame:
    """(v, c, n, central): each class under its rarest values that other classes have too.

    classes: (c, n, sketch); percent: two classes are met if they share this part of the longer one's values.
    central: how common the class's values are on average; the original of a group of copies leads.
    """
    values = classes.select("c", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("c")
    sized = met_by_sorting(values, shared, "v").withColumns({"rank": F.row_number().over(own.orderBy("df", "v")), "met": F.count("*").over(own), "sum": F.sum("df").over(own)})
    least = F.floor((F.col("s") * percent + 99) / 100)
    # the values without a list come first in the order of rarity
    place = F.col("rank") + F.col("s") - F.col("met")
    return sized.filter(place <= F.col("s") - least + 1).select("v", "c", "n", (F.col("sum") / F.col("s")).alias("central"))


def _least_neighbours(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of each node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _stars_of_parts(edges: DataFrame) -> DataFrame:
    """(u, v): each part's edges as stars around the smallest node of what hangs together in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above: dict[int, int] = {}

            def root(x: int, above: dict[int, int] = above) -> int:
                while (y := above.setdefault(x, x)) != x:
                    above[x] = above[y]
                    x = above[x]
                return x

            for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = root(x), root(y)
                above[max(x, y)] = min(x, y)
            found = [(x, root(x)) for x in list(above)]
            found = [(x, y) for x, y in found if x != y]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _nodes_off_stars(edges: DataFrame) -> int:
    """Nodes that hang on several others, or hang on one and hold one: none if the edges are stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    per = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return per.filter("hangs > 1 or hangs = 1 and holds = 1").count()


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, root): every node of the edges (u, v) with the smallest node that it reaches.

    Large-star and small-star steps: each hangs neighbours on the smallest one nearby; they end when
    all that is left are stars. Every step is a partial aggregation and a join. Before the first,
    each Arrow batch of edges becomes stars by itself.
    """
    current = work.put(_stars_of_parts(edges.filter("u <> v")).distinct(), f"{name}-0")
    step = 0
    while _nodes_off_stars(current):
        least = _least_neighbours(current)
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = met_by_sorting(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = met_by_sorting(large, lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        step += 1
        current = work.put(small, f"{name}-{step}")
        work.drop(f"{name}-{step - 1}")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) whose union sketch estimates a similarity of ``percent`` or more."""
    sketches = classes.select("c", "sketch")
    met = met_by_sorting(pairs, sketches.select(F.col("c").alias("b"), F.col("sketch").alias("sb")), "b")
    met = met_by_sorting(met, sketches.select(F.col("c").alias("a"), F.col("sketch").alias("sa")), "a")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    met = met.withColumn("union", union).withColumn("both", F.size(F.array_intersect("union", F.array_intersect("sa", "sb"))))
    return met.filter(F.col("both") * 100 >= F.size("union") * percent).select("a", "b")


def _exact(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have 100 * |intersection| >= percent * |union|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}  # sets of the leaders met last
        for batch in batches:
            for part in slices(batch, "tb", 4 << 20):
                keys = part.column("a").to_pylist()
                fresh = {x: k for k, x in enumerate(keys) if x not in kept}
                if len(kept) + len(fresh) > 2000:
                    kept.clear()
                    fresh = {x: k for k, x in enumerate(keys)}
                for x, k in fresh.items():
                    kept[x] = next(shingle_sets(part.column("ta").slice(k, 1), width))
                good = []
                for x, other in zip(keys, shingle_sets(part.column("tb"), width), strict=True):
                    own = kept[x]
                    both = len(own) + len(other) - len(np.union1d(own, other))
                    good.append(100 * both >= percent * (len(own) + len(other) - both))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    met = met_by_sorting(pairs, texts.select(F.col("c").alias("b"), F.col("text").alias("tb")), "b")
    met = met_by_sorting(met, texts.select(F.col("c").alias("a"), F.col("text").alias("ta")), "a")
    return met.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _leader_pairs(lists: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) of each list's leader and its other members, and the leaders (v, c).

    lists: (v, c, n, central). Members whose sizes differ too much to be similar need no comparison.
    """
    first = lists.groupBy("v").agg(F.max(F.struct("central", "c", "n")).alias("l"), F.count("*").alias("members")).filter("members > 1")
    leaders = first.select("v", F.col("l.c").alias("a"), F.col("l.n").alias("na"))
    met = met_by_sorting(lists.select("v", "c", "n"), leaders, "v").filter("c <> a")
    near = met.filter(F.least("n", "na") * 100 >= F.greatest("n", "na") * percent)
    # the leader stays first: its set is made once for all its pairs
    return near.select("a", F.col("c").alias("b")).distinct(), leaders.select("v", F.col("a").alias("c"))


def _open_members(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(c, root, hub): members of lists that are not of one component, with the first member of their list."""
    members = met_by_sorting(lists.select("v", "c"), labels.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    open_lists = members.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("c").alias("hub")).filter("lo <> hi").select("v", "hub")
    return met_by_sorting(members, open_lists, "v").select("c", "root", "hub").distinct()


def _clusters(lists: DataFrame, leaders: DataFrame, labels: DataFrame, texts: DataFrame, width: int, percent: int, work: Workspace) -> DataFrame:
    """(cluster, c, root, n): what is still to compare, by clusters of lists with common members.

    A leader has met all the others of its list. The members of open lists are listed anew by full sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                sets = list(shingle_sets(part.column("text"), width))
                ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                values = pa.array(np.concatenate(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("c"), pa.array(list(map(len, sets)), pa.int64()), pa.ListArray.from_arrays(ends, values)], ["c", "n", "sketch"])

    rest = met_by_sorting(lists.select("v", "c"), leaders, ["v", "c"], "left_anti")
    doubtful = work.put(_open_members(rest, labels).select("c").distinct(), "doubtful")
    sets = work.put(met_by_sorting(doubtful, texts, "c").select("c", "text").mapInArrow(run, "c long, n long, sketch array<long>"), "sets")
    kept = work.put(_open_members(prefix_lists(sets, percent), labels), "open")
    clusters = components(kept.select(F.col("hub").alias("u"), F.col("c").alias("v")), work, "clusters")
    sized = met_by_sorting(kept.select("c", "root").distinct(), sets.select("c", "n"), "c")
    return met_by_sorting(sized, clusters.select(F.col("node").alias("c"), F.col("root").alias("cluster")), "c")


def _block_links(members: DataFrame, texts: DataFrame, width: int, percent: int, most: int, work: Workspace) -> DataFrame:
    """Links (u, v) between different components of a cluster, by exact Jaccard similarity.

    The members (cluster, c, root, n) of the cluster's largest component and the others are dealt into blocks of
    about ``BLOCK_ROWS``; a task gets two blocks of others, or one of the others and one of the largest, so no
    task holds a whole cluster and pairs inside the largest component are never looked at. Of the
    links in its blocks a task gives a spanning forest.

    most: shingles whose texts a wave of tasks shuffles, about; there are as many waves as that takes.
    """
    sizes = members.groupBy("cluster", "root").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    shape = sizes.groupBy("cluster").agg(F.max(F.struct("size", "root", "n")).alias("m"), F.sum("size").alias("size"), F.sum("n").alias("n"))
    blocks = lambda size, n: F.greatest(F.lit(1), F.ceil(size / BLOCK_ROWS), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    shape = shape.select("cluster", F.col("m.root").alias("main"), blocks(F.col("m.size"), F.col("m.n")).alias("mains"), blocks(F.col("size") - F.col("m.size"), F.col("n") - F.col("m.n")).alias("others"))
    dealt = met_by_sorting(members, shape, "cluster").withColumn("in_main", F.col("root") == F.col("main"))
    dealt = work.put(dealt.withColumn("block", F.pmod(F.xxhash64("c"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")), "dealt")
    sent_shingles = dealt.agg(F.sum(F.col("n") * (F.col("others") + F.when(F.col("in_main"), 0).otherwise(F.col("mains"))))).first()[0] or 0
    waves = max(1, -(-sent_shingles // most))
    own, other = F.col("block"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    with_others = lambda f: F.transform(other("others"), f)
    tasks = F.when(F.col("in_main"), with_others(lambda o: F.struct(o.alias("i"), (-1 - own).alias("j")))).otherwise(
        F.concat(with_others(lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j"))), F.transform(other("mains"), lambda m: F.struct(own.alias("i"), (-1 - m).alias("j"))))
    )
    first = ~F.col("in_main") & (F.col("block") == F.col("i"))
    sent = dealt.withColumn("task", F.explode(tasks)).select("cluster", F.col("task.i").alias("i"), F.col("task.j").alias("j"), "c", "root", "in_main", "block")
    sent = sent.select("cluster", "i", "j", "c", "root", first.alias("first"), F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(waves)).alias("wave"))

    def run(table: pa.Table) -> pa.Table:
        # a block that meets itself comes once, as the first of the two
        parts = [table.filter(table.column("first")), table.filter(pc.invert(table.column("first")))]
        sets = [[x for batch in part.select(["text"]).combine_chunks().to_batches() for some in slices(batch, "text", 4 << 20) for x in shingle_sets(some.column("text"), width)] for part in parts]
        size = [np.asarray([len(x) for x in some]) for some in sets]
        alone = not sets[1]
        both = overlaps(sets[0], sets[0 if alone else 1])
        linked = 100 * both >= percent * (size[0][:, None] + size[0 if alone else 1][None, :] - both)
        members, tree = ([x for part in parts for x in part.column(name).to_pylist()] for name in ("c", "root"))  # a member stands for its component so far
        rows, columns = np.nonzero(np.triu(linked, 1) if alone else linked)
        links = []
        for x, y in zip(rows.tolist(), (columns + (0 if alone else len(sets[0]))).tolist(), strict=True):
            p, q = tree[x], tree[y]
            if p != q:
                links.append((members[x], members[y]))
                tree = [p if t == q else t for t in tree]
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    found = [work.put(met_by_sorting(sent.filter(F.col("wave") == k).drop("wave"), texts, "c").groupBy("cluster", "i", "j").applyInArrow(run, "u long, v long"), f"more-{k}") for k in range(waves)]
    return reduce(DataFrame.unionByName, found)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one, by matrix products over slices of the values that both sides have."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out.astype(np.int64)
    values = np.intersect1d(*(distinct(np.concatenate(sets)) for sets in (left, right)), assume_unique=True)
    sides = []
    for sets in (left, right):
        owner, every = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        column = np.searchsorted(values, every)
        met = np.flatnonzero(values[np.minimum(column, len(values) - 1)] == every) if len(values) else np.zeros(0, np.int64)
        order = met[np.argsort(column[met], kind="stable")]
        sides.append((owner[order], column[order]))
    for lo in range(0, len(values), 1 << 13):
        parts = []
        for sets, (owner, column) in zip((left, right), sides, strict=True):
            a, b = np.searchsorted(column, [lo, lo + (1 << 13)])
            has = np.zeros((len(sets), min(1 << 13, len(values) - lo)), np.float32)
            has[owner[a:b], column[a:b] - lo] = 1
            parts.append(has)
        out += parts[0] @ parts[1].T
    return np.rint(out).astype(np.int64)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", k: int = SKETCH) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    width: words of a shingle; percent: documents with 100 * |intersection| >= percent * |union|
    are linked.
    """
    work = Workspace(docs.sparkSession, "near", slim=True)
    least = least_share(percent, k)
    signed = work.put(signatures(docs, width, text, key, k), "signed")
    # copies of one set become one class, known by a number; its sketch is that of any of them, its text the first row's
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    grouped = signed.filter("cid is not null").groupBy("cid").agg(F.min(row).alias("at"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = work.put(grouped.select("cid", F.col("at.doc_id").alias("least"), F.col("at.hash").alias("hash"), "n", "sketch").withColumn("c", F.monotonically_increasing_id()), "classes")
    lists = work.put(prefix_lists(classes, least), "lists")
    asked = work.put(met_by_sorting(lists.select("c").distinct(), classes.select("c", "cid", "least", "hash"), "c"), "asked")
    texts = work.put(_one_text(_sources(docs, text, key), asked, width), "texts")
    pairs, leaders = _leader_pairs(lists, percent)
    links = work.put(_exact(_estimated(pairs, classes, least, k), texts, width, percent).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    labels = components(links, work, "linked")
    members = work.put(_clusters(lists, leaders, labels, texts, width, percent, work), "members")
    work.drop("asked", "doubtful", "sets", "open")
    most = max(LEAST_WAVE, (signed.agg(F.sum("n")).first()[0] or 0) // WAVE_PART)
    more = _block_links(members, texts, width, percent, most, work)
    work.drop("texts")
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more), work, "all")
    named = met_by_sorting(classes.select("c", "cid", "least"), labels.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    out = met_by_sorting(signed.select("doc_id", "n", "cid"), met_by_sorting(named, first, "root").select("cid", "component_id"), "cid", "left")
    own = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    found = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))
    result = Workspace(docs.sparkSession, "near", slim=True).put(found, "result")
    work.clear()
    return result


def _one_text(sources: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(c, text) of each class asked for: the text of its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                same = [len(x) > 0 and hashlib.blake2b(x.tobytes(), digest_size=16).digest() == cid for x, cid in zip(shingle_sets(part.column("text"), width), part.column("cid").to_pylist(), strict=True)]
                yield part.select(["c", "text"]).filter(pa.array(same, pa.bool_()))

    met = met_by_sorting(sources, asked, (sources["hash"] == asked["hash"]) & sources["doc_id"].eqNullSafe(asked["least"])).select("c", "cid", "text")
    return met.mapInArrow(run, "c long, text string").dropDuplicates(["c"])
