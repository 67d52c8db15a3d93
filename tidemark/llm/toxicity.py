"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Words are read as a learned vector each (words met in ``MIN_DOCS`` or more training texts; others
share none) together with the mean vector of their hashed byte 4-grams, boundaries included, so
unseen words still say something. Overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, cover the
whole text; each is read forwards and backwards, attention pools the states, and a logistic unit
gives the window's probability. A document's score is that of its worst window.

Training (numpy, Adam) takes a document for toxic if any of its windows is: the probabilities of
windows are joined by a noisy-or. It sees a bounded sample: ``rows`` labelled documents at most, a third
of them toxic where there are enough, taken in the order of a hash of the ``doc_id``; one executor task trains. Everything
else - scoring, windows - covers all rows and whole texts.

Defined results: null and empty texts, and texts without words, score the probability of an empty
window. Rows are scored on their own, so repeated rows score alike. A null ``doc_id`` is not held
out. Labels that are null or without a document are not used; where one class has no rows at all,
every score is 0 (or 1) as that class says, and 0 without any labels. Extra columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NOT_WORD, Workspace, slices, span_hashes, text_bytes, word_spans

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, GRAM_DIM, GRAMS = 8, 12, 8, 8192
MIN_DOCS = 4
THRESHOLD = 0.3


# ---------------------------------------------------------------------------------------------
# words of texts


class Words:
    """The words of texts: per distinct word its vocabulary index and byte 4-grams."""

    def __init__(self, column: pa.Array, vocabulary: np.ndarray):
        data, offsets = text_bytes(pc.utf8_lower(column))
        starts, ends, self.first = word_spans(data, offsets, NOT_WORD)
        hashes = span_hashes(data, starts, ends)
        self.hashes, where, self.index = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(vocabulary, self.hashes), max(0, len(vocabulary) - 1))
        self.known = np.where(vocabulary[at] == self.hashes, at + 1, 0) if len(vocabulary) else np.zeros(len(self.hashes), np.int64)
        # the distinct words one after the other with a boundary byte on either side
        a, b = starts[where], ends[where]
        size = b - a + 2
        last = np.cumsum(size)
        place = np.arange(last[-1] if len(last) else 0)
        owner = np.repeat(np.arange(len(size)), size)
        inner = place - (last - size)[owner] - 1
        edge = (inner < 0) | (inner == (b - a)[owner])
        letters = np.where(edge, 1, data[np.minimum(a[owner] + np.maximum(inner, 0), max(0, len(data) - 1))] if len(data) else 0).astype(np.uint32)
        letters = np.concatenate([letters, np.zeros(3, np.uint32)])
        n = len(place)
        codes = letters[:n] * np.uint32(0x01000193) + letters[1 : n + 1] * np.uint32(0x9E3779B1) + letters[2 : n + 2] * np.uint32(0x85EBCA77) + letters[3 : n + 3] * np.uint32(0xC2B2AE3D)
        count = np.maximum(size - 3, 1)  # words of one letter have one gram, filled up from what follows the boundary
        keep = place - (last - size)[owner] < count[owner]
        short = size[owner] < 4
        codes = np.where(short, letters[:n] * np.uint32(0x27D4EB2F) + letters[1 : n + 1] * np.uint32(0x165667B1), codes)
        self.grams = ((codes ^ (codes >> np.uint32(15))) % np.uint32(GRAMS)).astype(np.int64)[keep]
        self.gram_first = np.concatenate([[0], np.cumsum(count)])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word indices (windows x WINDOW; the number of distinct words where there is none), and the text of each window."""
        n = np.diff(self.first)
        per = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
        owner = np.repeat(np.arange(len(n)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        at = self.first[owner] + nth * STRIDE
        place = at[:, None] + np.arange(WINDOW)
        inside = place < self.first[owner + 1][:, None]
        index = np.append(self.index, len(self.hashes))
        return np.where(inside, index[np.where(inside, place, -1)], len(self.hashes)), owner


# ---------------------------------------------------------------------------------------------
# the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(words: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(scale: float, *shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    h = HIDDEN
    found = {"word": normal(0.1, words + 1, WORD_DIM), "gram": normal(0.1, GRAMS, GRAM_DIM), "in": normal(0.3, WORD_DIM + GRAM_DIM, 6 * h), "in_b": np.zeros(6 * h, np.float32)}
    found |= {"fwd": normal(0.3, h, 3 * h), "bwd": normal(0.3, h, 3 * h), "att": normal(0.3, 2 * h, h), "att_b": np.zeros(h, np.float32), "att_v": normal(0.3, h), "out": normal(0.3, 2 * h), "out_b": np.full(1, -3, np.float32)}
    found["word"][0] = 0
    return found


def inputs(p: dict[str, np.ndarray], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the distinct words, and their share of the gates; the last row leaves a state as it is."""
    count = np.diff(words.gram_first)
    mean = (np.add.reduceat(p["gram"][words.grams], words.gram_first[:-1]) / count[:, None]).astype(np.float32) if len(count) else np.zeros((0, GRAM_DIM), np.float32)
    x = np.concatenate([p["word"][words.known], mean], axis=1)
    gates = x @ p["in"] + p["in_b"]
    stay = np.zeros((1, 6 * HIDDEN), np.float32)
    stay[:, :HIDDEN] = stay[:, 3 * HIDDEN : 4 * HIDDEN] = 30
    return x, np.concatenate([gates, stay])


def _read(gates: np.ndarray, at: np.ndarray, u: np.ndarray, order: range, kept: list | None) -> np.ndarray:
    """States (WINDOW x windows x HIDDEN) of one direction."""
    h = np.zeros((at.shape[0], HIDDEN), np.float32)
    states = np.empty((WINDOW, *h.shape), np.float32)
    for t in order:
        g, a = gates[at[:, t]], h @ u
        zr = _sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        if kept is not None:
            kept.append((t, h, z, r, n, a[:, 2 * HIDDEN :]))
        h = n + z * (h - n)
        states[t] = h
    return states


def forward(p: dict[str, np.ndarray], gates: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
    """Logits of windows; with keep also what the gradient needs."""
    h = HIDDEN
    ahead, back = ([], []) if keep else (None, None)
    states = np.concatenate([_read(gates[:, : 3 * h], at, p["fwd"], range(WINDOW), ahead), _read(gates[:, 3 * h :], at, p["bwd"], range(WINDOW - 1, -1, -1), back)], axis=2)
    seen = np.tanh(states @ p["att"] + p["att_b"])
    score = seen @ p["att_v"]
    empty = at.T == len(gates) - 1
    score = np.where(empty & ~empty.all(axis=0), np.float32(-1e9), score)
    weight = np.exp(score - score.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    logit = pooled @ p["out"] + p["out_b"][0]
    return logit, {"ahead": ahead, "back": back, "states": states, "seen": seen, "weight": weight, "pooled": pooled} if keep else {}


def _columns(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows with the same index."""
    return np.stack([np.bincount(index, rows[:, k], n) for k in range(rows.shape[1])], axis=1).astype(np.float32)


def gradient(p: dict[str, np.ndarray], words: Words, x: np.ndarray, gates: np.ndarray, at: np.ndarray, made: dict, d_logit: np.ndarray) -> dict[str, np.ndarray]:
    h, g = HIDDEN, {}
    g["out"], g["out_b"] = made["pooled"].T @ d_logit, d_logit.sum(keepdims=True)
    d_pooled = d_logit[:, None] * p["out"]
    d_weight = (made["states"] * d_pooled).sum(axis=2)
    d_score = made["weight"] * (d_weight - (made["weight"] * d_weight).sum(axis=0))
    d_seen = d_score[:, :, None] * p["att_v"] * (1 - made["seen"] ** 2)
    g["att_v"] = np.einsum("tb,tbh->h", d_score, made["seen"])
    g["att"], g["att_b"] = np.einsum("tbs,tbh->sh", made["states"], d_seen, optimize=True), d_seen.sum(axis=(0, 1))
    d_states = made["weight"][:, :, None] * d_pooled + d_seen @ p["att"].T
    d_rows = np.zeros((WINDOW, at.shape[0], 6 * h), np.float32)
    for name, kept, low in (("fwd", made["ahead"], 0), ("bwd", made["back"], 1)):
        g[name] = np.zeros_like(p[name])
        d_h = np.zeros((at.shape[0], h), np.float32)
        for t, before, z, r, n, a in reversed(kept):
            d = d_h + d_states[t][:, low * h : (low + 1) * h]
            d_n = d * (1 - z) * (1 - n**2)
            d_z, d_r = d * (before - n) * z * (1 - z), d_n * a * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_n * r], axis=1)
            d_rows[t][:, low * 3 * h : (low + 1) * 3 * h] = np.concatenate([d_z, d_r, d_n], axis=1)
            g[name] += before.T @ d_a
            d_h = d * z + d_a @ p[name].T
    d_gates = _columns(at.T.ravel(), d_rows.reshape(-1, 6 * h), len(gates))[:-1]
    g["in"], g["in_b"] = x.T @ d_gates, d_gates.sum(axis=0)
    d_x = d_gates @ p["in"].T
    g["word"] = _columns(words.known, d_x[:, :WORD_DIM], len(p["word"]))
    g["word"][0] = 0
    count = np.diff(words.gram_first)
    g["gram"] = _columns(words.grams, np.repeat(d_x[:, WORD_DIM:] / count[:, None], count, axis=0), GRAMS)
    return g


def fit(texts: list[str], labels: list[int], epochs: int | None = None, seed: int = 7, rate: float = 0.02) -> dict[str, np.ndarray]:
    """The trained parameters; ``vocabulary`` has the sorted hashes of the known words.

    epochs: by default so many that about 16,000 texts are seen, 4 to 12.
    """
    epochs = epochs or int(np.clip(16_000 // len(texts), 4, 12))
    order = np.random.default_rng(seed).permutation(len(texts))
    column = pa.array(texts, pa.large_string())
    met, often = [], []
    for lo in range(0, len(texts), 128):  # the words of the whole sample are never in memory at once
        some = Words(column.slice(lo, 128), np.zeros(0, np.uint64))
        docs = np.repeat(np.arange(len(some.first) - 1), np.diff(some.first))
        pairs = np.unique(some.index.astype(np.int64) * len(some.first) + docs)
        met.append(some.hashes)
        often.append(np.bincount(pairs // len(some.first), minlength=len(some.hashes)))
    values, back = np.unique(np.concatenate(met), return_inverse=True)
    vocabulary = values[np.bincount(back, np.concatenate(often), len(values)) >= MIN_DOCS]
    p = initial(len(vocabulary), seed)
    y = np.asarray(labels, np.float32)
    share = max(y.mean(), 1e-3)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    size = 48
    for epoch in range(epochs):
        for lo in range(0, len(order), size):
            some = order[lo : lo + size]
            words = Words(column.take(pa.array(some)), vocabulary)
            at, owner = words.windows()
            x, gates = inputs(p, words)
            logit, made = forward(p, gates, at, keep=True)
            one = _sigmoid(logit)
            clean = np.exp(np.bincount(owner, np.log1p(-np.minimum(one, 1 - 1e-6)), len(some)))
            toxic = np.clip(1 - clean, 1e-6, 1)
            weight = np.where(y[some] == 1, min(4.0, 0.5 / share), 1.0)
            # noisy-or: a window is charged with its share of the document's error
            d = np.where(y[some][owner] == 1, -(clean / toxic)[owner] * one, one) * weight[owner] / len(some)
            g = gradient(p, words, x, gates, at, made, d.astype(np.float32))
            step += 1
            now = rate * (1 - 0.8 * epoch / epochs)
            for k in p:
                slope = g[k].astype(np.float32) + (1e-5 * p[k] if k in ("word", "gram") else 0)
                m[k] = 0.9 * m[k] + 0.1 * slope
                v[k] = 0.99 * v[k] + 0.01 * slope**2
                p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        p["word"][0] = 0
    return p | {"vocabulary": vocabulary}


def score(p: dict[str, np.ndarray], column: pa.Array) -> np.ndarray:
    """The probability of each text's worst window."""
    words = Words(column, p["vocabulary"])
    at, owner = words.windows()
    _, gates = inputs(p, words)
    worst = np.full(len(column), -np.inf, np.float32)
    for lo in range(0, len(at), 4096):
        logit, _ = forward(p, gates, at[lo : lo + 4096])
        np.maximum.at(worst, owner[lo : lo + 4096], logit)
    return _sigmoid(worst.astype(np.float64))


# ---------------------------------------------------------------------------------------------
# Spark


def held_out(key: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, toxic, text): the bounded sample, ``rows`` labelled documents at most that are not held out, with one text each."""
    own = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out("doc_id"))
    # a document labelled twice counts as toxic if it once is
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # a sorted limit takes the first rows in each task already; no class meets in one task
    some = lambda mark, most: own.filter(F.col("toxic") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = some(1, rows // 3).unionByName(some(0, rows - rows // 3))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    return texts.groupBy("doc_id", "toxic").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))


def trained(sample: DataFrame) -> dict[str, np.ndarray] | float:
    """The parameters fitted to a bounded sample, or the score of all texts where one class has no rows.

    One executor task trains; the driver gets the parameters only (a few MB), from a written table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks().sort_by("doc_id")
        marks = table.column("toxic").to_pylist()
        made = fit(table.column("text").to_pylist(), marks) if len(set(marks)) == 2 else float(sum(marks) > 0)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["made"])

    work = Workspace(sample.sparkSession, "toxicity")
    found = work.put(sample.repartition(1).mapInArrow(run, "made binary"), "made").collect()
    work.drop("made")
    return pickle.loads(found[0].made) if found else 0.0


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = 4000, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted; ``keep`` names columns of docs to carry along."""
    made = trained(training_rows(docs, labels, rows))
    constant = made if isinstance(made, float) else None
    sent = docs.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", 4 << 20):
                found = score(sent.value, part.column("__text")) if constant is None else np.full(part.num_rows, constant)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.float64())], [*part.schema.names[:-1], "__score"])

    own = docs.select(*(F.col(c).alias(f"__{k}") for k, c in enumerate(("doc_id", *keep))), F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    scored = own.mapInArrow(run, f"{schema}, __score double")
    kept = [F.col(f"__{k + 1}").alias(c) for k, c in enumerate(keep)]
    return scored.select(F.col("__0").alias("doc_id"), held_out("__0").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"), *kept)
