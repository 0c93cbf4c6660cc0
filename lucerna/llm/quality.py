"""Quality classifier: random-indexing word vectors, pooled by document, and a two-layer network.

Every word bucket has a sparse ternary index vector; a bucket's word vector is the sum of the index
vectors of the words within WINDOW places of its words, over the whole texts of all documents. A
document is the mean and the spread of its word vectors. A two-layer network in numpy is fitted on at
most FIT_ROWS labelled documents; a temperature fitted on a fifth of these calibrates its scores.

Tokens are runs of letters, digits and bytes over 127, or runs of other signs. Labels are learned only from
rows whose crc32(doc_id as text) mod 3 is not 1; labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts have an all-zero vector and the score the network gives that; with
labels of one class or none, every score is the smoothed share of label 1. Rows that repeat an id are
each scored; a repeated label takes its largest value, and its rows are fitted up to FIT_ROWS in all. A null id is held_out null and is scored. An
empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import BLANKS, bounded_sample, class_table, slices, utf8, word_hashes

#: Word buckets, vector length, index entries a word, window and hidden units.
BUCKETS, DIM, ENTRIES, WINDOW, HIDDEN = 1 << 14, 64, 2, 2, 32
#: Bound on the labelled documents that the network is fitted on.
FIT_ROWS = 20_000
_BLOCK, _FAN = 256, 64
_SIGNS = bytes(b for b in range(128) if chr(b) not in string.ascii_letters + string.digits and b not in BLANKS)
TOKENS = class_table(BLANKS, _SIGNS, rest=2)


def _index_vectors(seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (BUCKETS, ENTRIES)), rng.choice([-1.0, 1.0], (BUCKETS, ENTRIES))


def _tokens(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket of each token and first token of each row, for runs of rows."""
    data, offsets = utf8(column)
    for lo, hi in slices(offsets, 1 << 20):
        h, at = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], TOKENS)
        yield (h % np.uint64(BUCKETS)).astype(np.int64), at


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's sums of context index vectors, in blocks of buckets."""
    place, sign = _index_vectors()
    table = np.zeros(BUCKETS * DIM)
    for batch in batches:
        for words, at in _tokens(batch.column("text")):
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            for step in range(1, WINDOW + 1):
                same = row[step:] == row[:-step]
                for mine, other in ((words[:-step][same], words[step:][same]), (words[step:][same], words[:-step][same])):
                    for e in range(ENTRIES):
                        table += np.bincount(mine * DIM + place[other, e], weights=sign[other, e], minlength=BUCKETS * DIM)
    blocks = table.astype(np.int64).reshape(-1, _BLOCK * DIM)
    part = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks))), pa.array(np.full(len(blocks), part)), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "part", "sums"])


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(_BLOCK * DIM, np.int64)
    for b in table.column("sums"):
        total += np.frombuffer(b.as_buffer(), np.int64)
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "part": pa.array([table.column("part")[0].as_py() // _FAN], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors of all buckets (BUCKETS x DIM floats: a bound that no input moves). The partitions'
    sums, whole numbers, are added up as a tree, so that a task adds _FAN blocks of them at most."""
    kinds, texts = "block long, part long, sums binary", docs.select("text")
    blocks, parts = texts.mapInArrow(_gather, kinds), texts.rdd.getNumPartitions()
    while True:
        blocks = blocks.groupBy("block", F.floor(F.col("part") / _FAN)).applyInArrow(lambda _, t: _add(t), kinds)
        if parts <= _FAN:
            break
        parts = -(-parts // _FAN)
    table = np.zeros((BUCKETS, DIM))
    for block, _, sums in blocks.collect():
        table[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(sums, np.int64).reshape(_BLOCK, DIM)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each row."""
    out = []
    for words, at in _tokens(column):
        n = len(at) - 1
        mean, spread = np.zeros((n, DIM)), np.zeros((n, DIM))
        for i in range(n):
            if at[i] < at[i + 1]:
                many = np.bincount(words[at[i] : at[i + 1]], minlength=0)
                used = np.flatnonzero(many)
                v, w = vectors[used], many[used] / many.sum()
                mean[i] = w @ v
                spread[i] = np.sqrt(np.maximum(w @ (v * v) - mean[i] ** 2, 0))
        out.append(np.hstack([mean, spread]))
    return np.concatenate(out) if out else np.zeros((0, 2 * DIM))


class Network:
    """Two layers (tanh, logistic) on standardised inputs, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = 40):
        self.share = (y.sum() + 1) / (len(y) + 2)
        self.fitted = len(y) >= 10 and 0 < y.sum() < len(y)
        if not self.fitted:
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, fit = order[: len(y) // 5], order[len(y) // 5 :]
        self.centre, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-6
        z = (x - self.centre) / self.scale
        w1, b1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
        w2, b2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        self.layers = [w1, b1, w2, b2]
        first, second, t = [np.zeros_like(p) for p in self.layers], [np.zeros_like(p) for p in self.layers], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                a = np.tanh(z[rows] @ w1 + b1)
                d = (1 / (1 + np.exp(-np.clip(a @ w2 + b2, -30, 30))) - y[rows]) / len(rows)
                back = np.outer(d, w2) * (1 - a * a)
                t += 1
                for p, g, m, v in zip(self.layers, (z[rows].T @ back + 1e-4 * w1, back.sum(0), a.T @ d + 1e-4 * w2, d.sum(keepdims=True)), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        logits, yh = self._logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, np.where(yh == 1, -1, 1) * logits / g)) for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))]) if len(held) else 1.0

    def _logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self._logits(x) / self.temperature, -500, 500)))


def _pooler(vectors: np.ndarray):
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _pool(batch.column("text"), vectors).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    return pool


def _scorer(vectors: np.ndarray, network: Network):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = network.score(_pool(batch.column("text"), vectors).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return score


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, mod 3."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vectors = word_vectors(rows)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = bounded_sample(known.where(fold(F.col("id")) != 1).groupBy("id").agg(F.max("y").alias("y")), ["id"], fit_rows)
    sample = rows.join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("y", "text")  # fit_rows small rows
    # where ids repeat there are more rows than labels: of these the first by a hash of what they pool to, in any run
    pooled = sample.mapInArrow(_pooler(vectors), "y int, x binary")
    fit = pooled.orderBy(F.xxhash64("x"), "x", "y").limit(fit_rows).collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in fit], np.float64).reshape(len(fit), 2 * DIM)
    order = np.lexsort(x.T[::-1]) if len(fit) else np.zeros(0, int)  # the same order however the rows came
    network = Network(x[order], np.array([r["y"] for r in fit], np.float64)[order])
    out = rows.mapInArrow(_scorer(vectors, network), "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
