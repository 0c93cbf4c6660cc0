"""Toxicity: cumulative-link ordinal regression on sparse text features.

Features are words and word beginnings, hashed into BUCKETS places: the log of the count, scaled by how surely
a place's documents differ in grade from the others (so the fit starts from the evidence, and rare features, of
which most texts have many, don't drown it; none is left out). One weight
vector is shared by all ordered thresholds: P(grade >= k) = logistic(w.x - t_k) for k = 1..K, where K is the
largest grade that the labels hold; a text's expected severity is the sum of these over k. Labels that
say only toxic or not have one threshold; graded labels have as many as grades.

Fitted on at most FIT_ROWS labelled documents, on all their features. Every text is scored whole.

Defined results: null and empty texts have no features and the severity of none; without labels of a grade above 0
nothing is toxic and the severity is 0. Rows that repeat an id are each scored; a repeated label takes its
largest value, and its rows are fitted up to FIT_ROWS in all; a null id is scored. An empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import bounded_sample, checkpoint, class_table, slices, utf8, word_hashes

#: Bound on the labelled documents that the weights are fitted on.
FIT_ROWS = 20_000
#: Places of hashed features (a bound that no input moves), lengths of word beginnings, largest count told apart.
BUCKETS, PREFIXES, MOST = 1 << 20, (4, 5, 6, 7, 8), 255
#: Bytes of text whose features are made at once: a byte takes some hundred bytes of arrays.
AT_ONCE = 1 << 18
#: Parts in which the labelled rows' features come to the driver.
_PARTS = 24
#: Cells that a fit goes over in all, within 8 to 400 rounds.
_WORK = 50_000_000
_PART = bytes(b for b in range(128) if chr(b) not in string.ascii_letters)
LETTERS = class_table(_PART, rest=1)


def _features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, feature hashes, and their rows from it."""
    data, offsets = utf8(column)
    for lo, hi in slices(offsets, AT_ONCE):
        whole, at, *heads = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], LETTERS, PREFIXES)
        row = np.repeat(np.arange(hi - lo), np.diff(at))
        h, r = np.concatenate([whole, *heads]), np.tile(row, 1 + len(heads))
        yield lo, h[h != 0], r[h != 0]


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, place and count of the features of each row, in order of row and place, for runs of rows."""
    for lo, h, r in _features(column):
        if len(h) == 0:
            continue
        one, many = np.unique((lo + r) * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
        yield one // BUCKETS, one % BUCKETS, np.minimum(many, MOST)


def _sums(row: np.ndarray, place: np.ndarray, value: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=weights[place] * value, minlength=n)


def _above(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -500, 500)))


@dataclass
class Severity:
    """Shared weights of the places, and the ordered thresholds (none: nothing is toxic)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, column: pa.Array) -> np.ndarray:
        """P(grade >= 1..K) of each row."""
        if len(self.thresholds) == 0:
            return np.zeros((len(column), 1))
        score = np.zeros(len(column))
        for row, place, many in _vectors(column):
            lo, hi = int(row[0]), int(row[-1]) + 1
            score[lo:hi] += _sums(row - lo, place, np.log1p(many), self.weights, hi - lo)
        return _above(score, self.thresholds)


def link_loss(score: np.ndarray, grade: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log loss of the grades, and its slopes by score (of each row) and by threshold."""
    n, rows = len(score), np.arange(len(score))
    q = _above(score, thresholds)
    ends = np.hstack([np.ones((n, 1)), q, np.zeros((n, 1))])
    slope = np.hstack([np.zeros((n, 1)), q * (1 - q), np.zeros((n, 1))])
    p = np.maximum(ends[rows, grade] - ends[rows, grade + 1], 1e-12)
    up, down = slope[rows, grade] / p, slope[rows, grade + 1] / p
    by_threshold = np.bincount(grade, weights=up, minlength=len(thresholds) + 2) - np.bincount(grade + 1, weights=down, minlength=len(thresholds) + 2)
    return float(-np.log(p).mean()), (down - up) / n, by_threshold[1:-1] / n


def fit_cumulative_link(ends: np.ndarray, place: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int, epochs: int | None = None, ridge: float = 1e-5, rate: float = 0.1, at_once: int = 256, least: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of sparse rows (those of row i at ends[i]:ends[i+1]), by Adagrad on the
    log loss with a ridge, in `least` batches a round or more; small samples, which take little time, get more
    rounds. Gaps between thresholds are exponentials, so their order holds."""
    grades, rng = int(grade.max()), np.random.default_rng(11)
    w, raw = np.zeros(width), np.array([2.0, *[0.0] * (grades - 1)])
    seen_w, seen_raw = np.full(width, 1e-6), np.full(grades, 1e-6)
    cut = lambda: np.cumsum(np.append(raw[0], np.exp(raw[1:])))
    sizes = np.diff(ends)
    for _ in range(epochs or int(np.clip(_WORK // max(len(place), 1), 8, 400))):
        for rows in np.array_split(rng.permutation(len(grade)), min(len(grade), max(least, len(grade) // at_once))):
            many = sizes[rows]
            cells = np.repeat(ends[rows] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            row = np.repeat(np.arange(len(rows)), many)
            at, x = place[cells], value[cells]
            _, by_score, by_cut = link_loss(_sums(row, at, x, w, len(rows)), grade[rows], cut())
            used, where = np.unique(at, return_inverse=True)
            g = np.bincount(where, weights=by_score[row] * x, minlength=len(used)) + ridge * w[used]
            seen_w[used] += g * g
            w[used] -= rate * g / np.sqrt(seen_w[used])
            tail = np.cumsum(by_cut[::-1])[::-1]
            g = np.append(tail[0], tail[1:] * np.exp(raw[1:]))
            seen_raw += g * g
            raw -= rate * g / np.sqrt(seen_raw)
    return w, cut()


def evidence(ends: np.ndarray, place: np.ndarray, grade: np.ndarray, width: int) -> np.ndarray:
    """By place: how many standard errors the mean grade of its documents is off the mean of all, squared (in hundreds)."""
    held, off, step = np.zeros(width), np.zeros(width), 1000
    for lo in range(0, len(grade), step):  # some rows at a time, to hold little
        hi = min(lo + step, len(grade))
        mine = place[ends[lo] : ends[hi]]
        held += np.bincount(mine, minlength=width)
        off += np.bincount(mine, weights=np.repeat(grade[lo:hi] - grade.mean(), np.diff(ends[lo : hi + 1])), minlength=width)
    return (off * off / (held * grade.var() + 1) / 100).astype(np.float32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [(b"", b"")] * batch.num_rows
        for row, place, many in _vectors(batch.column("text")):
            places, counts = place.astype(np.int32), many.astype(np.uint8)
            own, first = np.unique(row, return_index=True)
            for i, a, b in zip(own.tolist(), first, np.append(first[1:], len(row)), strict=True):
                cells[i] = places[a:b].tobytes(), counts[a:b].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], names=["y", "places", "counts"])


def fit_severity(docs: DataFrame, labels: DataFrame, grade: str = "toxic", fit_rows: int = FIT_ROWS) -> Severity:
    """labels: doc_id and an integer grade from 0 on."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(grade).cast("int").alias("y")).where("id is not null and y >= 0")
    known = bounded_sample(known.groupBy("id").agg(F.max("y").alias("y")), ["id"], fit_rows)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("y", "text")  # fit_rows small rows
    # features come to the driver a part at a time, at most fit_rows rows in all
    rows = checkpoint(sample.mapInArrow(_rows, "y int, places binary, counts binary").repartition(_PARTS))
    fit = [tuple(r) for r in islice(rows.toLocalIterator(), fit_rows)]
    if not any(y for y, _, _ in fit):
        return Severity(np.zeros(0), np.zeros(0))
    fit.sort()  # the same order however the rows came
    grade, ends = np.array([y for y, _, _ in fit]), np.cumsum([0, *(len(c) for _, _, c in fit)])
    place, many = np.frombuffer(b"".join([p for _, p, _ in fit]), np.int32), np.frombuffer(b"".join([c for _, _, c in fit]), np.uint8)
    del fit
    scale = evidence(ends, place, grade, BUCKETS)
    value = np.log1p(np.arange(MOST + 1)).astype(np.float32)[many]
    value *= scale[place]
    w, thresholds = fit_cumulative_link(ends, place, value, grade, BUCKETS)
    return Severity(w * scale, thresholds)


def _scorer(model: Severity):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = model.at_least(batch.column("text"))
            i = batch.schema.get_field_index("text")
            names = [n for n in batch.schema.names if n != "text"]
            cols = [batch.column(j) for j in range(batch.num_columns) if j != i]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(q.sum(1)), pa.array((q >= 0.5).sum(1).astype(np.int32)), pa.array(q[:, 0])], names=[*names, "expected_severity", "grade", "p_toxic"])

    return score


def score_rows(rows: DataFrame, model: Severity) -> DataFrame:
    """The rows' columns with expected_severity, grade and p_toxic of their text."""
    out = rows.select(*[c for c in rows.columns if c != "text"], "text").withColumn("whole", F.col("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name != "text"), "expected_severity double, grade int, p_toxic double"])
    return out.mapInArrow(_scorer(model), schema).withColumnRenamed("whole", "text")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_severity, grade, p_toxic, toxic."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit_severity(rows, labels)
    out = rows.mapInArrow(_scorer(model), "doc_id long, expected_severity double, grade int, p_toxic double")
    return out.withColumn("toxic", F.col("p_toxic") >= 0.5)
