"""Helpers shared by the corpus operators: checkpoints, sizes, byte-level text in numpy, keyed streams."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: space and \t \n \v \f \r (fixed values).
BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text handled at once by the vectorised helpers.
SLICE_BYTES = 2 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; make a folder only in local mode (tests), where one machine is all."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared folder; cuts the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(df: DataFrame, key: list[str], rows: int) -> DataFrame:
    """At most `rows` rows, chosen by a hash of `key`. A hash filter comes first, so that what tasks send to
    be ordered stays near twice the bound however many tasks there are."""
    hashed = F.xxhash64(*key)
    step = max(1, df.count() // (2 * rows))
    return df.where(F.pmod(hashed, F.lit(step)) == 0).orderBy(F.xxhash64(F.lit(1), *key), *key).limit(rows)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix constants), vectorised."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `most` bytes; a longer row is a run of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 256), _MUL, np.uint64)
        grown[0] = 1
        _POWERS = np.cumprod(grown, dtype=np.uint64)
    return _POWERS


def class_table(*groups: bytes, rest: int) -> np.ndarray:
    """The class of each byte: that of the group holding it, from 0 on, or `rest`. Class 0 parts words."""
    out = np.full(256, rest, np.uint8)
    for i, group in enumerate(groups):
        out[list(group)] = i
    return out


#: Words between ASCII white space.
WORDS = class_table(BLANKS, rest=1)


def word_hashes(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORDS, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words of rows laid end to end, A-Z lower-cased, and each row's first word.

    A word is a maximal run of bytes of one class other than 0; words never cross rows.
    Returns (hashes, word offsets by row), and for each length in `prefixes` the hashes of the words'
    first so many bytes, 0 for words no longer than that.
    """
    n, rows = len(data), len(offsets) - 1
    kind = classes[data]
    inside = kind > 0
    if n == 0 or not inside.any():
        return (np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), *[np.zeros(0, np.uint64)] * len(prefixes))
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(new & inside)
    low = _LOWER[data[inside]]
    first = np.flatnonzero(new[inside])
    length = np.diff(np.append(first, len(low)))
    place = np.arange(len(low), dtype=np.int64) - np.repeat(first, length)
    parts = (low.astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[place]
    tag = np.uint64(0xD6E8FEB86659FD93)
    hashes = mix(np.add.reduceat(parts, first) + length.astype(np.uint64) * tag)
    heads = [np.where(length > k, mix(np.add.reduceat(np.where(place < k, parts, np.uint64(0)), first) + np.uint64((1000 + k) * int(tag) % 2**64)), np.uint64(0)) for k in prefixes]
    return (hashes, np.searchsorted(starts, offsets).astype(np.int64), *heads)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct `width`-word shingle hashes of each row, end to end, and their offsets.

    A row of fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    words, at = word_hashes(data, offsets)
    counts = np.diff(at)
    rows = np.arange(len(counts))
    many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    if many.sum() == 0:
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    row = np.repeat(rows, many)
    first = np.cumsum(many) - many
    start = at[:-1][row] + (np.arange(len(row)) - first[row])
    size = np.minimum(counts, width)[row]
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    h = mix(size.astype(np.uint64) + np.uint64(77))
    for k in range(width):
        nxt = mix(h * _MUL + padded[start + k])
        h = nxt if k == 0 else np.where(size > k, nxt, h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(counts) + 1)).astype(np.int64)


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the given links and the smallest node of each one's component."""
    nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = where[: len(u)], where[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def keyed(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by `keys`; one table holds many groups.

    What a group left open at a batch's end is carried on, so memory holds a batch and one group.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            col = np.asarray(batch.column(k))
            same &= col == col[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if rest and (cut or any(rest[-1].column(k)[-1] != batch.column(k)[0] for k in keys)):
            if cut and all(rest[-1].column(k)[-1] == batch.column(k)[0] for k in keys):
                yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            else:
                yield pa.Table.from_batches(rest)
                if cut:
                    yield pa.Table.from_batches([batch.slice(0, cut)])
            rest = [batch.slice(cut)]
        else:
            if cut:
                yield pa.Table.from_batches([batch.slice(0, cut)])
            rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def group_bounds(columns: list[np.ndarray]) -> np.ndarray:
    """Starts of runs of equal keys, and the end."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(np.flatnonzero(new), n)
