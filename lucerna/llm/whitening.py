"""Embedding whitening: identical vectors grouped with their count, a centred weighted product, one row back per vector.

Components are taken as whole numbers, so the sums, the deviations and (while they fit 53 bits) the products
are exact, whatever the order of tasks. The fit weighs each distinct vector by one or by its count; sums over
tasks go up in a tree, and what reaches the driver is a matrix a vector length, its size checked. A distinct
vector is whitened once and joined back to the rows that hold it; vectors that very many rows hold are split
over several keys.

Defined results: rows whose vector is null or holds null or non-finite entries are left out; a null id is kept
as such, repeated ids and repeated rows each give their rows. Vectors of each length are a population of
their own, with its own fit; an empty vector has no components and gives no row. A component without variance
(up to rounding) has a null `whitened` and counts for nothing in `identity_error`, which is null if none has
any. `deviation` is null where it exceeds a long. An entry whose whole number exceeds 52 bits is an error.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import checkpoint, shuffle_partitions

SCALE, SHIFT = 64, 1_000_000
#: Vectors that one task multiplies at a time.
BLOCK = 8192
#: Bytes of matrices (one a vector length) that the driver takes at most; more is an error.
MOST_BYTES = 1 << 28
#: Variance under this share of the largest one counts as none.
FLAT = 1e-12
_LIMIT = 1 << 52
_SUMS = "dim int, n long, part int, value binary"


def finite(vector) -> F.Column:
    """Vectors that are there and hold numbers only."""
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~odd


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int = 0) -> DataFrame:
    """vec_id, x: floor(scale * component) + shift as longs, of the finite vectors."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(finite(F.col("v")))
    number = lambda v: F.when(F.abs(v * scale) < float(_LIMIT), F.floor(v * scale).cast("long") + shift).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))
    return rows.select("vec_id", F.transform("v", number).alias("x"))


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length in a list column: the length, its rows' numbers, and their values as a matrix."""
    lists = batch.column(column)
    sizes = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten())
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, flat[starts[rows][:, None] + np.arange(dim)]


def _sum_rows(sums: dict[int, list], part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([part] * len(sums), pa.int32()), pa.array([s[1].tobytes() for s in sums.values()], pa.binary())],
        names=["dim", "n", "part", "value"],
    )


def _summed(rows: DataFrame, column: str, per_block: Callable, kind: type) -> dict[int, tuple[int, np.ndarray]]:
    """By vector length: the weight and per_block(dim, vectors, weights) over all rows, in two levels above the tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            dims, weights = np.asarray(batch.column("dim")), np.asarray(batch.column("weight"))
            for _, at, x in by_length(batch, column):
                for lo in range(0, len(at), BLOCK):
                    some = at[lo : lo + BLOCK]
                    for dim in np.unique(dims[some]):
                        own = dims[some] == dim
                        w = weights[some][own]
                        add = per_block(int(dim), x[lo : lo + BLOCK][own], w[:, None])
                        held = total.setdefault(int(dim), [0, np.zeros(add.shape, kind)])
                        held[0] += int(w.sum())
                        held[1] += add
        yield _sum_rows(total, TaskContext.get().partitionId())

    def add(table: pa.Table) -> pa.Table:
        value = np.sum([np.frombuffer(v, kind) for v in table.column("value").to_pylist()], axis=0, dtype=kind)
        return pa.Table.from_batches([_sum_rows({table.column("dim")[0].as_py(): [sum(table.column("n").to_pylist()), value]}, 0)])

    parts = rows.select("dim", "weight", column).mapInArrow(task, _SUMS).withColumn("bucket", F.floor(F.col("part") / 64))
    whole = parts.groupBy("dim", "bucket").applyInArrow(add, _SUMS).groupBy("dim").applyInArrow(add, _SUMS)
    return {r["dim"]: (r["n"], np.frombuffer(r["value"], kind)) for r in whole.collect()}  # one row a length, size checked


def principal(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, the largest entry of each made positive."""
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    top = np.abs(u).argmax(axis=0)
    return e, u * np.where(u[top, np.arange(len(e))] < 0, -1.0, 1.0)


def _halves(dim: int, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of the high and the low 26 bits, so that none passes a long."""
    return np.concatenate([(w * (x >> 26)).sum(axis=0), (w * (x & (2**26 - 1))).sum(axis=0)])


def _moments(dim: int, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums and summed products, end to end."""
    return np.concatenate([(w * v).sum(axis=0), ((w * v).T @ v).ravel()])


def _whitener(fits: dict[int, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, x in by_length(batch, "x"):
                fit = fits[dim]
                low, n = x - fit["floor"], fit["n"]
                if float(np.abs(low).max(initial=0)) ** 2 * float(n) ** 2 * dim >= 2.0**62:
                    low = low.astype(object)  # Python's whole numbers
                gap = n * low - fit["rest"]
                squares = (gap * gap).sum(axis=1)
                over = np.array([v >= 2**63 for v in squares.tolist()], bool)
                w = (gap / n).astype(np.float64) @ fit["project"]
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * w.shape[1])
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("x"), taken.column("many"), taken.column("dim"), pa.array(np.where(over, 0, squares).astype(np.int64), mask=over), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))],
                    names=["x", "many", "dim", "deviation", "w"],
                )

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16, weights: str = "one", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    weights: "one" fits on each distinct vector once, "count" on each as often as it occurs; n is the sum of weights.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights is one or count")
    spark = vectors.sparkSession
    weight = (F.lit(1).cast("long") if weights == "one" else F.col("many")).alias("weight")
    rows = whole_numbers(vectors, id_col, vector_col, scale, shift).where(F.size("x") > 0)
    distinct = checkpoint(rows.groupBy("x").agg(F.count("*").alias("many")).withColumn("dim", F.size("x")))
    size = distinct.groupBy("dim").agg(F.sum("many").alias("rows")).agg(F.sum(8.0 * F.col("dim") * F.col("dim")).alias("bytes"), F.sum("rows").alias("rows")).first()
    if (size["bytes"] or 0) > MOST_BYTES:
        raise ValueError(f"covariances of all vector lengths take {size['bytes']:.0f} bytes, over {MOST_BYTES}")
    weighed = distinct.select("dim", weight, "x")
    fits: dict[int, dict] = {}
    for dim, (n, halves) in _summed(weighed, "x", _halves, np.int64).items():
        sums = [int(high) * 2**26 + int(low) for high, low in halves.reshape(2, dim).T]
        fits[dim] = {"n": n, "floor": np.array([s // n for s in sums], np.int64), "rest": np.array([s % n for s in sums], np.int64)}
    facts = []
    # products are taken about the mean's whole part, exactly; what is left of the mean is under one and taken off after
    products = _summed(weighed, "x", lambda dim, x, w: _moments(dim, (x - fits[dim]["floor"]).astype(np.float64), w)[dim:], np.float64)
    for dim, fit in fits.items():
        n, left = fit["n"], fit["rest"] / fit["n"]
        e, u = principal(products[dim][1].reshape(dim, dim) / n - np.outer(left, left))
        k = min(most, dim)
        good = e[:k] > max(FLAT * e[0], 0.0)
        fit["project"] = np.where(good, u[:, :k] / np.sqrt(np.where(good, e[:k], 1.0)), 0.0)
        trace = float(e.sum())
        facts += [(dim, i + 1, n, max(float(e[i]), 0.0) / trace if trace > 0 else 0.0, bool(good[i])) for i in range(k)]
    white = checkpoint(distinct.mapInArrow(_whitener(fits), "x array<long>, many long, dim int, deviation long, w array<double>"))
    errors = []
    for dim, (n, sums) in _summed(white.select("dim", weight, "w"), "w", _moments, np.float64).items():
        k = fits[dim]["project"].shape[1]
        good = np.abs(fits[dim]["project"]).max(axis=0) > 0
        mean, cov = sums[:k] / n, sums[k:].reshape(k, k) / n
        gap = np.abs(cov - np.outer(mean, mean) - np.eye(k))[np.ix_(good, good)]
        errors.append((dim, float(gap.max()) if good.any() else None))
    # rows by length and component: their number is under that of the matrices checked above
    facts_of = spark.createDataFrame(facts, "dim int, component int, n long, explained double, good boolean").join(spark.createDataFrame(errors, "dim int, identity_error double"), "dim")
    # a vector held by very many rows is dealt to several keys; at most 4 vectors a partition can be so large
    large = max(10_000, (size["rows"] or 0) // (4 * shuffle_partitions(spark)))
    hot = F.broadcast(distinct.where(F.col("many") > large).select("x", F.ceil(F.col("many") / large).cast("int").alias("keys")))
    keys = F.coalesce("keys", F.lit(1))
    dealt = rows.join(hot, "x", "left").select("vec_id", "x", F.pmod(F.monotonically_increasing_id(), keys).cast("int").alias("salt"))
    copies = white.join(hot, "x", "left").select("x", "dim", "deviation", "w", F.explode(F.sequence(F.lit(0), keys - 1)).alias("salt"))
    found = dealt.join(copies, ["x", "salt"]).select("vec_id", "dim", "deviation", F.posexplode("w").alias("place", "value"))
    out = found.withColumn("component", F.col("place") + 1).join(F.broadcast(facts_of), ["dim", "component"])
    return out.select("vec_id", "component", "n", "deviation", F.when(F.col("good"), F.col("value")).alias("whitened"), "explained", "identity_error")
