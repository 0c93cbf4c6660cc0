"""Exact top-k by inner product: branch and bound over dimension blocks of vertically laid out vectors.

Queries and candidates meet in blocks. Inside a block candidates lie dimension by dimension, the longest
first; products are added up one dimension block at a time. By Cauchy-Schwarz what a pair can still gain is at
most the product of both vectors' remaining lengths, so a pair whose sum and remaining mass stay under the
query's k-th best score so far is out: rows and columns without a pair left are compacted away, and once few
pairs are left they go on one by one. The k-th best score among a bounded sample, found first, starts every
block off (a bound, not a filter: what reaches it stays). A block returns at most k rows a query.

Components become whole numbers and sums are exact: in float32 while lengths' products stay under 2^24, in
double under 2^53, else in longs; a product that could exceed a long is an error.

Defined results: vectors that are null or hold null or non-finite components take no part; a row with a null
id is a candidate (last among ties) and no query. Repeated ids are rows of their own: each gives a query, and
other rows of the same id are candidates. Vectors of different lengths don't meet; empty ones score 0. A
query without candidates has no rows. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.llm.common import bounded_sample, checkpoint, shuffle_partitions
from lucerna.llm.whitening import by_length, whole_numbers

SCALE = 256
#: Candidates and queries of one block; a block is one task's group.
CANDIDATES, QUERIES = 65_536, 8_192
#: Candidates under which a block is not split further to use all tasks.
LEAST_BLOCK = 1_024
#: Candidates and queries multiplied at once, and dimensions added at a time.
COLUMNS, ROWS, DIMENSIONS = 4_096, 512, 16
#: Share of pairs left under which pairs go on one by one.
SPARSE = 0.05
#: Bounds on the sample that gives first thresholds: rows, and numbers in them.
SAMPLE, SAMPLE_NUMBERS = 2_048, 1 << 22
_NONE = np.iinfo(np.int64).min


def _exact(q: np.ndarray, c: np.ndarray) -> type:
    """The number type in which every partial sum of q @ c is exact."""
    most = float(np.linalg.norm(q.astype(np.float64), axis=1).max(initial=0)) * float(np.linalg.norm(c.astype(np.float64), axis=1).max(initial=0)) * (1 + 1e-9)
    for kind, top in ((np.float32, 2.0**24), (np.float64, 2.0**53), (np.int64, 2.0**63)):
        if most < top:
            return kind
    raise ValueError("an inner product can exceed a long")


def _best(score: np.ndarray, row: np.ndarray, vec: np.ndarray, void: np.ndarray, k: int) -> np.ndarray:
    """Positions of each row's k best: higher score, then smaller id, null ids last; in that order."""
    order = np.lexsort((vec, void, -score, row))
    ordered = row[order]
    start = np.searchsorted(ordered, ordered)
    return order[np.arange(len(order)) - start < k]


def _reaches(sums: np.ndarray, mass: np.ndarray, bar: np.ndarray) -> np.ndarray:
    """Whether a partial sum can still reach the bar; rounded so that a tie stays."""
    return sums + mass * (1 + 1e-9) + 1e-6 >= bar - np.abs(bar) * 1e-12


def search_block(q: np.ndarray, q_id: np.ndarray, floor: np.ndarray, c: np.ndarray, c_id: np.ndarray, c_void: np.ndarray, c_many: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query row, candidate row, score, times): at least the k best candidates of each query that reach its floor.

    Rows are distinct (id, vector) pairs; c_many rows hold such a pair. A query is one of the rows of its own
    pair, so it meets that pair once less (c_void: the candidate's id is null and no query's).
    floor: a score that k candidates of the query reach, or the least long.
    """
    kind = _exact(q, c)
    longest = np.argsort(-(c.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    heaviest = np.argsort(-(c.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    blocks = [heaviest[at : at + DIMENSIONS] for at in range(0, len(heaviest), DIMENSIONS)] or [heaviest]
    down, across = np.ascontiguousarray(c[longest].T.astype(kind)), np.ascontiguousarray(q.astype(kind))
    part = lambda m: np.stack([(m[b].astype(np.float64) ** 2).sum(axis=0) for b in blocks])
    after = lambda m: np.sqrt(np.maximum(np.cumsum(part(m)[::-1], axis=0)[::-1] - part(m), 0))
    left_c, left_q = after(down), after(across.T)
    least = floor.astype(np.int64)
    none = np.zeros(0, np.int64)
    kept = (none, none, none)
    for lo in range(0, len(c), COLUMNS):
        for top in range(0, len(q), ROWS):
            rows, cols = np.arange(top, min(top + ROWS, len(q))), np.arange(lo, min(lo + COLUMNS, len(c)))
            sums, pairs = np.zeros((len(rows), len(cols)), kind), None
            for i, b in enumerate(blocks):
                if pairs is None:
                    sums = sums + across[np.ix_(rows, b)] @ down[np.ix_(b, cols)]
                    alive = _reaches(sums, np.outer(left_q[i][rows], left_c[i][cols]), least[rows].astype(np.float64)[:, None])
                    if np.count_nonzero(alive) <= SPARSE * alive.size:
                        a, d = np.nonzero(alive)
                        pairs, sums = (rows[a], cols[d]), sums[a, d]
                    else:
                        some, any_ = alive.any(axis=1), alive.any(axis=0)
                        if not (some.all() and any_.all()):
                            rows, cols, sums = rows[some], cols[any_], sums[np.ix_(some, any_)]
                else:
                    a, d = pairs
                    sums = sums + sum((across[a, j] * down[j, d] for j in b), np.zeros(len(a), kind))
                    alive = _reaches(sums, left_q[i][a] * left_c[i][d], least[a].astype(np.float64))
                    pairs, sums = (a[alive], d[alive]), sums[alive]
            if pairs is None:
                a, d = np.nonzero(sums.astype(np.int64) >= least[rows][:, None])
                pairs, sums = (rows[a], cols[d]), sums[a, d]
            a, d = pairs[0], longest[pairs[1]]
            own = (c_id[d] == q_id[a]) & ~c_void[d] & (c_many[d] == 1)
            own[own] = (c[d[own]] == q[a[own]]).all(axis=1)
            a, d, scores = a[~own], d[~own], sums[~own].astype(np.int64)
            if len(a):
                a, d, scores = np.concatenate([kept[0], a]), np.concatenate([kept[1], d]), np.concatenate([kept[2], scores])
                best = _best(scores, a, c_id[d], c_void[d], k)
                kept = (a[best], d[best], scores[best])
                row, at, n = np.unique(kept[0], return_index=True, return_counts=True)
                full = n == k
                least[row[full]] = np.maximum(least[row[full]], kept[2][at[full] + k - 1])
    a, d, scores = kept
    own = (c_id[d] == q_id[a]) & ~c_void[d]
    own[own] = (c[d[own]] == q[a[own]]).all(axis=1)
    return a, d, scores, c_many[d] - own


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.fill_null(0)), np.asarray(column.is_null())


def _floors(sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """The k-th best score of each query among sampled candidates of other ids, the least long if they are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floor = np.full(batch.num_rows, _NONE)
            ids = np.asarray(batch.column("vec_id"))
            for dim, rows, x in by_length(batch, "x"):
                if dim not in sample:
                    continue
                c_id, c = sample[dim]
                kind = _exact(x, c)
                for at in range(0, len(rows), ROWS):
                    some = rows[at : at + ROWS]
                    scores = (x[at : at + ROWS].astype(kind) @ c.T.astype(kind)).astype(np.int64)
                    scores[ids[some][:, None] == c_id] = _NONE
                    if len(c) >= k:
                        floor[some] = np.partition(scores, len(c) - k, axis=1)[:, len(c) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], names=[*batch.schema.names, "floor"])

    return run


def _search(k: int):
    def search(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        is_query = np.asarray(table.column("query"))
        matrix = lambda t: np.asarray(t.column("x").combine_chunks().flatten()).reshape(t.num_rows, dim)
        queries, candidates = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
        c_id, c_void = _ids(candidates.column("vec_id").combine_chunks())
        a, d, scores, times = search_block(matrix(queries), np.asarray(queries.column("vec_id")), np.asarray(queries.column("floor")), matrix(candidates), c_id, c_void, np.asarray(candidates.column("many")), k)
        at = queries.take(pa.array(a))
        return pa.table({"query_id": at.column("vec_id"), "q1": at.column("h1"), "q2": at.column("h2"), "q_many": at.column("many"), "vec_id": pa.array(c_id[d], mask=c_void[d]), "score": scores, "times": times.astype(np.int64)})

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest inner product for each row that is_query (a condition
    on the long column vec_id) holds for, ties to the smaller id."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors.withColumn(id_col, F.col(id_col).cast("long")), id_col, vector_col, scale)
    classes = checkpoint(
        rows.groupBy("vec_id", "x").agg(F.count("*").alias("many"))
        .select("vec_id", "x", "many", F.size("x").alias("dim"), F.xxhash64(F.lit(1), "x").alias("h1"), F.xxhash64(F.lit(2), "x").alias("h2"))
    )
    queries = classes.where(is_query & F.col("vec_id").isNotNull())
    size = classes.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    sample: dict[int, list] = {}
    for r in bounded_sample(classes.select("vec_id", "x", "h1"), ["vec_id", "h1"], max(1, min(SAMPLE, SAMPLE_NUMBERS // max(size["dim"] or 1, 1)))).where("vec_id is not null").collect():
        sample.setdefault(len(r["x"]), []).append((r["vec_id"], r["x"]))
    known = {d: (np.array([v for v, _ in s], np.int64), np.array([x for _, x in s], np.int64).reshape(len(s), d)) for d, s in sample.items()}
    floored = queries.select("vec_id", "x", "many", "dim", "h1", "h2").mapInArrow(_floors(known, k), "vec_id long, x array<long>, many long, dim int, h1 long, h2 long, floor long")
    n_cb = max(-(-size["n"] // CANDIDATES), min(shuffle_partitions(spark), -(-size["n"] // LEAST_BLOCK)), 1)
    n_qb = max(-(-queries.count() // QUERIES), 1)
    block = lambda n: F.pmod(F.xxhash64("vec_id", "h1"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = floored.select("dim", block(n_qb).alias("qb"), every(n_cb).alias("cb"), F.lit(True).alias("query"), "vec_id", "x", "many", "h1", "h2", "floor")
    offered = classes.select("dim", every(n_qb).alias("qb"), block(n_cb).alias("cb"), F.lit(False).alias("query"), "vec_id", "x", "many", "h1", "h2", F.lit(0).cast("long").alias("floor"))
    found = asked.unionByName(offered).groupBy("dim", "qb", "cb").applyInArrow(_search(k), "query_id long, q1 long, q2 long, q_many long, vec_id long, score long, times long")
    own = Window.partitionBy("query_id", "q1", "q2").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    rows_of = found.select("query_id", "q1", "q2", "q_many", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k).cast("long")))))
    ranked = rows_of.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return ranked.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("q_many")))).select("query_id", "rank", "vec_id", "score")
