"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one kept per group.

The cells give an exact join, not an approximate one. A vector belongs to the cell of its nearest
centre and also visits, as a query, each cell whose dividing plane it lies close to: if y is in cell b
and x in cell a, then |x - y| is at least x's distance to the plane between a and b, so cells further
than the chord of the threshold hold no partner of x. Vectors with equal components are one class.

Defined results: a vector that is null, zero, or holds null or non-finite components links with
nothing, as does a row whose id is null; vectors of different lengths don't link. Rows that repeat an id are
vectors of their own, each with its row; equal vectors of one id are links too. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import bounded_sample, checkpoint, local_components
from lucerna.llm.components import connected_components

#: Bound on the vectors that k-means is fitted on (every vector is then assigned).
FIT_VECTORS = 8192
#: Vectors a cell should hold, and the most cells (bounds the broadcast centres).
CELL, MOST_CELLS = 4096, 1024
#: Targets and queries that one task multiplies.
TARGETS, QUERIES = 4096, 8192


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres of unit rows x; an empty cell takes the row worst served."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ centres.T
        own = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        empty = norms[:, 0] < 1e-9
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
        if empty.any():
            centres[empty] = x[np.argsort(near.max(1))[: int(empty.sum())]]
    return centres


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Packed numbers as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision; scaled first, so that tiny and huge rows keep theirs."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assigner(centres: dict[int, np.ndarray], chord: float, kind: type):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("embedding").to_pylist()
            sizes = np.array([len(v) for v in raw], np.int64)
            reps, many = np.asarray(batch.column("rep")), np.asarray(batch.column("many"))
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                given = np.array([raw[i] for i in rows], kind)
                if dim in centres:
                    x, c = _unit(given), centres[dim]
                    near = x @ c.T
                    own = near.argmax(1)
                    lead = near[np.arange(len(x)), own][:, None] - near
                    apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-12))[own]
                    visit = lead / apart <= chord + 1e-6
                    visit[np.arange(len(x)), own] = True
                    at, cell = np.nonzero(visit)
                    own = own[at]
                else:  # lengths of vector outside the sample: a cell each
                    at, cell, own = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                binary = pa.array([r.tobytes() for r in given], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array((cell + dim * 100_000).astype(np.int64)), pa.array(cell == own), pa.array(reps[rows][at]), pa.array(many[rows][at]), binary.take(pa.array(at))],
                    names=["cell", "home", "rep", "many", "v"],
                )

    return assign


def _compare(threshold: float, kind: type):
    def compare(table: pa.Table) -> pa.Table:
        target = np.asarray(table.column("target"))
        reps, many = np.asarray(table.column("rep")), np.asarray(table.column("many"))
        x = _unit(_matrix(table.column("v").combine_chunks(), kind))
        x32 = x.astype(np.float32)
        t, q = np.flatnonzero(target), np.flatnonzero(~target)
        out_rep, out_n, us, vs = [], [], [], []
        for lo in range(0, len(q), 1024):
            part = q[lo : lo + 1024]
            near = x32[part] @ x32[t].T
            a, b = np.nonzero(near >= np.float32(threshold - 1e-4))
            sims = near[a, b]
            a, b = part[a], t[b]
            close = np.abs(sims - threshold) <= 2e-4
            ok = ~close
            ok[close] = np.einsum("ij,ij->i", x[a[close]], x[b[close]]) >= threshold
            ok &= reps[a] != reps[b]
            a, b = a[ok], b[ok]
            if len(a):
                n = np.bincount(a, weights=many[b], minlength=len(reps)).astype(np.int64)
                hit = np.flatnonzero(n)
                out_rep.append(reps[hit])
                out_n.append(n[hit])
                node, root = local_components(reps[a], reps[b])
                us.append(node)
                vs.append(root)
        z = np.zeros(0, np.int64)
        rep, n = np.concatenate([z, *out_rep]), np.concatenate([z, *out_n])
        if us:
            u, v = local_components(np.concatenate(us), np.concatenate(vs))
            rep, n, v = np.concatenate([rep, u]), np.concatenate([n, np.zeros(len(u), np.int64)]), np.concatenate([rep, v])
        else:
            v = rep
        return pa.table({"rep": rep, "n": n, "root": v})

    return compare


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    single = "float" in vectors.schema[vector_col].dataType.simpleString()
    kind = np.float32 if single else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("embedding"))
    ids = rows.where("vec_id is not null")
    fit = F.size("embedding") > 0
    for bad in (lambda v: v.isNull(), lambda v: F.isnan(v), lambda v: F.abs(v) == float("inf")):
        fit &= ~F.exists("embedding", bad)
    fit &= F.exists("embedding", lambda v: v != 0)
    ids = ids.withColumn("embedding", F.when(fit, F.col("embedding")))
    good = ids.where("embedding is not null")
    # a class is known by a number of its own, since rows of one id may lie in several
    classes = checkpoint(good.groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("many")).withColumn("rep", F.monotonically_increasing_id()))
    total = classes.count()
    sample = [r[0] for r in bounded_sample(classes.select("rep", "embedding"), ["rep"], FIT_VECTORS).select("embedding").collect()]
    centres: dict[int, np.ndarray] = {}
    if sample:
        lengths = np.array([len(v) for v in sample])
        dim = int(np.bincount(lengths).argmax())
        x = _unit(np.array([v for v in sample if len(v) == dim], kind))
        centres[dim] = spherical_kmeans(x, min(MOST_CELLS, max(1, -(-total // CELL))))
    chord = float(np.sqrt(2 - 2 * threshold))
    placed = checkpoint(classes.select("embedding", "rep", "many").mapInArrow(_assigner(centres, chord, kind), "cell long, home boolean, rep long, many long, v binary"))
    # at most MOST_CELLS rows, and one per other vector length
    counts = placed.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("n_t"), F.count("*").alias("n_q")).where("n_t > 0")
    blocks = counts.select("cell", F.ceil(F.col("n_t") / TARGETS).cast("long").alias("n_tb"), F.ceil(F.col("n_q") / QUERIES).cast("long").alias("n_qb"))
    sized = placed.join(F.broadcast(blocks), "cell")
    one = F.xxhash64("rep")
    whole = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    queries = sized.select("cell", F.explode(whole("n_tb")).alias("tb"), F.pmod(one, F.col("n_qb")).alias("qb"), F.lit(False).alias("target"), "rep", "many", "v")
    targets = sized.where("home").select("cell", F.pmod(one, F.col("n_tb")).alias("tb"), F.explode(whole("n_qb")).alias("qb"), F.lit(True).alias("target"), "rep", "many", "v")
    found = checkpoint(queries.unionByName(targets).groupBy("cell", "tb", "qb").applyInArrow(_compare(threshold, kind), "rep long, n long, root long"))
    linked = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select("rep", "root")).select(F.col("node").alias("rep"), "component")
    placed_rows = classes.join(linked, "rep", "left").join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lowest = placed_rows.groupBy("component").agg(F.min("low").alias("component_id"))
    facts = checkpoint(placed_rows.join(lowest, "component").select("embedding", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"))
    out = ids.join(facts, "embedding", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    nulls = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(nulls).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
