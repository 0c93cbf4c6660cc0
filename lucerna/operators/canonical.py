"""Canonical rows with lineage, contrasts between them, and agreement of repeated annotations."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions.positions import with_positions
from lucerna.sources.cuts import dealt

def canonical_dedup(edges: DataFrame, cell: str = "cell_id", source: str = "source_id", note: str = "note") -> DataFrame:
    """One row a cell: distinct sources, all edges, and the first source with its note (least source, then position)."""
    return edges.groupBy(cell).agg(
        F.countDistinct(source).alias("n_sources"), F.count("*").alias("n_edges"),
        F.min(F.struct(source, note)).alias("least"),
    ).select(cell, "n_sources", "n_edges", F.col(f"least.{source}").alias("first_source"), F.col(f"least.{note}").alias("first_note"))


def canonical_sources(edges: DataFrame, cell: str = "cell_id", source: str = "source_id", note: str = "note", position: str = "position") -> DataFrame:
    """The sorted sources and notes of the cells as rows: each distinct source of a cell with its first note
    by position. Rows rather than an array a cell, since a cell may have any number of sources."""
    return edges.groupBy(cell, source).agg(F.count("*").alias("n_edges"), F.min_by(note, position).alias("first_note"))


def contribution(mappings: DataFrame, edges: DataFrame, result: str = "result", contributes: str = "complete") -> DataFrame:
    """One row a mapping class with what contributes cells and what doesn't, and why; and one for all, with
    edges, cells and edges a cell. edges: (cell_id) of the contributing mappings."""
    why = F.when(F.col(result) == contributes, "contributes").otherwise(F.concat(F.lit("result is "), F.coalesce(result, F.lit("missing"))))
    rows = mappings.groupBy(why.alias("reason")).agg(F.count("*").alias("n")).select("reason", "n", F.lit(None).cast("double").alias("ratio"))
    total = edges.agg(F.count("*").alias("n"), F.countDistinct("cell_id").alias("cells"))
    return rows.unionByName(total.select(F.lit("edges a cell").alias("reason"), "n", F.bround(F.col("n") / F.col("cells"), 6).alias("ratio")))


def source_cases(edges: DataFrame, noted, cell: str = "cell_id", source: str = "source_id", note: str = "note") -> DataFrame:
    """The sources a cell is realised from: its first, and further ones with a note where `noted` holds."""
    first = edges.groupBy(cell).agg(F.min(source).alias("_first"))
    rows = edges.join(first.withColumnRenamed(cell, "_cell"), F.col(cell) == F.col("_cell")).drop("_cell")
    primary = F.col(source) == F.col("_first")
    return rows.where(primary | (noted & F.col(note).isNotNull())).select(cell, source, note, primary.alias("primary")).distinct()


def attrition(mappings: DataFrame, results: list[str], contributes: str = "complete") -> DataFrame:
    """Rows of each result class, also those without rows, and whether they contribute cells."""
    grid = mappings.sparkSession.createDataFrame([(r,) for r in results], "result string")
    found = mappings.groupBy("result").agg(F.count("*").alias("n"))
    return grid.join(found, "result", "left").select("result", F.coalesce("n", F.lit(0)).alias("n"), (F.col("result") == contributes).alias("contributes"))


def hamming_one(cells: DataFrame, dimensions: list[str], key: str = "cell_id") -> DataFrame:
    """Pairs of cells (left id < right id) that differ in exactly one dimension: for each dimension an equi
    join on all the others, null-safe; no comparison of all pairs."""
    out = None
    for d in dimensions:
        rest = [x for x in dimensions if x != d]
        left = cells.select(F.col(key).alias("left_id"), F.col(d).alias("left_value"), *rest)
        right = cells.select(F.col(key).alias("right_id"), F.col(d).alias("right_value"), *[F.col(x).alias(f"_{x}") for x in rest])
        same = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in rest])
        pairs = left.join(right, same & (F.col("left_id") < F.col("right_id")) & ~F.col("left_value").eqNullSafe(F.col("right_value")))
        pairs = pairs.select("left_id", "right_id", F.lit(d).alias("dimension"), "left_value", "right_value")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def contrast_matching(pairs: DataFrame, most_rounds: int = 100) -> DataFrame:
    """One-to-one matching of the candidate pairs (a < b): the pairs a scan in order of (a, b) would take.
    In each round a pair is taken that is the least pair of both its ends; the ends then leave."""
    from lucerna.sources.cuts import cut

    rest, taken = cut(pairs.select("a", "b").distinct()), None
    for _ in range(most_rounds):
        if rest.isEmpty():
            break
        ends = rest.select(F.col("a").alias("end"), "a", "b").unionByName(rest.select(F.col("b").alias("end"), "a", "b"))
        least = ends.groupBy("end").agg(F.min(F.struct("a", "b")).alias("p"))
        now = cut(least.groupBy("p").agg(F.count("*").alias("n")).where("n = 2").select("p.a", "p.b"))
        taken = now if taken is None else taken.unionByName(now)
        gone = now.select(F.col("a").alias("x")).unionByName(now.select(F.col("b").alias("x")))
        rest = cut(rest.join(gone, F.col("a") == F.col("x"), "left_anti").join(gone, F.col("b") == F.col("x"), "left_anti"))
    else:
        raise RuntimeError(f"matching did not end in {most_rounds} rounds")
    return rest if taken is None else taken


def _match_arrivals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches rows that come by group and id: each with the least waiting one that differs in one dimension, or it waits."""
    group, waiting = None, {}
    for batch in batches:
        a, b = [], []
        for g, i, cell in zip(batch.column("group").to_pylist(), batch.column("id").to_pylist(), map(tuple, batch.column("cell").to_pylist()), strict=True):
            if g != group:
                group, waiting = g, {}
            # cells are few, and no two that hold waiting rows differ in one dimension alone
            near = [c for c, ids in waiting.items() if ids[0] < i and sum(x != y for x, y in zip(c, cell, strict=True)) == 1]
            if near:
                best = min(near, key=lambda c: waiting[c][0])
                a.append(waiting[best].popleft())
                b.append(i)
                if not waiting[best]:
                    del waiting[best]
            else:
                waiting.setdefault(cell, deque()).append(i)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def contrast_matching_by_group(rows: DataFrame, key: str, group: str, dimensions: list[str]) -> DataFrame:
    """contrast_matching() of the rows of equal `group` that differ in exactly one dimension, without making the pairs.

    A scan in order of (a, b) gives each row the least later partner that no smaller row has; so does taking rows as
    they come and giving each to the least one waiting. Groups are dealt to tasks and sorted there; a task holds
    the ids that wait. key: long. Rows with a null value match nothing; rows with ids that stand in several groups or cells go through pairs.
    """
    whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (key, group, *dimensions)])
    known = rows.where(whole).select(F.col(key).cast("long").alias("id"), F.col(group).alias("group"), F.array(*[F.col(d).cast("string") for d in dimensions]).alias("cell")).distinct()
    if not known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return contrast_matching(contrast_pairs(rows, key, group, dimensions))
    return dealt(known, "group").sortWithinPartitions("group", "id").mapInArrow(_match_arrivals, "a long, b long")


def contrast_pairs(rows: DataFrame, key: str, group: str, dimensions: list[str]) -> DataFrame:
    """Pairs (a < b) of rows of equal `group` that differ in exactly one dimension."""
    out = None
    for d in dimensions:
        rest = [x for x in dimensions if x != d]
        left = rows.select(F.col(key).alias("a"), F.col(d).alias("u"), group, *rest)
        right = rows.select(F.col(key).alias("b"), F.col(d).alias("v"), group, *rest)
        p = left.join(right, [group, *rest]).where("a < b and u <> v").select("a", "b")
        out = p if out is None else out.unionByName(p)
    return out


def repeat_agreement(primary: DataFrame, repeat: DataFrame, key: str, dimensions: list[str]) -> DataFrame:
    """Agreement of two annotations of the same units: one row a dimension and one for all of them."""
    second = repeat.select(key, *[F.col(d).alias(f"r_{d}") for d in dimensions])
    both = primary.select(key, *dimensions).join(second, key)
    same = [F.col(d).eqNullSafe(F.col(f"r_{d}")).cast("double") for d in dimensions]
    exact = reduce(lambda a, b: a * b, same)
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), s.alias("same")) for d, s in [*zip(dimensions, same, strict=True), ("all", exact)]])).alias("x")
    return both.select(each).select("x.dimension", "x.same").groupBy("dimension").agg(F.count("*").alias("n_pairs"), F.sum("same").cast("long").alias("agreed"), F.bround(F.avg("same"), 6).alias("rate"))


def mapping_agreement(pairs: DataFrame, dimensions: list[str]) -> DataFrame:
    """measure, n, rate over annotation pairs (structs primary and repeat of result and the dimensions): same
    class, same mapping, both routed alike, complete against partial, both contributing; and each dimension, over pairs
    that both say something of it (null where none does)."""
    p, r = (lambda c: F.col(f"primary.{c}")), (lambda c: F.col(f"repeat.{c}"))
    every = reduce(lambda a, b: a & b, [p(d).eqNullSafe(r(d)) for d in dimensions])
    complete = lambda x: x("result") == "complete"
    tests = [
        ("same class", p("result") == r("result"), None), ("same mapping", (p("result") == r("result")) & every, None), ("same routing", (p("result") == "partial") == (r("result") == "partial"), None),
        ("complete against partial", (complete(p) & (r("result") == "partial")) | ((p("result") == "partial") & complete(r)), None), ("inventory unaffected", (complete(p) == complete(r)) & (~complete(p) | every), None),
        *[(f"same {d}", p(d) == r(d), p(d).isNotNull() & r(d).isNotNull()) for d in dimensions],
    ]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.when(F.lit(True) if among is None else among, t).cast("double").alias("same")) for n, t, among in tests])).alias("x")
    return pairs.select(each).groupBy("x.measure").agg(F.count("x.same").alias("n"), F.sum("x.same").cast("long").alias("agreed"), F.bround(F.avg("x.same"), 6).alias("rate"))


def contribution_changes(pairs: DataFrame, primary: str = "primary_cells", repeat: str = "repeat_cells") -> DataFrame:
    """pairs with the canonical cells that would come in (added) or go (removed) if the repeated annotation took the
    primary one's place, and whether that changes the inventory. Both columns hold the cells contributed: none unless complete."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(F.col(primary), none), F.coalesce(F.col(repeat), none)
    out = pairs.withColumn("added", F.array_sort(F.array_except(b, a))).withColumn("removed", F.array_sort(F.array_except(a, b)))
    return out.withColumn("affects_inventory", (F.size("added") > 0) | (F.size("removed") > 0))


def admissible_grid(cells: DataFrame, frames: DataFrame, admissible) -> DataFrame:
    """Every (cell, frame) that the predicate admits. Frames are a small declared table."""
    return cells.crossJoin(frames).where(admissible)


def whole_grid(cells: DataFrame, frames: DataFrame, admissible, key: str = "cell_id") -> DataFrame:
    """admissible_grid(), in which every cell must have a row."""
    from lucerna.operators.guards import require_none

    grid = admissible_grid(cells, frames, admissible)
    require_none(cells.select(key).join(grid.select(key), key, "left_anti"), "cells without a realisation")
    return grid


def keyed_delta(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys added, removed or changed from left to right."""
    a = left.select(*keys, F.struct(*values).alias("l"), F.lit(True).alias("in_left"))
    b = right.select(*keys, F.struct(*values).alias("r"), F.lit(True).alias("in_right"))
    change = F.when(F.col("in_left").isNull(), "added").when(F.col("in_right").isNull(), "removed").when(~F.col("l").eqNullSafe(F.col("r")), "changed")
    return a.join(b, keys, "full").select(*keys, change.alias("change")).where("change is not null")


def invariance(left: DataFrame, right: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Whether two runs share ids, and each value on the shared ids: one row a property."""
    a = left.select(key, *values, F.lit(1).alias("in_left"))
    b = right.select(key, *[F.col(v).alias(f"r_{v}") for v in values], F.lit(1).alias("in_right"))
    both = a.join(b, key, "full")
    shared = F.col("in_left").isNotNull() & F.col("in_right").isNotNull()
    tests = [("ids", shared), *[(v, ~shared | F.col(v).eqNullSafe(F.col(f"r_{v}"))) for v in values]]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("property"), F.coalesce(t, F.lit(False)).alias("same")) for n, t in tests])).alias("x")
    return both.select(each).select("x.property", "x.same").groupBy("property").agg(F.every("same").alias("invariant"), F.sum((~F.col("same")).cast("long")).alias("differing"))


def schedule_audit(events: DataFrame, first: int = 1) -> DataFrame:
    """By learner: whether sequence numbers are 1..n without repeats, and the spread of repetitions of its items."""
    per_item = events.groupBy("learner", "item_id").agg(F.count("*").alias("times"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.sum("seq").alias("total"))
    out = per_item.groupBy("learner").agg(F.sum("times").alias("n_events"), F.count("*").alias("n_items"), F.min("times").alias("least_times"), F.max("times").alias("most_times"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"))
    whole = (F.col("lo") == first) & (F.col("hi") == F.col("n_events")) & (2 * F.col("total") == F.col("n_events") * (F.col("n_events") + 1))
    return out.select("learner", "n_events", "n_items", "least_times", "most_times", whole.alias("contiguous"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row that two tables share if they hold the same rows, in any order: count and two sums of hashes."""
    row = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    digits = lambda at: F.conv(F.substring(F.sha2(row.cast("binary"), 256), at, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(digits(1)).cast("string").alias("sum_a"), F.sum(digits(13)).cast("string").alias("sum_b"))


def private_alignment(observed: DataFrame, private: DataFrame, learner: str = "learner", event: str = "event_id", seq: str = "seq", features: str | None = None) -> DataFrame:
    """By learner: events in both tables, in one only, at another place in the order of the two, and (given the column
    `features`) with other features than the private table says; aligned if none is. Events are unique in each."""
    take = [learner, event, seq, *([features] if features else [])]
    a = observed.select(*take).withColumn("_in_a", F.lit(True))
    b = private.select(F.col(learner).alias("_learner"), F.col(event).alias("_event"), F.col(seq).alias("_seq"), *([F.col(features).alias("_features")] if features else []), F.lit(True).alias("_in_b"))
    both = a.join(b, (F.col(learner) == F.col("_learner")) & (F.col(event) == F.col("_event")), "full")
    matched = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    count = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name)
    other = ~F.col(features).eqNullSafe(F.col("_features")) if features else F.lit(False)
    out = both.groupBy(F.coalesce(learner, "_learner").alias(learner)).agg(
        count(matched, "n_matched"), count(F.col("_in_b").isNull(), "observed_only"), count(F.col("_in_a").isNull(), "private_only"), count(matched & ~F.col(seq).eqNullSafe(F.col("_seq")), "moved"), count(matched & other, "other_features"),
    )
    return out.withColumn("aligned", F.col("observed_only") + F.col("private_only") + F.col("moved") + F.col("other_features") == 0)


#: Two primes under 2^31 and bases under them: the digest in order is a polynomial in each.
MODULI = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 69_621))
#: Positions are under 2 to this power.
_POSITION_BITS = 45


def _power(base: int, prime: int, exponent: Column) -> Column:
    """base ** exponent modulo prime, by the bits of the exponent; products of two numbers under 2^31 fit a long."""
    out, square = F.lit(1).cast("long"), base
    for bit in range(_POSITION_BITS):
        out = out * F.when(F.shiftright(exponent, bit).bitwiseAND(F.lit(1)) == 1, F.lit(square)).otherwise(F.lit(1)) % F.lit(prime)
        square = square * square % prime
    return out


def ordered_digest(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """One row (n_rows, hash_a, hash_b) that depends on the rows' values and on their order.

    Each hash is the sum of row hash * base ** position modulo a prime, so rows are summed wherever they lie, and
    digests of tables that follow each other combine by combined(). `order` is unique together with the columns.
    """
    row = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    rows = with_positions(df.select(*order, F.sha2(row.cast("binary"), 256).alias("_h")), [*order, "_h"])
    part = lambda at: F.conv(F.substring("_h", at, 7), 16, 10).cast("long")
    term = lambda i: F.sum((part(1 + 7 * i) * _power(MODULI[i][1], MODULI[i][0], F.col("position")) % MODULI[i][0]).cast("decimal(38,0)"))
    out = rows.agg(F.count("*").alias("n_rows"), term(0).alias("a"), term(1).alias("b"))
    return out.select("n_rows", *[F.coalesce(F.col(c) % m[0], F.lit(0)).cast("long").alias(f"hash_{c}") for c, m in zip("ab", MODULI, strict=True)])


def combined(first: tuple[int, int, int], second: tuple[int, int, int]) -> tuple[int, int, int]:
    """The digest of a table followed by another, from their digests (n_rows, hash_a, hash_b)."""
    n = first[0]
    return (n + second[0], *[(h + k * pow(base, n, prime)) % prime for h, k, (prime, base) in zip(first[1:], second[1:], MODULI, strict=True)])


def repeats_over(df: DataFrame, keys: list[str], name: str = "n_same") -> DataFrame:
    """Each row with the number of rows of its key."""
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*keys)))
