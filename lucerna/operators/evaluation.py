"""Metrics by technique, split and scope; ranking quality with ties; calibration; paired bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions import scans
from lucerna.functions.ids import clipped, hash_uniform
from lucerna.functions.positions import with_positions
from lucerna.sources.cuts import cut, dealt

EDGE = 1e-6


def _kept(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p", clipped(F.col("prediction"), EDGE, 1 - EDGE))


def long_predictions(predictions: DataFrame, techniques: list[str], keys: list[str]) -> DataFrame:
    """keys, technique, prediction, correct."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("technique"), F.col(t).alias("prediction")) for t in techniques])).alias("x")
    return predictions.select(*keys, "correct", each).select(*keys, "correct", "x.technique", "x.prediction")


def metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, log loss, Brier score, accuracy at 0.5 and means by keys; predictions are clipped first."""
    y = F.col("correct")
    loss = -F.log(F.when(y == 1, F.col("p")).otherwise(1 - F.col("p")))
    return _kept(rows).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(loss).alias("log_loss"), F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier"),
        F.avg(((F.round("p", 12) >= 0.5).cast("int") == y).cast("double")).alias("accuracy"), F.avg("p").alias("mean_prediction"), F.avg(y.cast("double")).alias("observed_rate"),
    )


def over_grid(found: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics for every key of the grid: n is 0 and the rest null where no row was."""
    return grid.join(found, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Chance that a success outranks a failure, ties (equal doubles) half; null with one class. Equal scores are
    counted first; the distinct ones are dealt into ranges, and each range starts with the failures below it."""
    counts = _kept(rows).groupBy(*keys, F.col("p").alias("score")).agg(F.sum("correct").alias("pos"), F.sum(1 - F.col("correct")).alias("neg"))
    parts = scans.ranged(counts, [*keys, "score"])
    below = scans.earlier(parts.groupBy(*keys, "_block").agg(F.sum("neg").alias("neg")), keys, ["neg"]).withColumnRenamed("neg", "_below")
    own = Window.partitionBy(*keys, "_block").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("neg").over(own), F.lit(0)) + F.coalesce("_below", F.lit(0))
    won = scans.with_carried(parts, below, keys).withColumn("won", F.col("pos") * (2 * lower + F.col("neg")))
    total = won.groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return total.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("won") / 2 / F.col("n_pos") / F.col("n_neg")).alias("auc"))


def ece(rows: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed. Bins are found by comparing with
    their edges, since multiplying rounds differently."""
    edges = [i / bins for i in range(1, bins)]
    number = sum(((F.round("p", 12) >= F.lit(e)).cast("int") for e in edges), F.lit(0))
    per = _kept(rows).withColumn("bin", number).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg(F.col("correct").cast("double")).alias("mo"))
    return per.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("mo"))) / F.sum("n")).alias("ece"), F.count("*").alias("bins_used"))


def paired_bootstrap(pairs: DataFrame, repetitions: int = 1000, seed: int = 17) -> DataFrame:
    """Difference of mean log loss of two predictions (a - b) of the same events, with 2.5 and 97.5 per
    cent quantiles over resampled learners. Events are summed by learner first; the draws are keyed hashes, a row
    each, which SQL can restate; bootstrap_by_range draws counts instead and is the form for many learners."""
    clip = lambda c: clipped(F.col(c), EDGE, 1 - EDGE)
    loss = lambda c: -F.log(F.when(F.col("correct") == 1, clip(c)).otherwise(1 - clip(c)))
    per = cut(pairs.groupBy("learner").agg(F.sum(loss("a") - loss("b")).alias("d"), F.count("*").alias("n")))  # read several times
    numbered = with_positions(per, ["learner"])
    whole = per.agg(F.sum("d").alias("d"), F.sum("n").alias("n"), F.count("*").alias("learners"))
    total = whole.first()
    spark = pairs.sparkSession
    size = total["learners"]
    ids = spark.range(repetitions * size).select((F.col("id") / size).cast("long").alias("rep"), (F.col("id") % size).alias("draw"))
    picks = ids.select("rep", F.least(F.floor(hash_uniform(F.lit(seed), F.col("rep"), F.col("draw")) * size).cast("long"), F.lit(size - 1)).alias("position"))
    # draws meet their learners unsorted and uncounted: a task holds its learners and a sum a repetition. A draw is two
    # numbers, so a task takes 16 times as many as of other rows
    met = dealt(picks, "position", rows=repetitions * size // 16).join(numbered.hint("shuffle_hash"), "position")
    means = met.groupBy("rep").agg((F.sum("d") / F.sum("n")).alias("mean"))
    q = means.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    return _compared(q, whole)


def _compared(quantiles: DataFrame, whole: DataFrame) -> DataFrame:
    """The report of a bootstrap from its two rows: quantiles of the means, and sums over all learners."""
    out = quantiles.crossJoin(F.broadcast(whole)).select(F.col("learners").alias("n_learners"), F.col("n").alias("n_events"), (F.col("d") / F.col("n")).alias("difference"), "low", "high")
    return out.withColumn("direction", F.when(F.col("high") < 0, "a better").when(F.col("low") > 0, "b better").otherwise("unclear"))


#: Learners of one leaf of the tree of draws.
LEAF = 1024


def draws(size: int, lo: int, hi: int, repetitions: int, seed: int) -> np.ndarray:
    """How often each of the positions lo..hi - 1 of `size` is drawn in `size` draws with replacement: a column a position,
    a row a repetition.

    The draws of all positions are split over the halves of the range by binomial draws, keyed by seed and range, down
    to leaves that are dealt by one multinomial draw. So any range of positions finds its own counts alone, and all
    of them together are one exact multinomial draw, however the positions are cut up.
    """
    out = np.zeros((repetitions, hi - lo), np.int64)
    todo = [(0, size, np.full(repetitions, size, np.int64))]
    while todo:
        a, b, counts = todo.pop()
        if b <= lo or a >= hi or a == b:
            continue
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, a, b])))
        if b - a <= LEAF:
            dealt = rng.multinomial(counts, np.full(b - a, 1 / (b - a)))
            x, y = max(a, lo), min(b, hi)
            out[:, x - lo : y - lo] = dealt[:, x - a : y - a]
        else:
            middle = a + (b - a) // 2
            left = rng.binomial(counts, (middle - a) / (b - a))
            todo += [(a, middle, left), (middle, b, counts - left)]
    return out


def bootstrap_by_range(pairs: DataFrame, repetitions: int = 1000, seed: int = 17) -> DataFrame:
    """As paired_bootstrap, with counts drawn where the learners are: a task makes those of its range of learners, for all
    repetitions, and sends one sum a repetition, so that rows don't grow with repetitions x learners."""
    clip = lambda c: clipped(F.col(c), EDGE, 1 - EDGE)
    loss = lambda c: -F.log(F.when(F.col("correct") == 1, clip(c)).otherwise(1 - clip(c)))
    per = pairs.groupBy("learner").agg(F.sum(loss("a") - loss("b")).alias("d"), F.count("*").alias("n"))
    parts = scans.ranged(per, ["learner"])
    sizes = {r["_block"]: r["n"] for r in parts.groupBy("_block").agg(F.count("*").alias("n")).collect()}  # one a partition
    starts = {b: sum(n for c, n in sizes.items() if c < b) for b in sizes}
    size = sum(sizes.values())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros((repetitions, 2))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            at = starts[batch.column("_block")[0].as_py()] if at is None else at
            d, n = np.asarray(batch.column("d")), np.asarray(batch.column("n"), dtype=np.float64)
            for lo in range(0, len(d), LEAF):
                part = slice(lo, min(lo + LEAF, len(d)))
                times = draws(size, at + part.start, at + part.stop, repetitions, seed)
                total += np.stack([times @ d[part], times @ n[part]], axis=1)
            at += len(d)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(repetitions)), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["rep", "d", "n"])

    # a range is one partition, in order of its learners
    drawn = parts.sortWithinPartitions("learner").select("_block", "d", "n").mapInArrow(sums, "rep long, d double, n double")
    means = drawn.groupBy("rep").agg((F.sum("d") / F.sum("n")).alias("mean"))
    q = means.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    whole = parts.agg(F.sum("d").alias("d"), F.sum("n").alias("n"), F.count("*").alias("learners"))
    return _compared(q, whole)


def representation_support(probes: DataFrame) -> DataFrame:
    """By split: items and events, share fully supported, share with a cold label, reuse of supported labels."""
    full = ((F.col("n_cold") == 0) & (F.col("n_supported") > 0)).cast("int")
    return probes.groupBy("canonical_split").agg(
        F.countDistinct("item_id").alias("n_items"), F.count("*").alias("n_events"), F.bround(F.avg(full.cast("double")), 6).alias("fully_supported_rate"),
        F.bround(F.avg((F.col("n_cold") > 0).cast("double")), 6).alias("cold_event_rate"),
        F.bround(F.sum("n_supported") / F.sum(F.col("n_supported") + F.col("n_cold")), 6).alias("component_reuse"),
    )
