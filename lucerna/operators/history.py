"""Ordered histories: opportunity numbers, pre-event rates that leave the event itself out, splits and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions import scans
from lucerna.functions.ids import smoothed


def _before(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)


def long_form(projected: DataFrame) -> DataFrame:
    return projected.select("learner", "seq", "correct", F.explode("kc_ids").alias("kc"))


def with_earlier(rows: DataFrame) -> DataFrame:
    """Blocked rows with what the learner's earlier blocks hold: answers _n and successes _s, and by label the rows k,
    answers n and successes s in the map _by_kc."""
    far = rows.join(scans.spread_keys(rows, "learner"), "learner", "left_semi")
    sums = [F.count("*").alias("k"), F.count("correct").alias("n"), _zero(F.sum("correct")).alias("s")]
    overall = scans.earlier(far.groupBy("learner", "_block").agg(*sums), ["learner"], ["k", "n", "s"]).select("learner", "_block", F.col("n").alias("_n"), F.col("s").alias("_s"))
    by_kc = far.select("learner", "_block", "correct", F.explode("kc_ids").alias("kc")).groupBy("learner", "_block", "kc").agg(*sums)
    # a label may be missing from the block at hand, so what is carried is known for every block of the learner
    blocks = far.select("learner", "_block").distinct().join(by_kc.select("learner", "kc").distinct(), "learner")
    every = blocks.join(by_kc, ["learner", "_block", "kc"], "left").select("learner", "kc", "_block", *[_zero(F.col(c)).alias(c) for c in ("k", "n", "s")])
    as_map = F.map_from_entries(F.collect_list(F.struct("kc", F.struct("k", "n", "s")))).alias("_by_kc")  # as many as labels
    maps = scans.earlier(every, ["learner", "kc"], ["k", "n", "s"]).groupBy("learner", "_block").agg(as_map)
    return rows.join(overall.join(maps, ["learner", "_block"], "left"), ["learner", "_block"], "left")


def _zero(c) -> Column:
    return F.coalesce(c, F.lit(0))


def _of_label(what: str, several: bool) -> Column:
    """What earlier blocks hold of the row's label."""
    return _zero(F.try_element_at("_by_kc", F.col("kc"))[what]) if several else F.lit(0)


def opportunity_index(projected: DataFrame) -> DataFrame:
    """learner, seq, kc, opportunity: 1-based number of the learner's event with the label."""
    rows, several = scans.blocked(projected.select("learner", "seq", "correct", "kc_ids"), ["learner"])
    rows = with_earlier(rows) if several else rows
    long = rows.select("learner", "_block", "seq", *(["_by_kc"] if several else []), F.explode("kc_ids").alias("kc"))
    w = Window.partitionBy("learner", "_block", "kc").orderBy("seq")
    return long.select("learner", "seq", "kc", (F.row_number().over(w) + _of_label("k", several)).cast("long").alias("opportunity"))


def with_overall_rate(rows: DataFrame, several: bool, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Blocked rows (those of with_earlier, if there are several blocks) with overall_rate, the learner's smoothed success
    before the event."""
    own = _before("learner", "_block")
    n, s = (_zero(F.col("_n")), _zero(F.col("_s"))) if several else (F.lit(0), F.lit(0))
    return rows.withColumn("overall_rate", smoothed(_zero(F.sum("correct").over(own)) + s, F.count("correct").over(own) + n, alpha, beta))


def prior_rates(projected: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """projected with overall_rate, active_rate (overall_rate without labels) and mean_log_opportunity.

    Rows are dealt once, by learner and block; the windows run inside blocks and the labels' means come back to
    the event by grouping, not by a join, which would deal all rows anew. Only the row of an event's first label carries the event.
    (learner, seq) is unique.
    """
    rows, several = scans.blocked(projected, ["learner"])
    whole = with_overall_rate(with_earlier(rows) if several else rows, several, alpha, beta)
    event = F.struct(*projected.columns, "overall_rate")
    each = whole.select("learner", "_block", "seq", "correct", *(["_by_kc"] if several else []), event.alias("_event"), F.posexplode_outer("kc_ids").alias("_place", "kc"))
    long = each.withColumn("_event", F.when(F.coalesce("_place", F.lit(0)) == 0, F.col("_event"))).drop("_place")
    label = _before("learner", "_block", "kc")
    seen, right = F.count("correct").over(label) + _of_label("n", several), _zero(F.sum("correct").over(label)) + _of_label("s", several)
    # a label that is null stands for an event without labels
    rates = long.select("learner", "_block", "seq", "_event", F.when(F.col("kc").isNotNull(), smoothed(right, seen, alpha, beta)).alias("rate"), F.when(F.col("kc").isNotNull(), F.log1p(seen.cast("double"))).alias("seen"))
    out = rates.groupBy("learner", "_block", "seq").agg(F.first("_event", ignorenulls=True).alias("e"), F.avg("rate").alias("active"), F.avg("seen").alias("mean_log"))
    return out.select("e.*", F.coalesce("active", "e.overall_rate").alias("active_rate"), F.coalesce("mean_log", F.lit(0.0)).alias("mean_log_opportunity"))


def chronological_split(events: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """events with dataset_split by the learner's own sequence; three or more events leave no part empty."""
    n = F.count("*").over(Window.partitionBy("learner"))
    first, second = (n * train).cast("long"), (n * (train + validation)).cast("long")
    train_end = F.when(n >= 3, F.least(F.greatest(first, F.lit(1)), n - 2)).otherwise(F.greatest(first, F.lit(1)))
    ends = events.withColumn("_n", n).withColumn("_train", train_end)
    validation_end = F.when(F.col("_n") >= 3, F.least(F.greatest(second, F.col("_train") + 1), F.col("_n") - 1)).otherwise(F.col("_n"))
    split = F.when(F.col("seq") <= F.col("_train"), "train").when(F.col("seq") <= validation_end, "validation").otherwise("test")
    return ends.withColumn("dataset_split", split).drop("_n", "_train")


def sequence_gaps(events: DataFrame, seq: str = "seq", time: str = "ts") -> DataFrame:
    """By learner: events, sequence steps other than 1, and times that don't rise. Steps are looked at inside blocks; the first
    event of a later block meets the last one of those before it."""
    rows, several = scans.blocked(events.select("learner", F.col(seq).alias("_seq"), F.col(time).alias("_time")), ["learner"], "_seq")
    w = Window.partitionBy("learner", "_block").orderBy("_seq")
    previous, seq_before, time_before = rows, F.lag("_seq").over(w), F.lag("_time").over(w)
    if several:
        last = rows.groupBy("learner", "_block").agg(F.max(F.struct("_seq", "_time")).alias("_last"))
        before = Window.partitionBy("learner").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        far = last.join(scans.spread_keys(rows, "learner"), "learner", "left_semi").select("learner", "_block", F.max("_last").over(before).alias("_last"))
        previous = rows.join(far, ["learner", "_block"], "left")
        seq_before, time_before = F.coalesce(seq_before, "_last._seq"), F.coalesce(time_before, F.when(seq_before.isNull(), F.col("_last._time")))
    seq_before = F.coalesce(seq_before, F.lit(0))
    steps = previous.select("learner", (F.col("_seq") - seq_before != 1).cast("int").alias("gap"), F.coalesce(F.col("_time") <= time_before, F.lit(False)).cast("int").alias("stuck"))
    return steps.groupBy("learner").agg(F.count("*").alias("n_events"), F.sum("gap").alias("gaps"), F.sum("stuck").alias("not_rising"))


def first_by(df: DataFrame, keys: list[str], order: list[str], take: list[str]) -> DataFrame:
    """The first row of each group by `order`, as a combining aggregate rather than a window."""
    least = F.min(F.struct(*order, *[c for c in take if c not in order])).alias("least")
    return df.groupBy(*keys).agg(least).select(*keys, *[F.col(f"least.{c}").alias(c) for c in take])
