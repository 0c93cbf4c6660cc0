"""Running sums of ordered keys, however many rows a key has.

A key's rows are cut into blocks by their sequence numbers; a block is summed (or run through) alone, and what the
earlier blocks of its key hold is carried to it. A window or an array thus never holds more than a block, and
a key of many rows spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lucerna.sources.cuts import cut, dealt

#: Sequence numbers of one block; unique numbers bound its rows.
BLOCK = 32_768
#: Values that are run through at a time.
RUN = 64


def blocked(df: DataFrame, keys: list[str], order: str = "seq") -> tuple[DataFrame, bool]:
    """df with _block, checkpointed and then dealt by keys and block (a checkpoint forgets how its rows were dealt), so that
    what follows by keys and block isn't shuffled again; and whether any row lies outside the first block, seen on the
    way. Only then is there anything to carry. Rows are counted on the way too, and dealt over as many tasks as they need."""
    seen = Observation()
    block = F.floor(F.col(order) / BLOCK)
    rows = cut(df.withColumn("_block", block).observe(seen, F.max(F.col("_block") != 0).alias("several"), F.count("*").alias("n")))
    return dealt(rows, *keys, "_block", rows=seen.get["n"]), bool(seen.get["several"])


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _block, dealt into ranges of `order`, whatever values its keys have. Checkpointed: cut anew after a loss
    the ranges could differ, and what they carry with them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("_block", F.spark_partition_id()))


def earlier(totals: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """keys, _block and the sums over the key's blocks before it, for blocks that have any. totals: a row a key and block."""
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "_block", *[F.sum(s).over(w).alias(s) for s in sums]).where(F.col(sums[0]).isNotNull())


def with_carried(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what earlier() found for their keys and block, null where there is nothing; null keys meet."""
    right = carried.select(*[F.col(k).alias(f"_right_{i}") for i, k in enumerate([*keys, "_block"])], *[c for c in carried.columns if c not in (*keys, "_block")])
    same = [F.col(k).eqNullSafe(F.col(f"_right_{i}")) for i, k in enumerate([*keys, "_block"])]
    return rows.join(right, reduce(lambda a, b: a & b, same), "left").drop(*[f"_right_{i}" for i in range(len(same))])


def spread_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys that have rows in other blocks than the first: only they can carry anything."""
    return rows.where("_block <> 0").select(key).distinct()


def running(values: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The state before each value of an array, of the Spark type `kind`: start, step(start, v0), and so on. By runs, so
    that arrays that grow stay short."""
    through = lambda first, part: F.aggregate(part, first, step)
    none = F.array().cast(f"array<{kind}>")
    grow = lambda first, parts, next_: F.aggregate(parts, F.struct(first.alias("s"), none.alias("out")), lambda a, v: F.struct(next_(a["s"], v).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")), lambda a: a["out"])
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda i: F.slice(values, i * RUN + 1, RUN))
    started = F.arrays_zip(runs.alias("run"), grow(start, runs, through).alias("start"))
    return F.when(F.size(values) <= RUN, grow(start, values, step)).otherwise(F.flatten(F.transform(started, lambda r: grow(r["start"], r["run"], step))))
