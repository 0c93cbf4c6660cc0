"""Guards between tables: exact covers, lookups, pairs and partitions that fail instead of losing rows.

A guard that needs a whole table looks at a few of its offending rows only; a guard on single rows is part
of the plan and fails the job that reads a bad one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.operators.labels import missing_keys, repeated_keys
from lucerna.sources.cuts import dealt
from lucerna.sources.files import checked

SPLITS = ["development", "compositional_holdout", "novel_feature_holdout"]


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first n rows by `order`: for reports and messages."""
    return df.orderBy(*order).limit(n)


def capped_errors(df: DataFrame, key: str, errors: str, n: int = 100) -> DataFrame:
    """One row: how many errors there are, and the first n as key and text, in order."""
    each = df.select(F.col(key).alias("_key"), F.explode(errors).alias("_error"))
    shown = preview(each, ["_key", "_error"], n).agg(F.array_sort(F.collect_list(F.struct("_key", "_error"))).alias("shown"))  # n rows at most
    return each.agg(F.count("*").alias("n_errors")).crossJoin(shown).select("n_errors", F.transform("shown", lambda x: F.concat_ws(": ", x["_key"].cast("string"), x["_error"])).alias("errors"))


def require_none(df: DataFrame, message: str, shown: int = 5) -> None:
    """Fail if there is any row; the message shows a few of them."""
    found = [tuple(r) for r in df.limit(shown).collect()]
    if found:
        raise ValueError(f"{message}: {found}")


def lookup(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows with the columns of `known` (one row a key); a row with an unknown key fails the job."""
    joined = rows.join(known.withColumn("_known", F.lit(True)), key, "left")
    return checked(joined, F.col("_known"), f"unknown {key}").drop("_known")


def exact_projection(events: DataFrame, labelled: DataFrame) -> DataFrame:
    """Events with their item's labels. Items must be the same both ways and each once, event ids too; items
    without labels stay, with none."""
    require_none(repeated_keys(labelled, ["item_id"]), "items with several label rows")
    require_none(missing_keys(events, labelled, "item_id"), "events and labels cover different items")
    require_none(repeated_keys(events, ["event_id"]), "repeated event ids")
    return events.join(labelled.select("item_id", "kc_ids"), "item_id")


def paired_units(units: DataFrame, outputs: DataFrame, key: str = "unit_id", primary: str = "duplicate_of") -> DataFrame:
    """Each repeated unit with its primary's and its own output, as structs; a pair of which one is missing fails the job."""
    out = lambda name: outputs.select(F.col(key).alias(f"_{name}"), F.struct(*[c for c in outputs.columns if c != key]).alias(name))
    pairs = units.where(F.col(primary).isNotNull()).select(F.col(key).alias("_repeat"), F.col(primary).alias("_primary"))
    both = pairs.join(out("primary"), "_primary", "left").join(out("repeat"), "_repeat", "left")
    return checked(both, F.col("primary").isNotNull() & F.col("repeat").isNotNull(), "incomplete pair").select(F.col("_primary").alias(primary), F.col("_repeat").alias(key), "primary", "repeat")


def paired_predictions(a: DataFrame, b: DataFrame, technique: str) -> DataFrame:
    """learner, correct, a, b of the same events. An event that one side lacks, or whose learner, item or
    outcome differs, fails the job."""
    own = ["learner", "item_id", "correct"]
    left = a.select("event_id", *own, F.col(technique).alias("a"), F.lit(True).alias("_a"))
    right = b.select("event_id", *[F.col(c).alias(f"_{c}") for c in own], F.col(technique).alias("b"), F.lit(True).alias("_b"))
    both = left.join(right, "event_id", "full")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own])
    return checked(checked(both, F.col("_a") & F.col("_b"), "predictions of different events"), same, "events differ").select("event_id", *own, "a", "b")


def partition_by_split(cells: DataFrame, splits: DataFrame) -> DataFrame:
    """cells with their split. The split rows must cover just the cells, name known splits only, and leave
    development some cell."""
    require_none(missing_keys(cells, splits, "cell_id"), "split rows and cells differ")
    require_none(splits.where(~F.coalesce(F.col("canonical_split").isin(SPLITS), F.lit(False))), "unknown splits")
    if splits.where(F.col("canonical_split") == SPLITS[0]).isEmpty():
        raise ValueError("no development cell")
    return cells.join(splits, "cell_id")


def disagreements(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of both tables whose columns differ, with the names of those."""
    other = right.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    differing = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]))
    return left.select(key, *columns).join(other, key).select(key, differing.alias("differing")).where(F.size("differing") > 0)


def in_several(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that more than one group holds."""
    return df.groupBy(key).agg(F.countDistinct(group).alias("n_groups")).where("n_groups > 1")


def multiset_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that the two sides hold different numbers of times; both sides are counted before they meet."""
    count = lambda df, name: df.groupBy(*columns).agg(F.count("*").alias(name))
    a, b = count(left, "n_left"), count(right, "n_right").select(*[F.col(c).alias(f"_{c}") for c in columns], "n_right")
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    both = a.join(b, on, "full").select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in columns], F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return both.where("n_left <> n_right")


def union_streams(streams: dict[str, DataFrame]) -> DataFrame:
    """Event streams as one, each event with the name of its stream."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("stream", F.lit(name)) for name, df in streams.items()])


def edge_changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges that one run alone has, with their side; repeated edges count. Both runs are dealt by edge and counted once."""
    columns = left.columns
    both = dealt(left.withColumn("_one", F.lit(1)).union(right.withColumn("_one", F.lit(-1))), *columns)
    more = both.groupBy(*columns).agg(F.sum("_one").alias("_more")).where("_more <> 0")
    rows = more.withColumn("side", F.when(F.col("_more") > 0, "left_only").otherwise("right_only"))
    return rows.select(*columns, "side", F.explode(F.sequence(F.lit(1), F.abs("_more"))).alias("_copy")).drop("_copy")


def metric_deltas(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Right less left of each metric, for all keys of either run; null where one run has none."""
    other = right.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    return left.select(*keys, *values).join(other, keys, "full").select(*keys, *[(F.col(f"_{v}") - F.col(v)).alias(f"{v}_delta") for v in values])
