"""Global positions without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.sources.cuts import cut


def with_positions(df: DataFrame, keys: list[str], name: str = "position") -> DataFrame:
    """Add 0-based positions in the order of `keys` (unique together): ranges are sorted apart, and each
    starts at the number of rows before it, a table of one row a range. The ranges are checkpointed: cut anew
    after a loss they could differ, and the starts with them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()))
    sizes = parts.groupBy("_range").count()
    starts = sizes.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_start"))
    here = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    return parts.join(starts, "_range").withColumn(name, F.col("_start") + here).drop("_range", "_start")
