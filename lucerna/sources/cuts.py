"""Cutting the lineage of loops through the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one task, where a table is dealt by its counted rows.
TASK_ROWS = 1 << 16


def _shared(spark: SparkSession) -> str:
    """Spark's checkpoint folder; one of our own only in local mode (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Eager checkpoint in spark.checkpoint.dir."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """df dealt by keys over all shuffle partitions. A number that is named isn't lowered by adaptive execution, which
    goes by compressed bytes and so would give a task rows of many times their size. If the number of rows is known, over
    as many partitions as it asks for, so that a task's rows don't grow with the table."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-rows // TASK_ROWS)), *keys)


def sized(df: DataFrame, *keys: str, rows: int) -> DataFrame:
    """df dealt by keys over as many tasks as its number of rows (or a bound of it) asks for, and a task a core at least. What
    a window or join then takes by the same keys stays of one size, which adaptive execution would set by compressed bytes."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
