"""Scans, sinks and guards at the edges of the library; Parquet is used between stages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lucerna.sources.cuts import cut


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; blank lines are skipped, anything else fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_table(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The rows of an array field of one JSON document."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(field).alias("row")).select("row.*")


def write_jsonl(df: DataFrame, path: str, sort_keys: bool = False) -> None:
    """UTF-8 lines with nulls kept, columns by name if sort_keys."""
    out = df.select(*sorted(df.columns)) if sort_keys else df
    out.write.option("ignoreNullFields", "false").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A one-row report as one JSON object; more or fewer rows are an error."""
    if len(df.head(2)) != 1:
        raise ValueError("a report has one row")
    df.coalesce(1).write.option("ignoreNullFields", "false").json(path)


def write_wide_csv(df: DataFrame, path: str, key: str) -> None:
    df.orderBy(key).write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(position, id): one id a line in file order (files by path), blank lines dropped.

    Files are read in their splits, in as many tasks as there are. A line's place is its file, its split's offset and its
    number within the split; splits start where the ids before them end, so only their counts are put in order.
    """
    where = F.col("_metadata")
    lines = spark.read.text(path).select(F.trim("value").alias("id"), where["file_path"].alias("file"), where["file_block_start"].alias("start")).where("id <> ''")
    # numbers rise within a task, and a split is read by one task from its first line on; cut keeps both readings the same
    numbered = cut(lines.withColumn("_number", F.monotonically_increasing_id()))
    splits = numbered.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("_number").alias("_first"))
    before = lambda *keys: Window.partitionBy(*keys).orderBy("file" if not keys else "start").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("file").agg(F.sum("n").alias("n")).select("file", F.coalesce(F.sum("n").over(before()), F.lit(0)).alias("_file"))  # a row a file
    starts = splits.join(files, "file").select("file", "start", "_first", (F.col("_file") + F.coalesce(F.sum("n").over(before("file")), F.lit(0))).alias("_start"))
    return numbered.join(starts, ["file", "start"]).select((F.col("_start") + F.col("_number") - F.col("_first") + 1).alias("position"), "id")


def write_id_list(df: DataFrame, path: str, position: str = "position", id_col: str = "id") -> None:
    df.orderBy(position).select(F.col(id_col).cast("string").alias("value")).coalesce(1).write.text(path)


def require_digest(spark: SparkSession, path: str, sha256: str) -> str:
    """Fail unless the file's SHA-256 is the declared one."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if found != sha256.lower():
        raise ValueError(f"{path} has SHA-256 {found}, not {sha256}")
    return found


def require_count(df: DataFrame, expected: int, what: str = "rows") -> DataFrame:
    """df, read once into the checkpoint folder and counted on the way; another count than `expected` is an error."""
    seen = Observation()
    kept = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    if seen.get["n"] != expected:
        raise ValueError(f"{seen.get['n']} {what}, not {expected}")
    return kept


def write_counted(df: DataFrame, path: str, expected: int, what: str = "rows") -> None:
    """Write df as Parquet if it has `expected` rows, counted as they are written. They go to a folder beside the path
    first, which takes the path's name after the check only: a wrong count publishes nothing. The path must be new."""
    spark, seen, staged = df.sparkSession, Observation(), f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        raise ValueError(f"{path} exists")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(staged)
    waiting = spark._jvm.org.apache.hadoop.fs.Path(staged)
    if seen.get["n"] != expected:
        files.delete(waiting, True)
        raise ValueError(f"{seen.get['n']} {what}, not {expected}")
    if not files.rename(waiting, target):
        raise OSError(f"{staged} couldn't be renamed to {path}")


def write_by_class(df: DataFrame, path: str, column: str) -> None:
    df.write.partitionBy(column).parquet(path)


def checked(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Rows pass through; one that breaks the condition, or leaves it null, fails the job when it is read."""
    flag = F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.where(flag)
