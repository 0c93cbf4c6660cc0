"""Applying a label policy, and the item-by-label matrix with its diagnostics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions.rules import Compiler, operation_scope
from lucerna.sources.cuts import dealt, sized
from lucerna.sources.files import checked


def label_items(items: DataFrame, compiler: Compiler, rules: list[dict]) -> DataFrame:
    """items with kc_ids: the sorted ids of the rules that hold (possibly none)."""
    return items.withColumn("kc_ids", compiler.labels(rules))


def covered_items(items: DataFrame, compiler: Compiler, rules: list[dict], every: bool = False) -> DataFrame:
    """label_items() of which no development item (or, if `every`, no item at all) may stay without a label:
    one that does fails the job. Holdout items may stay uncovered."""
    needed = F.lit(every) | (F.col("canonical_split") == "development")
    return checked(label_items(items, compiler, rules), ~needed | (F.size("kc_ids") > 0), "an item has no label")


def full_cell_labels(items: DataFrame, cell: str = "cell_id") -> DataFrame:
    """One label a cell, made as the cell occurs."""
    return items.withColumn("kc_ids", F.array(F.concat(F.lit("K_FULL_"), F.regexp_replace(cell, "^CELL_", ""))))


def rule_evidence(items: DataFrame, compiler: Compiler, rules: list[dict], key: str = "item_id") -> DataFrame:
    """One row for each item, rule and leaf of the rule: expected and actual values and whether they match."""
    every = F.array(*[F.struct(F.lit(r["kc_id"]).alias("kc"), compiler.column(r["rule"]).alias("active"), F.array(*compiler.evidence(r["rule"])).alias("leaves")) for r in rules])
    rows = items.select(key, F.explode(every).alias("r")).select(key, "r.kc", "r.active", F.posexplode("r.leaves").alias("leaf", "e"))
    return rows.select(key, "kc", "active", F.col("leaf").cast("long"), "e.field", "e.expected", "e.actual", "e.matched")


def edges(labelled: DataFrame, key: str = "item_id") -> DataFrame:
    return labelled.select(key, F.explode("kc_ids").alias("kc"))


def rule_table(spark, rules: list[dict]) -> DataFrame:
    """kc, scope (realisation if operations decide, else cell) and rule as text: the declared rules."""
    return spark.createDataFrame([(r["kc_id"], "realisation" if operation_scope(r["rule"]) else "cell", json.dumps(r["rule"], sort_keys=True)) for r in rules], "kc string, scope string, rule string")


def scoped_edges(labelled: DataFrame, rules: list[dict]) -> DataFrame:
    """item_id, kc, scope and rule of each edge."""
    return edges(labelled).join(rule_table(labelled.sparkSession, rules), "kc")


def inventory_members(labelled: DataFrame, sources: DataFrame, rules: list[dict]) -> DataFrame:
    """The sets behind the labels that fired, as rows: kc, kind (cell or source), member and rule. sources:
    (item_id, source_id). Rows rather than arrays, since a label may hold any number of cells and sources."""
    fired = labelled.select("item_id", "cell_id", F.explode("kc_ids").alias("kc"))
    of_cells = fired.select("kc", F.lit("cell").alias("kind"), F.col("cell_id").cast("string").alias("member"))
    of_sources = fired.join(sources.select("item_id", "source_id").distinct(), "item_id").select("kc", F.lit("source").alias("kind"), F.col("source_id").cast("string").alias("member"))
    return of_cells.unionByName(of_sources).distinct().join(rule_table(labelled.sparkSession, rules).select("kc", "rule"), "kc")


def inventory(labelled: DataFrame, rules: list[dict]) -> DataFrame:
    """Labels that fired, with their distinct cells, items and rule number; broadcasts the rule list."""
    spark = labelled.sparkSession
    names = spark.createDataFrame([(r["kc_id"], i) for i, r in enumerate(rules)], "kc string, rule_no long")
    # dealt by item, so that a task meets all rows of its items and counts them without knowing other tasks' items
    fired = dealt(labelled.select("item_id", "cell_id", "kc_ids"), "item_id").select("item_id", "cell_id", F.explode("kc_ids").alias("kc"))
    items = fired.groupBy("item_id", "kc").agg(F.lit(1).alias("one")).groupBy("kc").agg(F.count("item_id").alias("n_items"))
    cells = fired.groupBy("kc", "cell_id").agg(F.lit(1).alias("one")).groupBy("kc").agg(F.count("cell_id").alias("n_cells"), F.min("cell_id").alias("first_cell"))
    return cells.join(items, cells["kc"].eqNullSafe(items["kc"])).drop(items["kc"]).join(names, "kc").select("kc", "n_cells", "n_items", "first_cell", "rule_no")


def wide(labelled: DataFrame, kc_ids: list[str], key: str = "item_id") -> DataFrame:
    """Item by label 0/1 table; an item without labels is a row of zeros."""
    return labelled.select(key, *[F.array_contains("kc_ids", k).cast("int").alias(k) for k in kc_ids])


def matrix_diagnostics(labelled: DataFrame, n_kcs: int, dense: int = 4) -> DataFrame:
    """One row a split and one for all: items, edges, density, uncovered rows, rows over `dense` labels, most labels."""
    n = F.size("kc_ids")
    sums = [F.count("*").alias("n_items"), F.sum(n).alias("n_edges"), F.sum((n == 0).cast("int")).alias("uncovered"), F.sum((n > dense).cast("int")).alias("dense_rows"), F.max(n).cast("long").alias("most_labels")]
    both = labelled.groupBy("canonical_split").agg(*sums).unionByName(labelled.agg(*sums).withColumn("canonical_split", F.lit("all")))
    return both.withColumn("density", F.bround(F.col("n_edges") / (F.col("n_items") * n_kcs), 6))


def matrix_histograms(labelled: DataFrame, rules: list[dict], least: int = 5) -> DataFrame:
    """measure, key, n: items by number of labels, edges by scope, labels of support under `least` and labels of none."""
    held = edges(labelled).groupBy("kc").agg(F.count("*").alias("support"))
    every = rule_table(labelled.sparkSession, rules).select("kc", "scope").join(held, "kc", "left").withColumn("support", F.coalesce("support", F.lit(0)))
    rows = labelled.groupBy(F.size("kc_ids").cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit("row_sum").alias("measure"), "key", "n")
    scopes = every.groupBy(F.col("scope").alias("key")).agg(F.sum("support").alias("n")).select(F.lit("scope_edges").alias("measure"), "key", "n")
    few = every.where(F.col("support") < least).select(F.lit("low_support").alias("measure"), F.col("kc").alias("key"), F.col("support").alias("n"))
    return rows.unionByName(scopes).unionByName(few)


def matrix_integrity(items: DataFrame, labelled: DataFrame, rules: list[dict]) -> DataFrame:
    """check_name, n and PASS or FAIL: empty inputs, repeated ids, items without a label row or the reverse,
    labels that no rule names, and rows whose cell differs."""
    known = labelled.sparkSession.createDataFrame([(r["kc_id"],) for r in rules], "kc string")
    other = labelled.select("item_id", F.col("cell_id").alias("_cell"))
    checks = {
        "no items": items.agg(F.count("*").alias("n")).where("n = 0"), "no labels": labelled.agg(F.count("*").alias("n")).where("n = 0"),
        "repeated items": repeated_keys(items, ["item_id"]), "repeated label rows": repeated_keys(labelled, ["item_id"]), "items not covered both ways": missing_keys(items, labelled, "item_id"),
        "unknown labels": edges(labelled).join(known, "kc", "left_anti"), "cell differs": items.join(other, "item_id").where(~F.col("cell_id").eqNullSafe(F.col("_cell"))),
    }
    out = None
    for name, df in checks.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("status", F.when(F.col("n") == 0, "PASS").otherwise("FAIL"))


def identical_columns(labelled: DataFrame, kc_ids: list[str]) -> DataFrame:
    """Pairs of labels held by the same items. A label's column is summed up by its number of items and two
    independent sums of hashes, so no list of items is gathered; a label of no item has the empty sums."""
    spark = labelled.sparkSession
    every = spark.createDataFrame([(k,) for k in kc_ids], "kc string")
    wide_hash = lambda salt: F.xxhash64(F.lit(salt), "item_id").cast("decimal(38,0)")
    held = edges(labelled).groupBy("kc").agg(F.count("*").alias("n"), F.sum(wide_hash(1)).alias("a"), F.sum(wide_hash(2)).alias("b"))
    signed = every.join(held, "kc", "left").select("kc", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    other = signed.withColumnRenamed("kc", "kc_right")
    return signed.withColumnRenamed("kc", "kc_left").join(other, ["n", "a", "b"]).where("kc_left < kc_right").select("kc_left", "kc_right", F.col("n").alias("n_items"))


def coverage(events: DataFrame, labelled: DataFrame) -> DataFrame:
    """Covered items and events by split, with their share."""
    marked = labelled.select("item_id", "canonical_split", (F.size("kc_ids") > 0).cast("int").alias("covered"))
    per_item = events.groupBy("item_id").agg(F.count("*").alias("n"))
    rows = marked.join(per_item, "item_id", "left").select("canonical_split", "covered", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.groupBy("canonical_split").agg(
        F.count("*").alias("n_items"), F.sum("covered").alias("covered_items"), F.sum("n").alias("n_events"), F.sum(F.col("n") * F.col("covered")).alias("covered_events"),
        F.bround(F.sum("covered") / F.count("*"), 6).alias("item_share"),
    )


def coverage_by_time(projected: DataFrame) -> DataFrame:
    """Covered events and their share by temporal split. projected: dataset_split and kc_ids."""
    covered = (F.size("kc_ids") > 0).cast("long")
    return projected.groupBy("dataset_split").agg(F.count("*").alias("n_events"), F.sum(covered).alias("covered_events"), F.sum(1 - covered).alias("uncovered_events"), F.bround(F.avg(covered.cast("double")), 6).alias("share"))


def rule_support(labelled: DataFrame, split: str = "development") -> DataFrame:
    """Labels with support on one split: items and distinct cells."""
    return labelled.where(F.col("canonical_split") == split).select("item_id", "cell_id", F.explode("kc_ids").alias("kc")).groupBy("kc").agg(F.count("*").alias("n_items"), F.countDistinct("cell_id").alias("n_cells"))


def project(events: DataFrame, labelled: DataFrame, rows: int = 0) -> DataFrame:
    """Events with their item's labels; an event of an unknown item keeps null labels for the guard below. Items are never
    broadcast: a file of some MB may hold labels of some hundred. If the number of events is known, they are dealt by it."""
    events = sized(events, "item_id", rows=rows) if rows else events
    return events.join(labelled.select("item_id", "kc_ids").hint("merge"), "item_id", "left")


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys that only one side has."""
    one, two = left.select(key).distinct(), right.select(key).distinct()
    return one.join(two, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(two.join(one, key, "left_anti").withColumn("side", F.lit("right_only")))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def with_label_vector(df: DataFrame, kc_ids: list[str], column: str = "kc_ids", name: str = "label_vector") -> DataFrame:
    """df with a sparse vector that has 1 at the place in kc_ids of each label of the row; null is no label, unknown
    labels count for nothing. Size and work of a row go with its own labels, not with their number."""
    from pyspark.ml.feature import CountVectorizerModel

    if len(set(kc_ids)) < len(kc_ids) or not kc_ids:
        raise ValueError("labels must be distinct and at least one")
    own = f"{name}_of"
    rows = df.withColumn(own, F.coalesce(F.col(column), F.array().cast("array<string>")))
    return CountVectorizerModel.from_vocabulary(kc_ids, own, name).setBinary(True).transform(rows).drop(own)
