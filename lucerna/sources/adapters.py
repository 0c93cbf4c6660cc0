"""The learner-event view of the supplied tables (whole tables: every part, event and line item)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucerna.functions.ids import content_id
from lucerna.functions.rules import Compiler
from lucerna.sources.cuts import sized

DIMENSIONS = ["kind", "size", "brand"]
COMPILER = Compiler({d: d for d in DIMENSIONS})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, cell dimensions, cell_id, operations (the words of the name), price, canonical_split."""
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_type").alias("kind"),
        F.concat(F.lit("S"), F.floor((F.col("p_size") - 1) / 10).cast("string")).alias("size"),
        F.concat(F.lit("B"), (F.substring("p_brand", 7, 4).cast("int") % 3).cast("string")).alias("brand"),
        F.split("p_name", " ").alias("operations"), F.col("p_retailprice").alias("price"),
    )
    return rows.withColumn("cell_id", content_id("CELL", *[F.col(d) for d in DIMENSIONS])).withColumn("canonical_split", _fold())


def _fold():
    band = F.substring("size", 2, 2).cast("int") + F.substring("brand", 2, 2).cast("int")
    return F.when(F.col("kind") == "PROMO", "novel_feature_holdout").when(band % 3 == 0, "compositional_holdout").otherwise("development")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct cells with their fold and number of items."""
    return items(spark, sf_dir).groupBy("cell_id", *DIMENSIONS, "canonical_split").agg(F.count("*").alias("n_items"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: event_id, learner, item_id, seq (1-based by time and id), ts, correct."""
    events = table(spark, sf_dir, "events")
    rows = sized(events.select("event_id", "user_id", "ts", "value", "props"), "user_id", rows=events.count())
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.select(
        "event_id", F.col("user_id").alias("learner"), F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("item_id"),
        F.row_number().over(order).cast("long").alias("seq"), "ts", (F.col("value") >= 35).cast("int").alias("correct"),
    )


#: Order of a learner's line items; unique together.
LINE_ORDER = ["o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def interactions_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as events: learner is the customer, item the part, correct unless returned."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("o_custkey").orderBy(*LINE_ORDER)
    return lines.select(F.col("o_custkey").alias("learner"), F.col("l_partkey").alias("item_id"), F.row_number().over(order).cast("long").alias("seq"), (F.col("l_returnflag") != "R").cast("int").alias("correct"))


#: Values of the clause view of the parts, taken in turn.
CLAUSE_VALUES = {
    "tense": ["present", "past", "NA"], "aspect": ["none", "perfect", "progressive", "perfect_progressive"], "voice": ["active", "passive"], "polarity": ["affirmative", "negative"],
    "clause": ["declarative", "polar_question", "subject_wh_question", "non_subject_wh_question", "imperative"], "modal": ["none", "can", "must"],
    "frame_type": ["transitive", "intransitive", "copular"], "note": ["", "with LET'S NOT", "with LET'S", "an emphatic-DO", "LET + third-person pronoun"],
}


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a clause to realise: item_id, the cell, a frame with its object, and a source note."""
    at = lambda name, e: F.element_at(F.array(*[F.lit(v) for v in CLAUSE_VALUES[name]]), (F.pmod(F.floor(e), F.lit(len(CLAUSE_VALUES[name]))) + 1).cast("int")).alias(name)
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        key.alias("item_id"), at("tense", size / 2), at("aspect", size), at("voice", key / 3), at("polarity", size / 4), at("clause", key), at("modal", size / 7), at("frame_type", key / 7), at("note", key / 2), F.split("p_name", " ")[0].alias("word"),
    )
    return rows.withColumn("object", F.when(F.col("frame_type") == "transitive", F.concat(F.lit("the "), "word")))
