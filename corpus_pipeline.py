"""Corpus pipeline: the stages that turn raw documents into encoded training text.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of documents. Rows are told apart by doc_id, null being an id like others; a null text
counts as empty and comes out of line dedup as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm.common import checkpoint
from lucerna.llm.decontaminate import contamination
from lucerna.llm.line_dedup import drop_repeated_lines
from lucerna.llm.minhash_dedup import near_duplicates
from lucerna.llm.sentencepiece_lattice import encode_texts
from lucerna.llm.toxicity import fit_severity, score_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is less likely than not."""
    model = fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_rows(docs.select(*COLUMNS), model).where(~(F.col("p_toxic") >= 0.5)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars follows the text."""
    out = drop_repeated_lines(docs, carry=["lang", "source"])
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; null is larger than any.

    Rows whose ids are null or repeat are told apart by id and text; rows equal in both are copies like
    others. Documents without words link with nothing and stay.
    """
    rows = docs.select(*COLUMNS)
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if ids.isEmpty():
        kept = near_duplicates(rows).where("kept").select(F.col("doc_id").alias("k"))
        return rows.join(kept, F.col("doc_id") == F.col("k"), "left_semi")
    rows = rows.withColumn("_key", F.xxhash64("doc_id", "text"))
    found = near_duplicates(rows.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_k"), "component_id", (F.col("n_shingles") > 0).alias("words")).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key"))
    own = checkpoint(rows.select("doc_id", "_key").distinct().join(found, F.col("_key") == F.col("_k")).groupBy("component_id").agg(first.alias("first"), F.max("words").alias("words")).select(F.col("first._key").alias("k"), "words"))
    kept = rows.join(own, F.col("_key") == F.col("k"))
    # equal rows of one key are one document
    single = kept.where("words").groupBy("_key").agg(*[F.first(c).alias(c) for c in COLUMNS])
    return single.select(*COLUMNS).unionByName(kept.where("not words").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    hit = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("size(hit_words) > 0").select(F.col("doc_id").alias("k"), F.col("text_hash").alias("h"))
    same = F.col("doc_id").eqNullSafe(F.col("k")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("h"))
    return docs.select(*COLUMNS).join(hit, same, "left_anti")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded documents."""
    return encode_texts(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("SentencePiece encoding", sentencepiece)]
#: No SQL states the fitted severity of the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table, each on what the last one wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
