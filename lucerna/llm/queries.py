"""The numbered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm.decontaminate import decontamination_report
from lucerna.llm.embedding_dedup import embedding_dedup
from lucerna.llm.line_dedup import line_dedup
from lucerna.llm.minhash_dedup import near_duplicates
from lucerna.llm.oracles import ORACLES
from lucerna.llm.pii import pii_report
from lucerna.llm.prefix_trie import prefix_trie
from lucerna.llm.quality import quality_scores
from lucerna.llm.quotation import conversations_by_reply
from lucerna.llm.sentencepiece_lattice import encode_texts
from lucerna.llm.suffix_dedup import suffix_dedup
from lucerna.llm.topk import top_k
from lucerna.llm.toxicity import toxicity_scores
from lucerna.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


#: Key of the registered query only; a deployment passes its own.
QUERY_KEY = "registered-query"


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(_table(spark, sf_dir, "documents"), QUERY_KEY)


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations_by_reply(_table(spark, sf_dir, "conversations"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_pii_pseudonyms, op3_quotation_linking, op4_sentencepiece, op5_line_dedup, op6_suffix_dedup,
        op7_toxicity, op8_decontamination, op9_minhash_dedup, op10_quality, op11_exact_topk, op12_prefix_trie, op13_whitening,
    )
}
