r"""Benchmark decontamination by winnowing, in DataFrame functions only.

Each text keeps, with its place, the minimum k-gram hash of every sliding window of `window - k + 1`
k-grams (of equal ones the first), so any shared span of `window` words shares a kept fingerprint at
the same words. Documents' fingerprints meet the benchmark's; each hit is extended to the windows of
whole words that cover its k-gram, and these are compared with the items' windows word for word. What is joined is each distinct
fingerprint and window once, never pairs of documents and items.
The benchmark's and the hits' side is broadcast only if its counted size is small; else Spark shuffles both sides.

Words are maximal runs `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z. An item of fewer than
`window` words, but not none, is one window.

Defined results: null and empty texts have no words and no hits; rows that repeat both id and text come
out once; a null id is an id like others; null item ids are left out; an empty benchmark hits nothing.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import checkpoint

#: Most bytes that are broadcast.
BROADCAST_BYTES = 32 << 20
#: Low bits of a fingerprint that hold its place; the others hold the hash.
_PLACE = 28
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def exact_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), _GAP), "")


def loose_words(text: Column) -> Column:
    """Words under full lower-casing: the same boundaries as exact_words (letters stay letters), and equal
    wherever those are equal, which is all that candidates need; several times as fast."""
    return F.array_remove(F.split(F.replace(F.lower(text), F.lit("ς"), F.lit("σ")), _GAP), "")


def _over(values: str, count: int, both) -> Column:
    """`both` of every `count` neighbours of an array column, for each place at which so many begin. The column
    must be one of the table, not an expression, which would be worked out anew for each element."""
    near = lambda x, i: both(x, *[F.get(F.col(values), i + k) for k in range(1, count)])
    return F.slice(F.transform(F.col(values), near), F.lit(1), F.greatest(F.size(values) - (count - 1), F.lit(0)))


def _placed(grams: Column) -> Column:
    """(hash, place) of each gram as one number: the hash above, the place below."""
    return F.transform(grams, lambda h, i: F.shiftleft(F.shiftright(h, _PLACE), _PLACE).bitwiseOR(i.cast("long")))


def with_prints(df: DataFrame, words: str, window: int, k: int, short: list[int]) -> DataFrame:
    """df with prints, the fingerprints (len, mark, at) of a column of words: winnowed k-grams, and all grams of the short
    items' lengths. Each step is a column that the next one reads."""
    wide, own = window - k + 1, df.columns
    out = df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
    out = out.select(*own, _placed(_over("_words", k, F.xxhash64)).alias("_grams"), *[_placed(_over("_words", n, F.xxhash64)).alias(f"_short{n}") for n in short])
    least = F.when(F.size("_grams") >= wide, _over("_grams", wide, F.least)).when(F.size("_grams") > 0, F.array(F.array_min("_grams"))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_kept", F.array_distinct(least))
    one = lambda n: lambda v: F.struct(F.lit(n).alias("len"), F.shiftrightunsigned(v, _PLACE).alias("mark"), v.bitwiseAND(F.lit(2**_PLACE - 1)).cast("int").alias("at"))
    return out.select(*own, F.concat(F.transform("_kept", one(window)), *[F.transform(f"_short{n}", one(n)) for n in short]).alias("prints"))


def _bounded(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """doc_id, text_hash, n_words, hit_words (sorted word positions from 0), item_ids (sorted)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), exact_words(F.col("text")).alias("words"), loose_words(F.col("text")).alias("loose")).where(F.size("words") > 0)
    lengths = sorted(r[0] for r in items.where(F.size("words") < window).select(F.size("words")).distinct().collect())  # under `window` numbers
    size = F.least(F.size("words"), F.lit(window))
    windows = checkpoint(
        items.select("item_id", size.alias("w_len"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("i"))
        .select("item_id", "w_len", F.array_join(F.slice("words", F.col("i"), F.col("w_len")), " ").alias("w_gram"))
        .groupBy("w_len", "w_gram").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    prints = with_prints(items.select(size.alias("n"), "loose"), "loose", window, k, lengths).select("n", F.explode_outer("prints").alias("p"))  # a plain explode would have its filters pushed down into each step
    marks = checkpoint(prints.where("p.len = n").select(F.col("p.len").alias("m_len"), F.col("p.mark").alias("m_mark")).distinct())
    of_windows = windows.agg(F.sum(F.length("w_gram") + 40 + F.expr("aggregate(items, 0L, (n, x) -> n + length(x) + 24)"))).first()[0] or 0

    read = with_prints(rows.select("doc_id", "text_hash", loose_words(F.col("text")).alias("loose")), "loose", window, k, lengths)
    counted = checkpoint(read.select("doc_id", "text_hash", F.size("loose").cast("long").alias("n_words"), "prints"))
    met = (
        counted.where(F.size("prints") > 0).select("doc_id", "text_hash", F.explode("prints").alias("p"))
        .join(_bounded(marks, 40 * marks.count()), (F.col("p.len") == F.col("m_len")) & (F.col("p.mark") == F.col("m_mark")), "left_semi")
        .groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("p.len", "p.at")).alias("places"))
        .select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "places")
    )
    met = checkpoint(met)
    of_met = met.agg(F.sum(8 * F.size("places") + 60)).first()[0] or 0
    same = lambda a, h: F.col("doc_id").eqNullSafe(F.col(a)) & (F.col("text_hash") == F.col(h))
    words = rows.join(_bounded(met, of_met), same("id", "hash")).select("doc_id", "text_hash", "places", exact_words(F.col("text")).alias("words"))
    # a k-gram at `at` lies in the windows from at - (window - k) to at; a short item's gram is its window
    around = F.array_distinct(F.flatten(F.transform("places", lambda p: F.transform(F.sequence(F.when(p["len"] == window, F.greatest(p["at"] - (window - k), F.lit(0))).otherwise(p["at"]), p["at"]), lambda i: F.struct(p["len"].alias("len"), i.alias("at"))))))
    spots = words.select("doc_id", "text_hash", "words", F.explode(F.filter(around, lambda s: s["at"] + s["len"] <= F.size("words"))).alias("s"))
    spots = spots.select("doc_id", "text_hash", "s.at", "s.len", F.array_join(F.slice("words", F.col("s.at") + 1, F.col("s.len")), " ").alias("gram"))
    hits = spots.join(_bounded(windows, of_windows), (F.col("len") == F.col("w_len")) & (F.col("gram") == F.col("w_gram")))
    per_doc = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "len")).alias("at"), F.collect_set("items").alias("items"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))))
    found = checkpoint(per_doc.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), covered.alias("hits"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("ids")))
    of_found = found.agg(F.sum(4 * F.size("hits") + 60 + F.expr("aggregate(ids, 0L, (n, x) -> n + length(x) + 24)"))).first()[0] or 0
    every = counted.select("doc_id", "text_hash", "n_words").distinct()
    return every.join(_bounded(found, of_found), same("id", "hash"), "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hit_words"), F.coalesce("ids", F.array().cast("array<string>")).alias("item_ids")
    )


def decontamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = contamination(docs, benchmark, window, k)
    return out.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )
