"""Audits over several tables: item checks, tags, policy variants, run comparison and the suite report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions.ids import content_id


def coverage_tags(dimensions: list[str], operations: str = "operations") -> Column:
    """Sorted distinct tags of a row: its dimensions, its operations and how many there are."""
    own = [F.concat(F.lit(f"{d}:"), F.col(d)) for d in dimensions]
    per = F.transform(operations, lambda o: F.concat(F.lit("operation:"), o))
    return F.array_sort(F.array_distinct(F.concat(F.array(*own), per, F.array(F.concat(F.lit("operation_count:"), F.size(operations).cast("string"))))))


def tag_value(tags: str, prefix: str) -> Column:
    """What follows the prefix in the only tag that has it; an error if there is none or several."""
    found = F.filter(tags, lambda t: t.startswith(prefix))
    return F.when(F.size(found) == 1, F.substr(found[0], F.lit(len(prefix) + 1))).otherwise(F.raise_error(F.lit(f"not one tag {prefix}")))


def adjacent_pairs(operations: str = "operations") -> Column:
    """chain_edge facts of neighbouring operations."""
    left, right = F.slice(operations, F.lit(1), F.greatest(F.size(operations) - 1, F.lit(0))), F.slice(operations, F.lit(2), F.greatest(F.size(operations) - 1, F.lit(0)))
    return F.zip_with(left, right, lambda a, b: F.concat(F.lit("chain_edge:"), a, F.lit(">"), b))


def item_errors(items: DataFrame, cells: DataFrame, id_parts: list[str], stated: str, prompt: list[str], most_same: int) -> DataFrame:
    """item_id and errors: an id that its parts don't give, an unknown cell, a prompt used too often. The
    prompt is counted by a combining aggregate and joined back, so a common prompt can be split."""
    same = items.groupBy(*prompt).agg(F.count("*").alias("_same")).select(*[F.col(p).alias(f"_{p}") for p in prompt], "_same")
    on = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in prompt])
    rows = items.join(same, on, "left").join(cells.select("cell_id", F.lit(True).alias("_known")), "cell_id", "left")
    tests = {
        "id differs from its parts": F.col(stated) != content_id("ITEM", *[F.col(p) for p in id_parts]),
        "unknown cell": F.col("_known").isNull(),
        "prompt is repeated": F.col("_same") > most_same,
    }
    return rows.select("item_id", F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for n, t in tests.items()])).alias("errors"))


def sampling_audit(df: DataFrame, sample: DataFrame, key: str, by: str) -> DataFrame:
    """Eligible and selected rows of each group."""
    taken = sample.groupBy(by).agg(F.count("*").alias("selected"))
    return df.groupBy(by).agg(F.countDistinct(key).alias("eligible")).join(taken, by, "left").select(by, "eligible", F.coalesce("selected", F.lit(0)).alias("selected"))


def template_candidates(values: DataFrame, template: str) -> DataFrame:
    """One candidate id for each value, from a template with a {value} place."""
    return values.select(F.replace(F.lit(template), F.lit("{value}"), F.col("value")).alias("candidate"), "value")


def frozen_full_cell(items: DataFrame, cells: DataFrame) -> DataFrame:
    """items with the label of their cell if it is a development cell; an equi join, not a rule a cell."""
    known = cells.where("canonical_split = 'development'").select("cell_id", F.concat(F.lit("K_FULL_"), F.substr("cell_id", F.lit(6))).alias("kc"))
    return items.join(known, "cell_id", "left")


def frozen_rules(labelled: DataFrame, rules: list[dict]) -> list[dict]:
    """The rules that some development item supports; holdout rows are refused."""
    if not labelled.where("canonical_split <> 'development'").isEmpty():
        raise ValueError("rules are frozen on development rows only")
    fired = {r[0] for r in labelled.select(F.explode("kc_ids")).distinct().collect()}  # at most the declared rules
    return [r for r in rules if r["kc_id"] in fired]


def label_changes(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows whose label sets differ between two runs, with what each side has alone."""
    both = left.select(key, F.col("kc_ids").alias("l")).join(right.select(key, F.col("kc_ids").alias("r")), key, "full")
    none = F.array().cast("array<string>")
    lost, new = F.array_except(F.coalesce("l", none), F.coalesce("r", none)), F.array_except(F.coalesce("r", none), F.coalesce("l", none))
    return both.select(key, F.array_sort(lost).alias("lost"), F.array_sort(new).alias("new")).where("size(lost) + size(new) > 0")


def count_histograms(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows by number of labels in two runs."""
    one = lambda df, name: df.groupBy(F.size("kc_ids").cast("long").alias("n_labels")).agg(F.count("*").alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return one(left, "rows_left").join(one(right, "rows_right"), "n_labels", "full").select("n_labels", zero("rows_left"), zero("rows_right"))


def separated_classes(active: DataFrame, members: DataFrame) -> DataFrame:
    """Cells in which candidates that development couldn't tell apart differ. members: (class, candidate)."""
    rows = active.join(members, "candidate")
    return rows.groupBy("class", "cell_id").agg(F.countDistinct("state").alias("states"), F.count("*").alias("n")).where("states > 1")


def suite_report(results: dict[str, DataFrame]) -> DataFrame:
    """One row a check: rows that fail it, and PASS or FAIL."""
    parts = [df.agg(F.count("*").alias("n_errors")).select(F.lit(name).alias("check_name"), "n_errors") for name, df in results.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("status", F.when(F.col("n_errors") == 0, "PASS").otherwise("FAIL"))


def contrast_set_errors(items: DataFrame, dimensions: list[str], nuisance: str, key: str = "contrast_id") -> DataFrame:
    """contrast_id and errors of the contrast sets: two items each, alike but for one dimension of their cells.
    Sets are summed up by counts of distinct values, so one with very many items is no list."""
    differing = sum((F.col(f"_n_{d}") > 1).cast("int") for d in dimensions)
    sums = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.countDistinct(nuisance).alias("_nuisances"), *[F.countDistinct(d).alias(f"_n_{d}") for d in dimensions])
    tests = {"contrast set isn't of two": F.col("_n") != 2, "contrast differs in more than its cell": (F.col("_n") == 2) & (F.col("_nuisances") > 1), "contrast isn't of one dimension": (F.col("_n") == 2) & (F.col("_nuisances") == 1) & (differing != 1)}
    return sums.select(key, F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])).alias("errors")).where(F.size("errors") > 0)


def hard_item_errors(items: DataFrame, edges: DataFrame, contrasts: DataFrame, id_parts: list[str]) -> DataFrame:
    """item_id and errors of finished items (columns stated_id, cell_id, source_id, clause, voice, object, subject, prompt,
    answer, operations, derived, tags, reasons, contrast_id). edges: (cell_id, source_id); contrasts: contrast_id, errors."""
    related = edges.select("cell_id", "source_id").distinct().withColumn("_related", F.lit(True))
    same = items.groupBy(F.col("prompt").alias("_prompt")).agg(F.count("*").alias("_same"))
    rows = items.join(related, ["cell_id", "source_id"], "left").join(same, F.col("prompt") == F.col("_prompt"), "left")
    rows = rows.join(contrasts.select("contrast_id", F.col("errors").alias("_contrast")), "contrast_id", "left")
    question = F.col("clause").endswith("question")
    tests = {
        "id has another form": ~F.col("stated_id").rlike("^ITEM_[A-F0-9]{16}$"), "id differs from its parts": F.col("stated_id") != content_id("ITEM", *[F.col(p) for p in id_parts]),
        "source isn't of the cell": F.col("_related").isNull(), "evidence differs from its derivation": F.col("operations") != F.col("derived"),
        "answer ends with another sign": F.substring("answer", -1, 1) != F.when(question, "?").otherwise("."),
        "passive subject isn't the patient": (F.col("voice") == "passive") & ~F.col("subject").eqNullSafe(F.col("object")),
        "tags aren't sorted and distinct": F.col("tags") != F.array_sort(F.array_distinct("tags")), "no reasons": F.size("reasons") == 0, "prompt is repeated": F.col("_same") > 1,
    }
    own = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for n, t in tests.items()]))
    return rows.select("item_id", F.concat(own, F.coalesce("_contrast", F.array().cast("array<string>"))).alias("errors"))
