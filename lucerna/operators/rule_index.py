"""Labelling by very many rules: an inverted index from atoms to rules, joined with the rows' atoms.

Rules become alternatives of sets of atoms (field=value); each alternative is filed under the atoms of its set that
fewest rows have, so a row meets only alternatives it has a rare atom of, and the other sets are then looked up
among its atoms. The plan is the same for ten rules and for ten thousand: they are rows of a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.functions.rules import Compiler, Rule, conjuncts
from lucerna.sources.cuts import cut, dealt

#: Filed atoms that are broadcast at most; more of them are dealt by atom.
_FILED = 100_000


def rule_table(spark: SparkSession, rules: list[Rule], compiler: Compiler) -> DataFrame:
    """kc, conjunct and its sets of atoms; an alternative that asks for nothing has no sets."""
    rows = [(r["kc_id"], i, [sorted(s) for s in sets]) for r in rules for i, sets in enumerate(conjuncts(r["rule"], compiler.fields))]
    return spark.createDataFrame(rows, "kc string, conjunct long, sets array<array<string>>")


def with_atoms(rows: DataFrame, compiler: Compiler) -> DataFrame:
    """rows with _atoms; null fields and null operations have none."""
    none = F.array().cast("array<string>")
    one = lambda field, column: F.when(F.col(column).isNotNull(), F.array(F.concat(F.lit(f"{field}="), F.col(column).cast("string"))))
    parts = [one(f"cell.{d}", c) for d, c in compiler.dimensions.items()] + [one(f, f) for f in compiler.fields if f in rows.columns]
    if compiler.operations in rows.columns:
        parts.append(F.transform(F.array_compact(compiler.operations), lambda o: F.concat(F.lit("operation="), o)))
    return rows.withColumn("_atoms", F.array_distinct(F.concat(none, *[F.coalesce(p, none) for p in parts])))


def label_by_index(rows: DataFrame, key: str, rules: DataFrame, compiler: Compiler) -> DataFrame:
    """rows with kc_ids, the sorted ids of the rules that hold. key: unique; rules: see rule_table. Rows are dealt by key
    once and never broadcast: a file of some MB may hold rows of some GB."""
    none = F.array().cast("array<string>")
    atoms = with_atoms(dealt(rows, key), compiler)
    found = atoms.select(key, "_atoms")
    use = found.select(F.explode("_atoms").alias("atom")).groupBy("atom").agg(F.count("*").alias("rows"))
    # the set of an alternative whose atoms the fewest rows have; an atom that no row has counts 0
    each = rules.select("kc", "conjunct", "sets", F.posexplode("sets").alias("place", "set")).select("kc", "conjunct", "sets", "place", F.explode("set").alias("atom"))
    weighed = each.join(use, "atom", "left").groupBy("kc", "conjunct", "place").agg(F.sum(F.coalesce("rows", F.lit(0))).alias("rows"), F.collect_set("atom").alias("atoms"), F.first("sets").alias("sets"))
    filed = weighed.groupBy("kc", "conjunct").agg(F.min_by(F.struct("atoms", "sets"), F.struct("rows", "place")).alias("x")).select("kc", F.col("x.sets").alias("sets"), F.explode("x.atoms").alias("atom"))
    filed = cut(filed)
    filed = F.broadcast(filed) if filed.count() <= _FILED else filed.hint("merge")
    met = found.select(key, "_atoms", F.explode("_atoms").alias("atom")).join(filed, "atom")
    held = met.where(F.forall("sets", lambda s: F.arrays_overlap(s, "_atoms"))).groupBy(key).agg(F.collect_set("kc").alias("_held"))
    # rules with an alternative that asks for nothing hold everywhere: one row with all of them
    always = rules.where("size(sets) = 0").agg(F.collect_set("kc").alias("_always"))
    out = atoms.join(held.hint("merge"), key, "left").crossJoin(F.broadcast(always))
    return out.withColumn("kc_ids", F.array_sort(F.array_union(F.coalesce("_held", none), "_always"))).drop("_atoms", "_held", "_always")
