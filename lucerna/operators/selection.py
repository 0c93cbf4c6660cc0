"""Choosing a small label set on development data: activations, diagnostics, classes, obligations, greedy cover.

Candidates are a declared, short list; cells and obligations are distributed. A candidate is
(id, origin rank, granularity, complexity, parents, represents, rule), and may end with a group of alternatives that
differ in granularity only.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions.rules import Compiler, operation_scope
from lucerna.sources.cuts import cut

Candidate = tuple


def candidate_table(spark, candidates: list[Candidate]) -> DataFrame:
    rows = [(c[0], c[1], c[2], c[3], c[4], c[5], len(c[4]) > 0, operation_scope(c[6]), c[7] if len(c) > 7 else None) for c in candidates]
    return spark.createDataFrame(rows, "candidate string, origin long, granularity long, complexity long, parents array<string>, represents string, interaction boolean, operation boolean, alternatives string")


def activations(grid: DataFrame, compiler: Compiler, candidates: list[Candidate], cell: str = "cell_id") -> DataFrame:
    """candidate, cell, active and all realisations, and the state always, never or mixed: one count by cell
    of a boolean column a rule, then the long form, so grid rows aren't multiplied by candidates."""
    sums = grid.groupBy(cell).agg(F.count("*").alias("n"), *[F.sum(compiler.column(c[6]).cast("long")).alias(f"_{i}") for i, c in enumerate(candidates)])
    each = F.explode(F.array(*[F.struct(F.lit(c[0]).alias("candidate"), F.col(f"_{i}").alias("active")) for i, c in enumerate(candidates)])).alias("x")
    rows = sums.select(cell, "n", each).select(F.col("x.candidate").alias("candidate"), cell, F.col("x.active").alias("active"), F.col("n").alias("realisations"))
    return rows.withColumn("state", F.when(F.col("active") == F.col("realisations"), "always").when(F.col("active") == 0, "never").otherwise("mixed"))


def stable_facts(grid: DataFrame, facts: str = "operations", cell: str = "cell_id") -> DataFrame:
    """Facts that every realisation of a cell has."""
    size = grid.groupBy(cell).agg(F.count("*").alias("n"))
    held = grid.select(cell, F.explode(F.array_distinct(facts)).alias("fact")).groupBy(cell, "fact").agg(F.count("*").alias("k"))
    return held.join(size, cell).where("k = n").select(cell, "fact")


def diagnostics(
    active: DataFrame, sources: DataFrame, table: DataFrame, least_cells: int = 1, least_interaction: int = 2, least_descriptors: int = 1, descriptors: DataFrame | None = None, residual: DataFrame | None = None
) -> DataFrame:
    """Support, scope and reasons against each candidate by itself (collapsed adds what its class says).

    sources: (cell_id, n_items). descriptors: (cell_id, source_id), the source descriptors of the cells; without them
    their number is null and no reason. residual: policies.residual_evidence; an interaction needs a fact beyond its parents.
    """
    spark = table.sparkSession
    rows = active.join(sources, "cell_id")
    always, mixed = F.col("state") == "always", F.col("state") == "mixed"
    per = rows.groupBy("candidate").agg(
        F.sum(always.cast("long")).alias("cells"), F.sum((always | mixed).cast("long")).alias("any_cells"), F.sum(mixed.cast("long")).alias("mixed_cells"),
        F.sum(F.when(always, F.col("n_items")).otherwise(0)).alias("items"), F.sum(F.when(always, F.col("realisations")).otherwise(0)).alias("realisations"),
    )
    parents = table.select("candidate", F.explode("parents").alias("parent")).join(per.select(F.col("candidate").alias("parent"), F.col("cells").alias("parent_cells")), "parent")
    narrow = parents.groupBy("candidate").agg(F.min("parent_cells").alias("least_parent"))
    none = spark.createDataFrame([], "candidate string, n long")
    shown = none if descriptors is None else active.where("state = 'always'").join(descriptors.select("cell_id", "source_id").distinct(), "cell_id").groupBy("candidate").agg(F.countDistinct("source_id").alias("n"))
    beyond = none if residual is None else residual.where("beyond_parents").groupBy("candidate").agg(F.countDistinct("fact").alias("n"))
    joined = table.join(per, "candidate").join(narrow, "candidate", "left").join(shown.withColumnRenamed("n", "_sources"), "candidate", "left").join(beyond.withColumnRenamed("n", "_facts"), "candidate", "left")
    n_sources = F.lit(None).cast("long") if descriptors is None else F.coalesce("_sources", F.lit(0))
    facts = F.coalesce("_facts", F.lit(0))
    scope = F.when(F.col("mixed_cells") > 0, "realisation").when(F.col("operation") & (F.col("any_cells") == 0), "unverified").otherwise("cell")
    reasons = F.array_compact(F.array(
        F.when(F.col("cells") < least_cells, F.lit("too few cells")),
        F.when(n_sources < least_descriptors, F.lit("too few source descriptors")),
        F.when(scope != "cell", F.concat(F.lit("scope is "), scope)),
        F.when(F.col("interaction") & (F.col("cells") < least_interaction), F.lit("too few interaction cells")),
        F.when(F.col("interaction") & ~F.coalesce((F.col("cells") > 0) & (F.col("cells") < F.col("least_parent")), F.lit(False)), F.lit("not a strict part of its parents")),
        F.when(F.col("interaction") & (facts == 0), F.lit("no fact beyond its parents")),
        F.when(~F.col("interaction") & (F.col("represents") == ""), F.lit("stands for nothing")),
    ))
    out = joined.select("candidate", "cells", "any_cells", "mixed_cells", "items", "realisations", n_sources.alias("descriptors"), facts.alias("residual_facts"), (F.col("cells") < 2).alias("fragile"), scope.alias("scope"), reasons.alias("reasons"))
    return out.withColumn("eligible", F.size("reasons") == 0)


def class_members(active: DataFrame, found: DataFrame, table: DataFrame) -> DataFrame:
    """candidate, its class of candidates with the same state in every cell, and the class's representative. The vector is
    summed up by hashes of (cell, state), so it isn't gathered; never is the background."""
    marks = active.withColumn("h", F.xxhash64("cell_id", "state").cast("decimal(38,0)")).groupBy("candidate").agg(F.sum(F.when(F.col("state") != "never", F.col("h")).otherwise(0)).alias("a"), F.sum((F.col("state") != "never").cast("long")).alias("b"))
    rank = F.struct(~F.col("eligible"), "origin", "granularity", -F.length("represents"), "complexity", "candidate")
    rows = marks.join(found.select("candidate", "eligible"), "candidate").join(table.select("candidate", "origin", "granularity", "represents", "complexity", "alternatives"), "candidate")
    first = rows.groupBy("a", "b").agg(F.min_by("candidate", rank).alias("representative"))
    return rows.join(first, ["a", "b"]).select("candidate", "a", "b", "alternatives", "representative")


def equivalence_classes(members: DataFrame) -> DataFrame:
    """One row a class: members, representative, whether development rows can't tell its members apart, and the groups of
    alternatives (group=members, joined by ;) of which it holds several."""
    text = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    whole = members.groupBy("a", "b").agg(text("candidate").alias("members"), F.count("*").alias("n_members"), F.max("representative").alias("representative"), F.max("b").alias("active_cells"))
    groups = members.where("alternatives is not null").groupBy("a", "b", "alternatives").agg(text("candidate").alias("of"), F.count("*").alias("n")).where("n > 1")
    groups = groups.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list(F.concat("alternatives", F.lit("="), "of"))), ";").alias("granularity_groups"))
    out = whole.join(groups, ["a", "b"], "left").withColumn("unidentifiable", F.col("n_members") > 1)
    return out.select("members", "n_members", "representative", "active_cells", "unidentifiable", F.coalesce("granularity_groups", F.lit("")).alias("granularity_groups"))


def collapsed(found: DataFrame, members: DataFrame) -> DataFrame:
    """found, where an eligible candidate that another one stands for is no longer eligible, and says so."""
    rows = found.join(members.select("candidate", "representative"), "candidate")
    other = F.col("eligible") & (F.col("representative") != F.col("candidate"))
    reasons = F.when(other, F.concat("reasons", F.array(F.lit("collapsed into an identical activation class")))).otherwise(F.col("reasons"))
    return rows.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)


def obligations(cells: DataFrame, facts: DataFrame, contrasts: DataFrame) -> DataFrame:
    """Cells, facts and contrasts of the development cells as one table of obligations."""
    dev = cells.where("canonical_split = 'development'")
    c = dev.select(F.lit("cell").alias("kind"), F.concat(F.lit("cell:"), "cell_id").alias("obligation"))
    f = facts.join(dev.select("cell_id"), "cell_id", "left_semi").select(F.lit("fact").alias("kind"), F.concat(F.lit("fact:"), "fact").alias("obligation")).distinct()
    ids = dev.select("cell_id")
    k = contrasts.join(ids, F.col("left_id") == F.col("cell_id"), "left_semi").join(ids, F.col("right_id") == F.col("cell_id"), "left_semi")
    return c.unionByName(f).unionByName(k.select(F.lit("contrast").alias("kind"), F.concat_ws(":", F.lit("contrast"), "left_id", "right_id").alias("obligation")))


def obligation_coverage(active: DataFrame, table: DataFrame, cells: DataFrame, facts: DataFrame, contrasts: DataFrame) -> DataFrame:
    """(candidate, obligation): a cell by an always active candidate, a fact by the candidate that stands for
    it, a contrast by a candidate always active on one side only."""
    dev = cells.where("canonical_split = 'development'").select("cell_id")
    on = active.where("state = 'always'").select("candidate", "cell_id").join(dev, "cell_id", "left_semi")
    by_cell = on.select("candidate", F.concat(F.lit("cell:"), "cell_id").alias("obligation"))
    present = facts.join(dev, "cell_id", "left_semi").select("fact").distinct()
    by_fact = table.join(present, F.col("represents") == F.col("fact")).select("candidate", F.concat(F.lit("fact:"), "fact").alias("obligation"))
    inside = contrasts.join(dev, F.col("left_id") == F.col("cell_id"), "left_semi").join(dev, F.col("right_id") == F.col("cell_id"), "left_semi").select("left_id", "right_id")
    sides = inside.select("left_id", "right_id", F.explode(F.array("left_id", "right_id")).alias("cell_id")).join(on, "cell_id")
    one = sides.groupBy("candidate", "left_id", "right_id").agg(F.count("*").alias("n")).where("n = 1")
    return by_cell.unionByName(by_fact).unionByName(one.select("candidate", F.concat_ws(":", F.lit("contrast"), "left_id", "right_id").alias("obligation")))


#: Candidates whose old gains are brought up to date together.
REFRESH = 8


def greedy_cover(covered_by: DataFrame, table: DataFrame, found: DataFrame) -> DataFrame:
    """Greedy cover with backward pruning.

    Each round takes the eligible candidate, with the parents it still lacks, that covers most open
    obligations; ties go to the smaller bundle, then less complexity, fewer cells, more support, and id.
    Then, newest first, a candidate goes if no kept one needs it and all stays covered.
    Returns candidate, step, new_obligations and status selected or pruned.

    Obligations are summed up once by the set of candidates that cover them; all later jobs read that table alone. A
    gain never rises as more is covered, so old gains are upper bounds: they wait in a heap, and only those that may
    still win are counted again. Pruning asks which kept ones cover an obligation alone, and asks again after a
    removal only: whoever covers one alone does so after further removals too.
    """
    spark = covered_by.sparkSession
    facts = {r["candidate"]: r for r in table.join(found.select("candidate", "cells", "items", "eligible"), "candidate").collect()}  # the declared candidates
    eligible = sorted(c for c, r in facts.items() if r["eligible"] and all(facts[p]["eligible"] for p in r["parents"]))
    names = lambda members: F.array(*[F.lit(m) for m in members]).cast("array<string>")

    def bundle(c: str, have: list[str]) -> list[str]:
        out, todo = [], [c]
        while todo:
            x = todo.pop()
            if x not in out and x not in have:
                out.append(x)
                todo.extend(facts[x]["parents"])
        return out

    def rank(c: str, gain: int, have: list[str]) -> tuple:
        b = bundle(c, have)
        return (-gain, len(b), sum(facts[m]["complexity"] for m in b), sum(facts[m]["cells"] for m in b), sum(facts[m]["interaction"] for m in b), -min(min(facts[m]["cells"], facts[m]["items"]) for m in b), c)

    by = covered_by.where(F.col("candidate").isin(eligible)).groupBy("obligation").agg(F.array_sort(F.collect_set("candidate")).alias("by"))
    sets = cut(by.groupBy("by").agg(F.count("*").alias("n")))

    def gains(asked: list[str], have: list[str]) -> dict[str, int]:
        """How many open obligations each one's bundle covers: one pass over the sets."""
        left = sets.where(~F.arrays_overlap("by", names(have))) if have else sets
        row = left.agg(*[F.coalesce(F.sum(F.when(F.arrays_overlap("by", names(bundle(c, have))), F.col("n"))), F.lit(0)).alias(f"_{i}") for i, c in enumerate(asked)]).first()
        return dict(zip(asked, row, strict=True))

    chosen, trace, step = [], [], 0
    known = gains(eligible, chosen) if eligible else {}
    counted_at = dict.fromkeys(eligible, 0)
    while True:
        heap = [(-g, c) for c, g in known.items() if g > 0 and c not in chosen]
        heapq.heapify(heap)
        best, old = None, []
        # all that may still have the most: the best gain so far, or more by their old count
        while heap and (best is None or heap[0][0] <= best[0]):
            g, c = heapq.heappop(heap)
            if counted_at[c] == step:
                best = min(x for x in (best, rank(c, -g, chosen)) if x)
            else:
                old.append(c)
            if old and (len(old) == REFRESH or not heap or (best is not None and heap[0][0] > best[0])):
                for c, g in gains(old, chosen).items():
                    known[c], counted_at[c] = g, step
                    if g > 0:
                        heapq.heappush(heap, (-g, c))
                old = []
        if best is None:
            break
        added = sorted(bundle(best[-1], chosen), key=lambda m: (facts[m]["interaction"], m))
        step += 1
        chosen += added
        trace += [(m, step, -best[0] if m == best[-1] else 0) for m in added]
    kept, alone = list(chosen), None
    for c in reversed(chosen):
        if any(c in facts[k]["parents"] for k in kept if k != c):
            continue
        if alone is None:
            left = sets.select(F.array_intersect("by", names(kept)).alias("by")).where("size(by) = 1")
            alone = {r["c"] for r in left.select(F.col("by")[0].alias("c")).distinct().collect()}  # declared candidates
        if c not in alone:
            kept.remove(c)
            alone = None
    rows = [(c, s, g, "selected" if c in kept else "pruned") for c, s, g in trace]
    return spark.createDataFrame(rows, "candidate string, step long, new_obligations long, status string")


def policy_evaluation(labelled_cells: DataFrame, facts: DataFrame, support: DataFrame) -> DataFrame:
    """By split: cells, share with a label, share with a label signature of their own, share of label uses
    that development supports."""
    rows = labelled_cells.withColumn("signature", F.array_join("kc_ids", ","))
    own = rows.groupBy("canonical_split", "signature").agg(F.count("*").alias("same"))
    uses = rows.select("canonical_split", "cell_id", F.explode("kc_ids").alias("kc")).join(support.select("kc", F.lit(1).alias("ok")), "kc", "left")
    reuse = uses.groupBy("canonical_split").agg(F.bround(F.count("ok") / F.count("*"), 6).alias("component_reuse"))
    base = rows.join(own, ["canonical_split", "signature"]).groupBy("canonical_split").agg(
        F.count("*").alias("n_cells"), F.bround(F.avg((F.size("kc_ids") > 0).cast("double")), 6).alias("coverage"), F.bround(F.avg((F.col("same") == 1).cast("double")), 6).alias("unique_rate"))
    n_facts = facts.groupBy("canonical_split").agg(F.countDistinct("fact").alias("n_facts"))
    return base.join(reuse, "canonical_split", "left").join(n_facts, "canonical_split", "left")


def split_audit(cells: DataFrame, values: list[str]) -> DataFrame:
    """By holdout cell: values that no development cell has; a compositional cell must have none, a novel
    one at least one."""
    each = F.explode(F.array(*[F.concat(F.lit(f"{d}="), F.col(d)) for d in values])).alias("value")
    long = cells.select("cell_id", "canonical_split", each)
    known = long.where("canonical_split = 'development'").select("value").distinct().withColumn("known", F.lit(1))
    per = long.where("canonical_split <> 'development'").join(known, "value", "left").groupBy("cell_id", "canonical_split").agg(F.sum(F.col("known").isNull().cast("long")).alias("unseen"))
    good = F.when(F.col("canonical_split") == "compositional_holdout", F.col("unseen") == 0).otherwise(F.col("unseen") > 0)
    return per.withColumn("status", F.when(good, "PASS").otherwise("FAIL"))
