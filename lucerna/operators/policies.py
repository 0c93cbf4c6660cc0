"""Candidates from templates and parents, evidence beyond parents, the selected policy and its evaluation.

Candidates, rules and policies are declared lists; cells, activations, obligations and events are tables.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions.rules import Compiler
from lucerna.operators import audits, canonical, labels, selection
from lucerna.operators.guards import require_none
from lucerna.sources.cuts import cut

Candidate = tuple


def from_template(template: tuple, dimension: str, values: list[str]) -> list[Candidate]:
    """A candidate for each value: {value} and {VALUE} in id and meaning stand for it; the rule asks for it."""
    name, origin, granularity, complexity, represents = template
    fill = lambda text, v: text.replace("{value}", v).replace("{VALUE}", v.upper())
    return [(fill(name, v), origin, granularity, complexity, [], fill(represents, v), {"cell": {dimension: v}}) for v in sorted(values)]


def generic(name: str, origin: int, granularity: int, complexity: int, dimension: str, values: list[str]) -> Candidate:
    """One candidate for any of the values."""
    return (name, origin, granularity, complexity, [], f"{dimension}:any", {"cell": {dimension: sorted(values)}})


def interactions(candidates: list[Candidate], pairs: list[tuple[str, str, str]], origin: int = 2, granularity: int = 3) -> list[Candidate]:
    """candidates and a conjunction for each (id, parent, parent): both rules, and one more than both complexities."""
    known = {c[0]: c for c in candidates}
    out = list(candidates)
    for name, *parents in pairs:
        if len(set(parents)) != 2 or any(p not in known for p in parents):
            raise ValueError(f"{name}: not two known parents: {parents}")
        out.append((name, origin, granularity, 1 + sum(known[p][3] for p in parents), parents, "", {"all": [known[p][6] for p in parents]}))
    if len({c[0] for c in out}) < len(out):
        raise ValueError("a candidate id occurs twice")
    return out


def candidate_dimensions(spark, candidates: list[Candidate]) -> DataFrame:
    """candidate, its sorted dimensions and its rule as text."""

    def used(rule: dict) -> set[str]:
        parts = [p for k in ("all", "any") for p in rule.get(k, [])]
        return set(rule.get("cell", {})).union(*map(used, parts))

    return spark.createDataFrame([(c[0], sorted(used(c[6])), json.dumps(c[6], sort_keys=True)) for c in candidates], "candidate string, dimensions array<string>, rule string")


def parent_only_cells(active: DataFrame, table: DataFrame) -> DataFrame:
    """candidate, cell_id: cells in which a parent always holds and the interaction never does."""
    parents = table.select(F.col("candidate").alias("child"), F.explode("parents").alias("candidate"))
    on = parents.join(active.where("state = 'always'").select("candidate", "cell_id"), "candidate").select(F.col("child").alias("candidate"), "cell_id").distinct()
    return on.join(active.where("state = 'never'").select("candidate", "cell_id"), ["candidate", "cell_id"])


def residual_evidence(active: DataFrame, table: DataFrame, facts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Whether a fact (candidate, fact) goes beyond the parents: stable in every cell of the interaction, absent
    from every parent-only cell; neither set may be empty."""

    def held(cells: DataFrame, name: str) -> DataFrame:
        rows = patterns.join(cells, "candidate").join(facts.withColumn("_has", F.lit(1)), ["cell_id", "fact"], "left")
        return rows.groupBy("candidate", "fact").agg(F.count("*").alias(f"{name}_cells"), F.count("_has").alias(f"{name}_with"))

    inside = held(active.where("state = 'always'").select("candidate", "cell_id"), "inside")
    outside = held(parent_only_cells(active, table), "parent")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = patterns.join(inside, ["candidate", "fact"], "left").join(outside, ["candidate", "fact"], "left").select("candidate", "fact", zero("inside_cells"), zero("inside_with"), zero("parent_cells"), zero("parent_with"))
    stable = (F.col("inside_cells") > 0) & (F.col("inside_cells") == F.col("inside_with"))
    absent = (F.col("parent_cells") > 0) & (F.col("parent_with") == 0)
    return rows.select("candidate", "fact", "inside_cells", "parent_cells", stable.alias("stable"), absent.alias("absent"), (stable & absent).alias("beyond_parents"))


def development_only(df: DataFrame, what: str) -> DataFrame:
    """df itself, if all its rows are development rows."""
    require_none(df.where(~F.coalesce(F.col("canonical_split") == "development", F.lit(False))), f"{what} hold rows of other splits")
    return df


class Parts(dict):
    """Tables by name; one given as a function is made when it is first asked for."""

    def __getitem__(self, name: str) -> DataFrame:
        value = super().__getitem__(name)
        if callable(value):
            value = self[name] = value()
        return value


def discover(
    cells: DataFrame, grid: DataFrame, compiler: Compiler, candidates: list[Candidate], dimensions: list[str], patterns: dict[str, list[str]] | None = None, stable: DataFrame | None = None, descriptors: DataFrame | None = None, least_descriptors: int = 1
) -> Parts:
    """Everything that selection reads, from development rows alone; others are refused.

    patterns: the facts of each interaction that may go beyond its parents. stable: (cell_id, fact), the facts that every
    realisation of a cell has, by default its stable operations. descriptors: (cell_id, source_id).
    """
    cells, grid = development_only(cells, "cells"), development_only(grid, "realisations")
    spark = cells.sparkSession
    table = selection.candidate_table(spark, candidates)
    active = cut(selection.activations(grid, compiler, candidates))  # cells x candidates: what all that follows reads
    asked = spark.createDataFrame([(c, f) for c, facts in sorted((patterns or {}).items()) for f in facts], "candidate string, fact string")
    held = stable if stable is not None else selection.stable_facts(grid, compiler.operations)
    evidence = residual_evidence(active, table, held, asked)
    facts = cells.select("cell_id", "canonical_split", F.explode(F.array(*[F.concat(F.lit(f"{d}:"), F.col(d)) for d in dimensions])).alias("fact"))
    contrasts = canonical.hamming_one(cells, dimensions)
    parts = Parts(
        table=table, active=active, facts=facts, contrasts=contrasts, evidence=evidence,
        obligations=lambda: selection.obligations(cells, facts.select("cell_id", "fact"), contrasts), coverage=lambda: selection.obligation_coverage(active, table, cells, facts, contrasts),
        alone=lambda: cut(selection.diagnostics(active, cells.select("cell_id", "n_items"), table, least_descriptors=least_descriptors, descriptors=descriptors, residual=evidence)),  # a row a candidate
        members=lambda: cut(selection.class_members(active, parts["alone"], table)), found=lambda: selection.collapsed(parts["alone"], parts["members"]), classes=lambda: selection.equivalence_classes(parts["members"]),
    )
    return parts


def uncoverable(obligations: DataFrame, coverage: DataFrame, found: DataFrame) -> DataFrame:
    """Obligations that no eligible candidate covers."""
    able = coverage.join(found.where("eligible").select("candidate"), "candidate", "left_semi").select("obligation").distinct()
    return obligations.join(able, "obligation", "left_anti")


def select_policy(parts: dict[str, DataFrame]) -> DataFrame:
    """The greedy cover of what was discovered; an obligation that nothing can cover is an error."""
    require_none(uncoverable(parts["obligations"], parts["coverage"], parts["found"]), "obligations that no eligible candidate covers")
    return selection.greedy_cover(parts["coverage"], parts["table"], parts["found"])


def statuses(trace: DataFrame, found: DataFrame, coverage: DataFrame) -> DataFrame:
    """Every candidate: selected, ineligible or not selected, and why."""
    chosen = trace.where("status = 'selected'").select("candidate", F.lit(True).alias("_in")).distinct()
    covers = coverage.select("candidate", F.lit(True).alias("_covers")).distinct()
    rows = found.join(chosen, "candidate", "left").join(covers, "candidate", "left")
    status = F.when(F.col("_in"), "selected").when(~F.col("eligible"), "ineligible").otherwise("not_selected")
    reason = (
        F.when(F.col("_in"), "kept after pruning").when(~F.col("eligible"), F.array_join("reasons", "; "))
        .when(F.col("_covers"), "its obligations are covered by preferred candidates").otherwise("covers no obligation")
    )
    return rows.select("candidate", status.alias("status"), reason.alias("reason"))


def objective(trace: DataFrame, found: DataFrame, table: DataFrame, obligations: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: whether the selected labels cover all obligations (feasible), how many there are of both, the labels'
    complexity, activations, interactions and least supports."""
    kept = trace.where("status = 'selected'").select("candidate").distinct()
    rows = kept.join(found.select("candidate", "cells", "items", "descriptors"), "candidate").join(table.select("candidate", "complexity", "interaction"), "candidate")
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = rows.agg(
        F.count("*").alias("n_labels"), zero(F.sum("complexity")).alias("complexity"), zero(F.sum("cells")).alias("activations"),
        zero(F.sum(F.col("interaction").cast("long"))).alias("n_interactions"), zero(F.min("cells")).alias("least_cells"), zero(F.min("items")).alias("least_items"), zero(F.min("descriptors")).alias("least_descriptors"),
    )
    covered = coverage.join(kept, "candidate", "left_semi").select("obligation").distinct()
    open_ = obligations.join(covered, "obligation", "left_anti").agg(F.count("*").alias("_open"))
    every = obligations.agg(F.count("*").alias("n_obligations"))
    return whole.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(open_)).withColumn("feasible", F.col("_open") == 0).drop("_open")


def compile_policy(selected: list[str], candidates: list[Candidate]) -> tuple[str, list[dict]]:
    """A stable id and the rules of the selected candidates, in order of id."""
    rules = [{"kc_id": c[0], "rule": c[6], "represents": c[5], "parents": c[4]} for c in sorted(candidates) if c[0] in selected]
    text = json.dumps(rules, sort_keys=True, separators=(",", ":"))
    return "POLICY_" + hashlib.sha256(text.encode()).hexdigest()[:16].upper(), rules


MODES = ("selected", "predefined", "frozen_rules", "frozen_full_cell")


def labelled_by(mode: str, items: DataFrame, cells: DataFrame, compiler: Compiler, rules: list[dict]) -> DataFrame:
    """items with kc_ids under a mode: given rules (selected or predefined), the rules that development
    supports, or one label for each development cell."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "frozen_full_cell":
        none = F.array().cast("array<string>")
        return audits.frozen_full_cell(items, cells).withColumn("kc_ids", F.when(F.col("kc").isNotNull(), F.array("kc")).otherwise(none)).drop("kc")
    if mode == "frozen_rules":
        rules = audits.frozen_rules(labels.label_items(items.where("canonical_split = 'development'"), compiler, rules), rules)
    return labels.label_items(items, compiler, rules)


def freeze(spark, policy_id: str, rules: list[dict], path: str | None = None) -> DataFrame:
    """Write the policy (to the checkpoint folder without a path) and read it back: what is evaluated is what
    was written before any holdout was read."""
    table = spark.createDataFrame([(policy_id, i, r["kc_id"], json.dumps(r, sort_keys=True)) for i, r in enumerate(rules)], "policy_id string, position long, kc string, rule string")
    if path is None:
        return cut(table)
    table.write.parquet(path)
    return spark.read.parquet(path)


def thawed(frozen: DataFrame) -> list[dict]:
    """The rules of a written policy, in their order."""
    return [json.loads(r["rule"]) for r in frozen.orderBy("position").collect()]  # the declared rules


def transfer(cells: DataFrame, rules: list[dict], compiler: Compiler, facts: DataFrame, contrasts: DataFrame) -> DataFrame:
    """One row a split: fact recall (1 without facts), cells that use development's labels only, and the share
    of one-difference contrasts (within the split and with development) whose labels differ, and which a label on the changed
    dimension alone tells apart."""
    spark = cells.sparkSession
    marked = labels.label_items(cells, compiler, rules).select("cell_id", "canonical_split", "kc_ids")
    known = marked.where("canonical_split = 'development'").select(F.explode("kc_ids").alias("kc")).distinct().withColumn("_known", F.lit(1))
    shown = spark.createDataFrame([(r["kc_id"], r.get("represents", "")) for r in rules], "kc string, fact string").where("fact <> ''")
    uses = marked.select("cell_id", "canonical_split", F.explode("kc_ids").alias("kc"))
    covered = uses.join(shown, "kc").select("cell_id", "fact").distinct().withColumn("_shown", F.lit(1))
    recall = facts.join(covered, ["cell_id", "fact"], "left").groupBy("canonical_split").agg(F.count("*").alias("n_facts"), F.count("_shown").alias("shown"))
    reused = uses.join(known, "kc", "left").groupBy("cell_id", "canonical_split").agg((F.count("_known") == F.count("*")).cast("long").alias("only_known")).groupBy("canonical_split").agg(F.sum("only_known").alias("reused_cells"))
    side = lambda s: marked.select(F.col("cell_id").alias(f"{s}_id"), F.col("canonical_split").alias(f"{s}_split"), F.col("kc_ids").alias(f"{s}_kcs"))
    own = candidate_dimensions(spark, [(r["kc_id"], 0, 0, 0, [], "", r["rule"]) for r in rules]).where(F.size("dimensions") == 1).select(F.col("candidate").alias("kc"), F.col("dimensions")[0].alias("dimension"))
    pairs = contrasts.select("left_id", "right_id", "dimension").join(side("left"), "left_id").join(side("right"), "right_id")
    a, b = F.col("left_split"), F.col("right_split")
    pairs = pairs.withColumn("canonical_split", F.when(a == b, a).when(a == "development", b).when(b == "development", a)).where("canonical_split is not null")
    apart = F.array_union(F.array_except("left_kcs", "right_kcs"), F.array_except("right_kcs", "left_kcs"))
    pairs = pairs.withColumn("apart", apart)
    seen = pairs.select("left_id", "right_id", "dimension", F.explode("apart").alias("kc")).join(own, ["kc", "dimension"], "left_semi").select("left_id", "right_id", F.lit(1).alias("_witness")).distinct()
    kept = pairs.join(seen, ["left_id", "right_id"], "left").groupBy("canonical_split").agg(
        F.count("*").alias("n_contrasts"), F.bround(F.avg((F.size("apart") > 0).cast("double")), 6).alias("contrast_preservation"), F.bround(F.count("_witness") / F.count("*"), 6).alias("witness_preservation"))
    base = cells.groupBy("canonical_split").agg(F.count("*").alias("n_cells"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = base.join(recall, "canonical_split", "left").join(reused, "canonical_split", "left").join(kept, "canonical_split", "left")
    return out.select("canonical_split", "n_cells", F.when(F.coalesce("n_facts", F.lit(0)) == 0, 1.0).otherwise(F.bround(F.col("shown") / F.col("n_facts"), 6)).alias("fact_recall"), zero("reused_cells"), zero("n_contrasts"), "contrast_preservation", "witness_preservation")

