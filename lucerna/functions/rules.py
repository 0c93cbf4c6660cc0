"""Declarative rules compiled to columns.

A rule is a dict with one of the keys all, any, operation, cell or a scalar field, looked up in this order.
`all` of nothing holds and `any` of nothing doesn't; a list of expected values means any of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = dict


class Compiler:
    """Where a rule's fields live: the operations array, a column for each cell dimension, scalar fields."""

    def __init__(self, dimensions: dict[str, str], operations: str = "operations", fields: tuple[str, ...] = ("agreement_site", "frame_type")):
        self.dimensions, self.operations, self.fields = dimensions, operations, fields

    @staticmethod
    def _equals(column: str, expected) -> Column:
        return F.col(column).isin(expected) if isinstance(expected, list) else F.col(column) == F.lit(expected)

    def column(self, rule: Rule) -> Column:
        """Whether the rule holds; a null field counts as no match."""
        if "all" in rule:
            return reduce(lambda a, b: a & b, map(self.column, rule["all"]), F.lit(True))
        if "any" in rule:
            return reduce(lambda a, b: a | b, map(self.column, rule["any"]), F.lit(False))
        if "operation" in rule:
            return F.coalesce(F.array_contains(self.operations, rule["operation"]), F.lit(False))
        if "cell" in rule:
            parts = [F.coalesce(self._equals(self.dimensions[k], v), F.lit(False)) for k, v in rule["cell"].items()]
            return reduce(lambda a, b: a & b, parts, F.lit(True))
        for field in self.fields:
            if field in rule:
                return F.coalesce(self._equals(field, rule[field]), F.lit(False))
        raise ValueError(f"rule has no known key: {sorted(rule)}")

    def evidence(self, rule: Rule) -> list[Column]:
        """struct(field, expected, actual, matched) of every leaf, in the rule's order."""
        if "all" in rule or "any" in rule:
            return [leaf for part in rule.get("all", rule.get("any")) for leaf in self.evidence(part)]
        if "cell" in rule:
            return [self._leaf(f"cell.{k}", v, F.col(self.dimensions[k]), self.column({"cell": {k: v}})) for k, v in rule["cell"].items()]
        if "operation" in rule:
            return [self._leaf("operations", rule["operation"], F.array_join(self.operations, ","), self.column(rule))]
        field = next(f for f in self.fields if f in rule)
        return [self._leaf(field, rule[field], F.col(field), self.column(rule))]

    @staticmethod
    def _leaf(field: str, expected, actual: Column, matched: Column) -> Column:
        text = ",".join(map(str, expected)) if isinstance(expected, list) else str(expected)
        return F.struct(F.lit(field).alias("field"), F.lit(text).alias("expected"), actual.cast("string").alias("actual"), matched.alias("matched"))

    def labels(self, rules: list[Rule]) -> Column:
        """Sorted ids of the rules that hold."""
        return F.array_sort(F.array_compact(F.array(*[F.when(self.column(r["rule"]), F.lit(r["kc_id"])) for r in rules])))


#: Alternatives that a rule may expand to.
MOST_CONJUNCTS = 10_000


def conjuncts(rule: Rule, fields: tuple[str, ...] = ("agreement_site", "frame_type")) -> list[list[frozenset[str]]]:
    """The rule as alternatives, each a list of sets of atoms: it holds if some alternative has an atom of each of its
    sets. Atoms are `field=value`; `any` of single sets stays one set, so only nested alternatives multiply."""
    values = lambda field, v: frozenset(f"{field}={x}" for x in (v if isinstance(v, list) else [v]))
    if "all" in rule:
        out: list[list[frozenset[str]]] = [[]]
        for part in rule["all"]:
            own = conjuncts(part, fields)
            if len(out) * len(own) > MOST_CONJUNCTS:
                raise ValueError(f"a rule has over {MOST_CONJUNCTS} alternatives")
            out = [a + b for a in out for b in own]
        return out
    if "any" in rule:
        parts = [c for p in rule["any"] for c in conjuncts(p, fields)]
        single = [c[0] for c in parts if len(c) == 1]
        return [c for c in parts if len(c) != 1] + ([[frozenset().union(*single)]] if single else [])
    if "operation" in rule:
        return [[values("operation", rule["operation"])]]
    if "cell" in rule:
        return [[values(f"cell.{k}", v) for k, v in rule["cell"].items()]]
    for field in fields:
        if field in rule:
            return [[values(field, rule[field])]]
    raise ValueError(f"rule has no known key: {sorted(rule)}")


def operation_scope(rule: Rule) -> bool:
    """Whether an operation leaf is reached through `all` alone; `any` isn't looked through."""
    return "operation" in rule or any(operation_scope(p) for p in rule.get("all", ()))


def facts(compiler: Compiler, fact_rules: list[dict]) -> Column:
    """Sorted facts of the rules that hold: a literal `fact`, or a `template` with {dimension} places."""

    def text(rule: dict) -> Column:
        if "fact" in rule:
            return F.lit(rule["fact"])
        out = F.lit(rule["template"])
        for name, column in compiler.dimensions.items():
            out = F.replace(out, F.lit("{" + name + "}"), F.col(column))
        return out

    return F.array_sort(F.array_compact(F.array(*[F.when(compiler.column(r["rule"]), text(r)) for r in fact_rules])))


def merged(base: list[Rule], extra: list[Rule]) -> list[Rule]:
    """Base rules followed by further ones; ids are unique."""
    both = [*base, *extra]
    if len({r["kc_id"] for r in both}) < len(both):
        raise ValueError("a rule id occurs twice")
    return both
