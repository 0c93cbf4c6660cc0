"""Curating descriptor tables: filters, stratified samples, declared selections, constraint checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matches(conditions: dict) -> Column:
    """All fields have an expected value; null is matched by an expected None, and by that alone."""

    def one(field: str, expected) -> Column:
        values = expected if isinstance(expected, list) else [expected]
        known = [v for v in values if v is not None]
        out = F.coalesce(F.col(field).isin(known), F.lit(False)) if known else F.lit(False)
        return out | F.col(field).isNull() if None in values else out

    return reduce(lambda a, b: a & b, [one(f, e) for f, e in conditions.items()], F.lit(True))


def scope_filter(df: DataFrame, allowed: dict, excluded: dict | None = None) -> DataFrame:
    """Rows that match `allowed` and don't match a non-empty `excluded` in all its fields."""
    keep = matches(allowed)
    return df.where(keep & ~matches(excluded) if excluded else keep)


def stratified_sample(df: DataFrame, strata: list[dict], key: str, order: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Rows taken by strata in turn: each {where, quota, and perhaps minimum} takes up to its quota of the rows that earlier ones
    left, by `order` (compared as strings, null as empty) or by a seeded hash. Adds stratum and rank.

    A stratum that finds fewer rows than its minimum, or whose quota is less, is an error.
    The quota is a top-n, which tasks cut before the shuffle, so a large stratum isn't sorted whole.
    """
    rest, out = df, None
    for i, s in enumerate(strata):
        least = s.get("minimum", 0)
        if s["quota"] < least:
            raise ValueError(f"stratum {i}: quota {s['quota']} is under its minimum {least}")
        by = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order] if order else [F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(str(i)), F.col(key).cast("string")).cast("binary"), 256)]
        ranked = rest.where(matches(s["where"])).orderBy(*by, F.col(key)).limit(s["quota"])
        taken = ranked.withColumn("rank", F.row_number().over(Window.orderBy(*by, F.col(key))).cast("long")).withColumn("stratum", F.lit(i).cast("long"))  # at most quota rows
        if least and (found := taken.count()) < least:
            raise ValueError(f"stratum {i}: {found} rows of at least {least}")
        out = taken if out is None else out.unionByName(taken)
        rest = rest.join(taken.select(key), key, "left_anti")
    return out


def ordered_semi_join(df: DataFrame, declared: DataFrame, key: str, position: str = "position") -> DataFrame:
    """The declared rows with their declared position; the position is the order at a sink."""
    return df.join(declared, key)


def refines(child: Column, parent: Column) -> Column:
    """Whether every value of the child is one of the parent's; an unknown parent admits anything."""
    return F.when(parent["kind"] == "unknown", F.lit(True)).when(child["kind"] == "unknown", F.lit(False)).otherwise(F.size(F.array_except(child["values"], parent["values"])) == 0)


def implication_errors(compiler, implications: list[tuple]) -> Column:
    """Names of the implications whose first rule holds and whose second doesn't."""
    return F.array_compact(F.array(*[F.when(compiler.column(a) & ~compiler.column(b), F.lit(name)) for name, a, b in implications]))


def domain_errors(domains: dict[str, list[str]]) -> Column:
    """Names of the dimensions whose value is missing or not allowed."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(F.col(d).isin(values), F.lit(False)), F.lit(f"{d} is not allowed")) for d, values in domains.items()]))


#: Columns of an observable event, and names that would leak what must stay hidden.
EVENT_COLUMNS = ["event_id", "learner", "item_id", "seq", "ts", "correct"]
LEAKS = ("mastery", "kc_ids", "opportunity", "oracle", "private")


def reject_leaks(df: DataFrame, allowed: list[str] = EVENT_COLUMNS) -> DataFrame:
    """Fail on hidden or unexpected columns before any row is read."""
    bad = [c for c in df.columns if c not in allowed or any(w in c for w in LEAKS)]
    if bad:
        raise ValueError(f"columns not allowed in events: {bad}")
    return df


def event_errors() -> Column:
    """What is wrong with an event row."""
    tests = {
        "missing id": F.col("event_id").isNull() | F.col("learner").isNull() | F.col("item_id").isNull(),
        "outcome is not 0 or 1": ~F.coalesce(F.col("correct").isin(0, 1), F.lit(False)),
        "sequence is not positive": ~F.coalesce(F.col("seq") >= 1, F.lit(False)),
        "no time": F.col("ts").isNull(),
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))


def projection_errors(kc_ids: str, indices: str) -> Column:
    """An event's labels have no repeats, its index map has just these keys, and all indices are 1 or more."""
    keys = F.map_keys(indices)
    tests = {
        "repeated label": F.size(F.array_distinct(kc_ids)) < F.size(kc_ids),
        "index keys differ from labels": (F.size(F.array_except(keys, kc_ids)) > 0) | (F.size(F.array_except(kc_ids, keys)) > 0),
        "index below 1": ~F.forall(F.map_values(indices), lambda v: v >= 1),
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))


RESULTS = ["complete", "partial", "out_of_scope", "unresolved"]


#: Results that say nothing of the cells: they have none, and a note that says why.
ZERO_RESULTS = ["out_of_scope", "unresolved"]


def mapping_errors(dimensions: dict[str, list[str]], note: str | None = None) -> Column:
    """What is wrong with a mapping: columns id, result, cells array<struct<dimension: struct<kind, values>>>, and the
    note's column if there is one."""
    cells = F.col("cells")

    def bad_value(d: str):
        return lambda c: F.coalesce((c[d]["kind"] != "unknown") & (F.exists(c[d]["values"], lambda x: ~x.isin(dimensions[d])) | (F.size(c[d]["values"]) == 0)), F.lit(True))

    def repeated(d: str):
        return lambda c: F.size(F.array_distinct(c[d]["values"])) < F.size(c[d]["values"])

    tests = {"unknown result": ~F.coalesce(F.col("result").isin(RESULTS), F.lit(False))}
    for d in dimensions:
        tests[f"bad {d}"] = F.exists(cells, bad_value(d))
        tests[f"repeated {d}"] = F.exists(cells, repeated(d))
    scalar = lambda c: reduce(lambda a, b: a & b, [c[d]["kind"] == "scalar" for d in dimensions])
    tests["complete has open cells"] = (F.col("result") == "complete") & ((F.size(cells) == 0) | ~F.forall(cells, scalar))
    tests["out of scope has cells"] = (F.col("result") == "out_of_scope") & (F.size(cells) > 0)
    tests["unresolved has cells"] = (F.col("result") == "unresolved") & (F.size(cells) > 0)
    tests["partial has no cells"] = (F.col("result") == "partial") & (F.size(cells) == 0)
    tests["partial has no open cell"] = (F.col("result") == "partial") & F.forall(cells, scalar)
    if note:
        tests["no note"] = F.col("result").isin(ZERO_RESULTS) & (F.trim(F.coalesce(note, F.lit(""))) == "")
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items()]))


def key_errors(raw: str, keys: list[str], dimensions: list[str], cells: str = "cells", id_key: str | None = None, expected_id: Column | None = None) -> Column:
    """What is wrong with the keys of a mapping as text: not an object, other keys than `keys`, no list of cells, cells with other
    keys than the dimensions, an empty id or another one than expected. Order of keys is free."""
    whole = F.try_parse_json(raw)
    own = F.json_object_keys(raw)
    is_object = F.schema_of_variant(whole).startswith("OBJECT")
    parts = F.from_json(F.get_json_object(raw, f"$.{cells}"), "array<map<string,string>>")
    differs = lambda found, wanted: F.array_sort(found) != F.array(*[F.lit(k) for k in sorted(wanted)])
    tests = {
        "not an object": ~F.coalesce(is_object, F.lit(False)),
        "other keys": F.coalesce(differs(own, keys), F.lit(False)),
        "cells are no list": F.coalesce(is_object, F.lit(False)) & (~F.coalesce(F.schema_of_variant(F.try_variant_get(whole, f"$.{cells}", "variant")).startswith("ARRAY"), F.lit(False))),
        "other dimensions": F.coalesce(F.exists(parts, lambda c: F.coalesce(differs(F.map_keys(c), dimensions), F.lit(True))), F.lit(False)),
    }
    if id_key:
        found = F.get_json_object(raw, f"$.{id_key}")
        tests["no id"] = F.coalesce(is_object, F.lit(False)) & (F.coalesce(found, F.lit("")) == "")
        if expected_id is not None:
            tests["another id"] = F.coalesce((found != "") & (found != expected_id.cast("string")), F.lit(False))
    return F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))


def refinement_errors(parents: str, children: str, dimensions: list[str], eligible: str | None = None) -> Column:
    """Each child cell refines a parent and each parent has a child; nested array tests, no join. With a column of eligible
    dimensions only these may be refined, the others stay as they are."""

    def fits(c: Column, p: Column) -> Column:
        may = (lambda d: F.array_contains(eligible, d)) if eligible else (lambda d: F.lit(True))
        same = lambda d: (c[d]["kind"] == p[d]["kind"]) & (F.array_sort(c[d]["values"]) == F.array_sort(p[d]["values"]))
        return reduce(lambda a, b: a & b, [(may(d) & refines(c[d], p[d])) | same(d) for d in dimensions])

    orphan = F.exists(children, lambda c: ~F.exists(parents, lambda p: fits(c, p)))
    barren = F.exists(parents, lambda p: ~F.exists(children, lambda c: fits(c, p)))
    return F.array_compact(F.array(F.when(orphan, F.lit("a child refines no parent")), F.when(barren, F.lit("a parent has no child"))))


def eligibility(note: Column, known: list[str], mark: str = "phase2 eligible:") -> Column:
    """Sorted known names after the mark, up to a semicolon; empty without a mark."""
    text = F.regexp_extract(note, f"(?i){mark}\\s*([^;]*)", 1)
    names = F.transform(F.split(text, ","), lambda x: F.trim(x))
    return F.filter(F.array(*[F.lit(k) for k in known]), lambda k: F.array_contains(names, k))


def parse_mapping(text: str, schema: str) -> list[Column]:
    """The one JSON object of a raw answer, and an error where there is none or text around it."""
    body = F.trim(text)
    whole = body.rlike(r"(?s)^\{.*\}$")
    parsed = F.from_json(F.when(whole, body), schema)
    return [parsed.alias("mapping"), F.when(parsed.isNull(), F.lit("not one JSON object")).alias("error")]


def acceptance(items: DataFrame, diagnostics: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """items with accepted and reasons: every flag must be true; an item without a diagnostic is rejected."""
    joined = items.join(diagnostics.select(key, *flags, F.lit(True).alias("_seen")), key, "left")
    reasons = F.when(F.col("_seen").isNull(), F.array(F.lit("missing diagnostic"))).otherwise(F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f), F.lit(False)), F.lit(f)) for f in flags])))
    return joined.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0).drop(*flags, "_seen")
