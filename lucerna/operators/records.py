"""Checks of single records as columns of errors, projections of the fields that are kept, and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.operators.curation import event_errors
from lucerna.sources.files import checked


def errors_of(tests: dict[str, Column]) -> Column:
    """Names of the tests that find something; one that can't tell counts as nothing found."""
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items()]))


def kept_fields(df: DataFrame, fields: list[str], key: str) -> DataFrame:
    """The named fields, null where the table lacks one; a row whose key is missing or empty fails the job."""
    out = df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])
    return checked(out, F.coalesce(F.col(key).cast("string"), F.lit("")) != "", f"missing {key}")


def same_keys(left: Column, right: Column) -> Column:
    """Whether two arrays hold the same values."""
    return (F.size(F.array_except(left, right)) == 0) & (F.size(F.array_except(right, left)) == 0)


def opportunity_errors(cell: list[str], sources: str = "sources", notes: str = "notes") -> Column:
    """A labelling opportunity has its id, split and whole cell, and notes of just its sources."""
    tests = {f"missing {c}": F.col(c).isNull() for c in ["opportunity_id", "canonical_split", "cell_id", *cell]}
    return errors_of(tests | {"notes differ from sources": ~same_keys(F.map_keys(notes), F.col(sources))})


#: What a probe of each split is called, and the role its events have.
PROBE_TYPES = {"development": "development_acquisition", "compositional_holdout": "compositional_holdout", "novel_feature_holdout": "novel_feature_holdout"}


def compositional_errors(role: str = "role", probe_type: str = "probe_type", split: str = "canonical_split") -> Column:
    """An acquisition or probe event: a well-formed event whose role, probe type and split go together."""
    r, s = F.col(role), F.col(split)
    expected = F.create_map(*[F.lit(x) for pair in PROBE_TYPES.items() for x in pair])
    tests = {
        "unknown split": ~F.coalesce(s.isin(list(PROBE_TYPES)), F.lit(False)),
        "unknown role": ~F.coalesce(r.isin("acquisition", "probe"), F.lit(False)),
        "probe type differs from split": ~F.col(probe_type).eqNullSafe(F.try_element_at(expected, s)),
        "acquisition of a holdout item": (r == "acquisition") & (s != "development"),
        "probe of a development item": (r == "probe") & (s == "development"),
    }
    return F.concat(event_errors(), errors_of(tests))


def support_errors(active: str = "kc_ids", supported: str = "supported", cold: str = "cold", indices: str = "indices", covered: str = "covered", full: str = "fully_supported") -> Column:
    """A projected compositional event: supported and cold labels part the active ones, indices belong to
    these and start at 1, and the flags follow from the labels."""
    a, s, c = F.col(active), F.col(supported), F.col(cold)
    repeats = lambda x: F.size(F.array_distinct(x)) < F.size(x)
    return errors_of({
        "repeated label": repeats(a) | repeats(s) | repeats(c),
        "supported and cold don't part the labels": ~same_keys(F.array_union(s, c), a) | (F.size(F.array_intersect(s, c)) > 0),
        "index keys differ from labels": ~same_keys(F.map_keys(indices), a),
        "index below 1": F.exists(F.map_values(indices), lambda v: v < 1),
        "covered flag is wrong": F.col(covered) != (F.size(a) > 0),
        "supported flag is wrong": F.col(full) != ((F.size(a) > 0) & (F.size(c) == 0)),
    })


def private_errors(features: str = "features", maps: tuple[str, ...] = ("opportunities", "before", "after")) -> Column:
    """A private event: some features, and maps over just these."""
    f = F.col(features)
    return errors_of({"no features": F.coalesce(F.size(f) <= 0, F.lit(True)), **{f"{m} differs from features": ~same_keys(F.map_keys(m), f) for m in maps}})


def parsed_diagnostic(raw: str, flags: list[str], text: str) -> Column:
    """struct(values, error) of a raw diagnostic: one JSON object with just these boolean flags and this text."""
    schema = ", ".join([*(f"`{f}` boolean" for f in flags), f"`{text}` string"])
    names, values = F.json_object_keys(raw), F.from_json(raw, schema)
    wrong = F.lit(False)
    for f in [*flags, text]:
        wrong = wrong | values[f].isNull()
    error = F.when(names.isNull(), "not a JSON object").when(~same_keys(names, F.array(*[F.lit(f) for f in [*flags, text]])), "fields differ").when(wrong, "a field has another type")
    return F.struct(F.when(error.isNull(), values).alias("values"), error.alias("error"))


def routed(mappings: DataFrame, result: str = "result") -> DataFrame:
    """mappings with second_phase and why: only partial ones go on."""
    r = F.col(result)
    why = F.when(r == "partial", "open dimensions").when(r == "complete", "nothing is open").otherwise(F.concat(F.lit("result is "), F.coalesce(r, F.lit("missing"))))
    return mappings.withColumn("second_phase", F.coalesce(r == "partial", F.lit(False))).withColumn("why", why)


def eligibility_errors(note: Column, known: list[str], mark: str = "phase2 eligible:") -> Column:
    """What is wrong with the names after the mark: unknown, repeated, or out of the canonical order."""
    text = F.regexp_extract(note, f"(?i){mark}\\s*([^;]*)", 1)
    names = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    every = F.array(*[F.lit(k) for k in known])
    return errors_of({
        "unknown name": F.size(F.array_except(names, every)) > 0,
        "repeated name": F.size(F.array_distinct(names)) < F.size(names),
        "not in canonical order": F.array_distinct(F.filter(names, lambda x: F.array_contains(every, x))) != F.filter(every, lambda k: F.array_contains(names, k)),
    })


def tense_errors(tense: str = "tense", modal: str = "modal", clause: str = "clause", complete: Column | None = None) -> Column:
    """What is wrong with the scalar tense and modal of a cell: imperatives have neither, a modal excludes a tense,
    and a complete cell without modal has present or past."""
    t, m, imperative = F.col(tense), F.col(modal), F.col(clause) == "imperative"
    whole = F.lit(True) if complete is None else complete
    return errors_of({
        "imperative with tense or modal": imperative & ((t != "NA") | (m != "none")),
        "tense beside a modal": t.isin("present", "past") & (m != "none"),
        "complete cell without tense": whole & ~imperative & (m == "none") & ~t.isin("present", "past"),
        "complete modal cell with tense": whole & ~imperative & (m != "none") & (t != "NA"),
    })


#: How a note says that a source contradicts a value (fixed form): dimension, value and the evidence.
CONTRADICTION = r"^phase2 contradiction: ([a-z_]+)=([^;]+); evidence: (.+)$"


def transition_errors(first: str, second: str, note: str, value_of: dict[str, Column], domains: dict[str, list[str]], refined: Column) -> Column:
    """What is wrong with a second annotation: only partial results may change (`refined` holds the errors of a
    refinement), an unresolved one must name a value of the first, and others stay as they were."""
    one, two = F.col(first), F.col(second)
    dimension, value = F.regexp_extract(note, CONTRADICTION, 1), F.regexp_extract(note, CONTRADICTION, 2)
    known, exact = F.lit(False), F.lit(False)
    for d, values in domains.items():
        known = known | ((dimension == d) & value.isin(values))
        exact = exact | ((dimension == d) & (value == value_of[d]))
    form = F.coalesce(F.col(note).rlike(CONTRADICTION), F.lit(False))
    contradicted = errors_of({"contradiction note has another form": ~form, "contradiction names no known value": form & ~known, "contradiction isn't of a stated value": form & known & ~exact})
    return (
        F.when((one == "unresolved") & (two != "unresolved"), F.array(F.lit("an unresolved mapping can't be refined")))
        .when((two == "unresolved") & (one != "unresolved"), contradicted)
        .when((one != "partial") & (one != two), F.array(F.lit("only partial mappings change")))
        .when((one == "partial") & ~two.isin("partial", "complete"), F.array(F.lit("a refinement stays partial or becomes complete")))
        .when(one == "partial", refined).otherwise(F.array().cast("array<string>"))
    )
