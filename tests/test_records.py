"""Checks of mappings, second annotations and finished items: literal cases of each rule."""

import json

import pytest
from pyspark.sql import functions as F

from lucerna.functions.ids import content_id
from lucerna.operators import audits, canonical, curation, records

VALUE = "struct<kind:string,values:array<string>>"
CELL = f"struct<tense:{VALUE},voice:{VALUE}>"


def v(kind, *values):
    return {"kind": kind, "values": list(values)}


PAST, PRESENT, BOTH, OPEN = v("scalar", "past"), v("scalar", "present"), v("list", "present", "past"), v("unknown")
ACTIVE, ANY = v("scalar", "active"), v("unknown")


@pytest.mark.parametrize("result, cells, note, errors", [
    ("complete", [(PAST, ACTIVE)], None, []),
    ("complete", [], None, ["complete has open cells"]),
    ("complete", [(BOTH, ACTIVE)], None, ["complete has open cells"]),
    ("partial", [(BOTH, ACTIVE)], "x", []),
    ("partial", [(PAST, ACTIVE)], "x", ["partial has no open cell"]),
    ("partial", [], "x", ["partial has no cells", "partial has no open cell"]),
    ("unresolved", [], "why", []),
    ("unresolved", [(PAST, ACTIVE)], "why", ["unresolved has cells"]),
    ("unresolved", [], "  ", ["no note"]),
    ("out_of_scope", [], None, ["no note"]),
    ("out_of_scope", [(PAST, ACTIVE)], "why", ["out of scope has cells"]),
    ("perhaps", [], "x", ["unknown result"]),
    ("partial", [(v("list"), ACTIVE)], "x", ["bad tense"]),
    ("partial", [(v("list", "past", "past"), ACTIVE)], "x", ["repeated tense"]),
    ("partial", [(v("list", "past", "future"), ACTIVE)], "x", ["bad tense"]),
])
def test_mapping_rules(spark, result, cells, note, errors):
    df = spark.createDataFrame([(result, [{"tense": t, "voice": a} for t, a in cells], note)], f"result string, cells array<{CELL}>, note string")
    found = curation.mapping_errors({"tense": ["present", "past"], "voice": ["active", "passive"]}, "note")
    assert df.select(found.alias("e")).first().e == errors


def test_keys_of_mappings_as_text(spark):
    good = {"unit_id": "7", "result": "complete", "cells": [{"tense": "past", "voice": None}], "note": None}
    cases = [
        (good, []), (dict(reversed(good.items())), []), ({**good, "more": 1}, ["other keys"]), ({k: x for k, x in good.items() if k != "note"}, ["other keys"]), ({**good, "cells": {}}, ["cells are no list"]),
        ({**good, "cells": [{"tense": "past"}]}, ["other dimensions"]), ({**good, "cells": [good["cells"][0], {"tense": "a", "voice": "b", "mood": "c"}]}, ["other dimensions"]),
        ({**good, "unit_id": "8"}, ["another id"]), ({**good, "unit_id": ""}, ["no id"]), ({**good, "cells": []}, []),
    ]
    raw = [(json.dumps(c), e) for c, e in cases] + [("[1]", ["not an object"]), ("{", ["not an object"]), ("nothing", ["not an object"])]
    df = spark.createDataFrame([(r, e, 7) for r, e in raw], "raw string, want array<string>, id int")
    found = curation.key_errors("raw", list(good), ["tense", "voice"], id_key="unit_id", expected_id=F.col("id"))
    for r in df.select("raw", "want", found.alias("got")).collect():
        assert r.got == r.want, r.raw


@pytest.mark.parametrize("parent, child, eligible, errors", [
    ((BOTH, ANY), (PAST, ANY), ["tense"], []),
    ((OPEN, ANY), (BOTH, ANY), ["tense"], []),
    ((BOTH, ANY), (PAST, ACTIVE), ["tense"], ["a child refines no parent", "a parent has no child"]),
    ((BOTH, ANY), (PAST, ACTIVE), ["tense", "voice"], []),
    ((BOTH, ACTIVE), (v("scalar", "NA"), ACTIVE), ["tense"], ["a child refines no parent", "a parent has no child"]),
    ((BOTH, ANY), (v("list", "past", "present"), ANY), [], []),
])
def test_refinements_of_eligible_dimensions(spark, parent, child, eligible, errors):
    cell = lambda c: [{"tense": c[0], "voice": c[1]}]
    df = spark.createDataFrame([(cell(parent), cell(child), eligible)], f"parents array<{CELL}>, children array<{CELL}>, eligible array<string>")
    assert df.select(curation.refinement_errors("parents", "children", ["tense", "voice"], "eligible").alias("e")).first().e == errors


@pytest.mark.parametrize("first, second, note, tense, refined, errors", [
    ("partial", "complete", "", "past", [], []),
    ("partial", "partial", "", "past", ["a child refines no parent"], ["a child refines no parent"]),
    ("complete", "complete", "", "past", ["not read"], []),
    ("complete", "partial", "", "past", [], ["only partial mappings change"]),
    ("partial", "out_of_scope", "", "past", [], ["a refinement stays partial or becomes complete"]),
    ("unresolved", "complete", "", "past", [], ["an unresolved mapping can't be refined"]),
    ("unresolved", "unresolved", "", "past", [], []),
    ("partial", "unresolved", "phase2 contradiction: tense=past; evidence: it says so", "past", [], []),
    ("partial", "unresolved", "phase2 contradiction: tense=past; evidence: it says so", "present", [], ["contradiction isn't of a stated value"]),
    ("partial", "unresolved", "phase2 contradiction: tense=future; evidence: it", "past", [], ["contradiction names no known value"]),
    ("partial", "unresolved", "no such form", "past", [], ["contradiction note has another form"]),
])
def test_second_annotations(spark, first, second, note, tense, refined, errors):
    df = spark.createDataFrame([(first, second, note, tense, refined)], "first string, second string, note string, tense string, refined array<string>")
    found = records.transition_errors("first", "second", "note", {"tense": F.col("tense")}, {"tense": ["present", "past"]}, F.col("refined"))
    assert df.select(found.alias("e")).first().e == errors


@pytest.mark.parametrize("tense, modal, clause, errors", [
    ("past", "none", "declarative", []), ("NA", "can", "declarative", []), ("NA", "none", "imperative", []),
    ("past", "none", "imperative", ["imperative with tense or modal"]),
    ("past", "can", "declarative", ["tense beside a modal", "complete modal cell with tense"]),
    ("NA", "none", "declarative", ["complete cell without tense"]),
])
def test_tense_and_modal(spark, tense, modal, clause, errors):
    df = spark.createDataFrame([(tense, modal, clause)], "tense string, modal string, clause string")
    assert df.select(records.tense_errors().alias("e")).first().e == errors


def finished(spark, **change):
    row = {"item_id": 1, "stated_id": None, "cell_id": "c", "source_id": "s", "clause": "declarative", "voice": "active", "object": "it", "subject": "we", "prompt": "p1", "answer": "We saw it.", "operations": ["a"], "derived": ["a"], "tags": ["t", "u"], "reasons": ["r"], "contrast_id": None}
    schema = "item_id int, stated_id string, cell_id string, source_id string, clause string, voice string, object string, subject string, prompt string, answer string, operations array<string>, derived array<string>, tags array<string>, reasons array<string>, contrast_id string"
    df = spark.createDataFrame([tuple({**row, **change}.values())], schema)
    return df if "stated_id" in change else df.withColumn("stated_id", content_id("ITEM", F.col("cell_id"), F.col("prompt")))


@pytest.mark.parametrize("change, errors", [
    ({}, []), ({"stated_id": "ITEM_0123456789ABCDEF"}, ["id differs from its parts"]), ({"stated_id": "item_1"}, ["id has another form", "id differs from its parts"]), ({"source_id": "other"}, ["source isn't of the cell"]),
    ({"derived": ["b"]}, ["evidence differs from its derivation"]), ({"clause": "polar_question"}, ["answer ends with another sign"]), ({"voice": "passive"}, ["passive subject isn't the patient"]), ({"voice": "passive", "subject": "it"}, []),
    ({"tags": ["u", "t"]}, ["tags aren't sorted and distinct"]), ({"tags": ["t", "t"]}, ["tags aren't sorted and distinct"]), ({"reasons": []}, ["no reasons"]), ({"contrast_id": "k"}, ["contrast set isn't of two"]),
])
def test_finished_items(spark, change, errors):
    edges = spark.createDataFrame([("c", "s"), ("d", "other")], "cell_id string, source_id string")
    contrasts = spark.createDataFrame([("k", ["contrast set isn't of two"])], "contrast_id string, errors array<string>")
    assert audits.hard_item_errors(finished(spark, **change), edges, contrasts, ["cell_id", "prompt"]).first().errors == errors


def test_contribution_changes_of_repeats(spark):
    rows = [(1, ["a"], ["a"]), (2, ["a", "b"], ["b", "c"]), (3, None, ["a"]), (4, ["a"], None), (5, [], [])]
    out = canonical.contribution_changes(spark.createDataFrame(rows, "i int, primary_cells array<string>, repeat_cells array<string>"))
    assert {r.i: (r.added, r.removed, r.affects_inventory) for r in out.collect()} == {1: ([], [], False), 2: (["c"], ["a"], True), 3: (["a"], [], True), 4: ([], ["a"], True), 5: ([], [], False)}


def test_alignment_with_a_private_table(spark):
    make = lambda rows: spark.createDataFrame(rows, "learner int, event_id int, seq int, f array<string>")
    observed = make([(1, 1, 1, ["x"]), (1, 2, 2, ["x"]), (2, 3, 1, None), (3, 5, 1, ["x"]), (4, 7, 1, ["x"])])
    private = make([(1, 1, 2, ["x"]), (1, 2, 1, ["y"]), (2, 3, 1, None), (3, 6, 1, ["x"]), (5, 8, 1, ["x"])])
    got = {r.learner: tuple(r)[1:] for r in canonical.private_alignment(observed, private, features="f").collect()}
    assert got == {1: (2, 0, 0, 2, 1, False), 2: (1, 0, 0, 0, 0, True), 3: (0, 1, 1, 0, 0, False), 4: (0, 1, 0, 0, 0, False), 5: (0, 0, 1, 0, 0, False)}
    assert canonical.private_alignment(observed.where("learner = 1"), private.where("learner = 1")).first().moved == 2


def test_labels_of_long_ids_are_whole(spark):
    long = "CELL_" + "F" * 60
    cells = spark.createDataFrame([(long, "development")], "cell_id string, canonical_split string")
    assert audits.frozen_full_cell(cells.select("cell_id"), cells).first().kc == "K_FULL_" + "F" * 60
    tag = spark.createDataFrame([(["frame:" + "x" * 12_000, "b:1"],)], "tags array<string>")
    assert tag.select(audits.tag_value("tags", "frame:").alias("v")).first().v == "x" * 12_000
