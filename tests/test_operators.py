"""Literal cases, properties and plain-Python restatements of single operators."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lucerna.functions import ids
from lucerna.functions.positions import with_positions
from lucerna.functions.rules import Compiler, facts, merged, operation_scope
from lucerna.operators import canonical, curation, evaluation, guards, history, labels, policies, selection, tracing
from lucerna.sources import files

C = Compiler({"a": "a", "b": "b"})


def one(df):
    return df.collect()[0]


def test_rules_follow_key_precedence_and_empty_forms(spark):
    df = spark.createDataFrame([("x", "y", ["p"])], "a string, b string, operations array<string>")
    assert one(df.select(C.column({"all": [], "operation": "q"}).alias("m"))).m is True
    assert one(df.select(C.column({"any": []}).alias("m"))).m is False
    assert one(df.select(C.column({"cell": {"a": ["x", "z"], "b": "y"}}).alias("m"))).m is True
    assert one(df.select(C.column({"operation": "p"}).alias("m"))).m is True
    with pytest.raises(ValueError):
        C.column({"other": 1})


def test_null_fields_match_no_rule(spark):
    df = spark.createDataFrame([(None, None, None)], "a string, b string, operations array<string>")
    rules = [{"kc_id": "K1", "rule": {"cell": {"a": "x"}}}, {"kc_id": "K2", "rule": {"operation": "p"}}]
    assert one(df.select(C.labels(rules).alias("k"))).k == []


def test_scope_looks_through_all_only():
    assert operation_scope({"all": [{"operation": "p"}]})
    assert not operation_scope({"any": [{"operation": "p"}]})
    with pytest.raises(ValueError):
        merged([{"kc_id": "K"}], [{"kc_id": "K"}])


def test_facts_fill_templates(spark):
    df = spark.createDataFrame([("x", "y", [])], "a string, b string, operations array<string>")
    rules = [{"rule": {"cell": {"a": "x"}}, "template": "t:{b}"}, {"rule": {"cell": {"b": "y"}}, "fact": "f"}]
    assert one(df.select(facts(C, rules).alias("f"))).f == ["f", "t:y"]


def test_content_id_renders_null(spark):
    import hashlib

    got = one(spark.range(1).select(ids.content_id("P", F.lit("a"), None).alias("i"))).i
    assert got == "P_" + hashlib.sha256(b"a|null").hexdigest()[:16].upper()


def test_hash_uniform_equals_python(spark):
    import hashlib

    got = one(spark.range(1).select(ids.hash_uniform(F.lit(5), F.lit("q"), low=1, high=3).alias("u"))).u
    assert got == pytest.approx(1 + 2 * int(hashlib.sha256(b"5|q").hexdigest()[:16], 16) / (2**64 - 1), abs=1e-12)


@pytest.mark.parametrize("n, ends", [(90, (54, 72)), (21, (12, 16)), (3, (1, 2)), (2, (1, 2)), (1, (1, 1))])
def test_chronological_split_boundaries(spark, n, ends):
    df = spark.range(1, n + 1).select(F.lit("l").alias("learner"), F.col("id").alias("seq"))
    parts = {r[0]: r[1] for r in history.chronological_split(df).groupBy("dataset_split").count().collect()}
    assert (parts.get("train", 0), parts.get("train", 0) + parts.get("validation", 0)) == ends


def test_frozen_probe_shares_label(spark):
    schema = "learner string, seq long, item_id long, correct int, kc_ids array<string>"
    past = spark.createDataFrame([("l", 1, 1, 1, ["K"]), ("l", 2, 1, 1, ["K"])], schema).withColumn("dataset_split", F.lit("train"))
    probe = spark.createDataFrame([("l", 3, 2, 0, ["K"]), ("l", 4, 2, 1, ["K", "COLD"]), ("l", 5, 3, 1, [])], schema)
    out = {r.seq: r for r in tracing.frozen_probes(past, probe, tracing.initial_mastery(past, ["K", "COLD"])).collect()}
    assert out[3].empirical == pytest.approx(0.75)
    assert out[4].fallback == "cold_label" and out[4].empirical == pytest.approx((0.75 + 0.5) / 2)
    assert out[5].fallback == "no_label" and out[5].empirical == pytest.approx(0.75)


def events(spark, seed=3, n=60):
    rnd = random.Random(seed)
    rows = [(f"l{i % 4}", i // 4 + 1, i, rnd.randint(0, 1), rnd.sample(["A", "B", "C"], rnd.randint(0, 2))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "learner string, seq long, item_id long, correct int, kc_ids array<string>")


def test_bkt_equals_plain_python(spark):
    rows, df = events(spark)
    df = df.withColumn("dataset_split", F.lit("train"))
    start = {r.kc: r.initial for r in tracing.initial_mastery(df, ["A", "B", "C"]).collect()}
    got = {(r.learner, r.seq): r.bkt for r in tracing.bkt_predictions(df, tracing.initial_mastery(df, ["A", "B", "C"])).collect()}
    state, seen = {}, {}
    for learner, seq, _, y, kcs in sorted(rows):
        m = state.setdefault(learner, dict(start))
        s, n = seen.get(learner, (0, 0))
        want = 0.2 + 0.7 * sum(m[k] for k in kcs) / len(kcs) if kcs else (s + 1) / (n + 2)
        assert got[(learner, seq)] == pytest.approx(want, abs=1e-12)
        for k in kcs:
            p = m[k]
            post = p * 0.9 / (p * 0.9 + (1 - p) * 0.2) if y else p * 0.1 / (p * 0.1 + (1 - p) * 0.8)
            m[k] = post + (1 - post) * 0.04
        seen[learner] = (s + y, n + 1)


def test_later_outcomes_do_not_change_earlier_rates(spark):
    rows, df = events(spark)
    changed = df.withColumn("correct", F.when(F.col("seq") >= 8, 1 - F.col("correct")).otherwise(F.col("correct")))
    keep = lambda d: {(r.learner, r.seq): (r.overall_rate, r.active_rate) for r in history.prior_rates(d).where("seq <= 8").collect()}
    assert keep(df) == keep(changed)


def test_auc_counts_ties_half(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([0.1, 0.4, 0.5, 0.9]), rnd.randint(0, 1)) for _ in range(80)]
    got = one(evaluation.auc(spark.createDataFrame(rows, "prediction double, correct int").withColumn("k", F.lit(1)), ["k"])).auc
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    assert got == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    single = spark.createDataFrame([(0.3, 1)], "prediction double, correct int").withColumn("k", F.lit(1))
    assert one(evaluation.auc(single, ["k"])).auc is None


def test_ece_last_bin_is_closed_and_metrics_clip(spark):
    df = spark.createDataFrame([(1.0, 1), (0.0, 0)], "prediction double, correct int").withColumn("k", F.lit(1))
    assert one(evaluation.ece(df, ["k"])).ece == pytest.approx(1e-6, abs=1e-9)
    assert one(evaluation.metrics(df, ["k"])).log_loss == pytest.approx(1e-6, rel=1e-2)


def test_bootstrap_is_deterministic_and_paired(spark):
    df = spark.createDataFrame([("u", 1, 0.9, 0.5), ("u", 1, 0.8, 0.5), ("v", 0, 0.1, 0.5), ("v", 0, 0.3, 0.5)], "learner string, correct int, a double, b double")
    first, again = (one(evaluation.paired_bootstrap(d, 50)) for d in (df, df.orderBy(F.desc("learner"))))
    assert first == again and (first.n_learners, first.n_events) == (2, 4) and first.difference < 0 and first.direction == "a better"


def test_positions_cover_the_order(spark):
    df = spark.range(101).select(((F.col("id") * 37) % 101).alias("x"))
    assert sorted((r.x, r.position) for r in with_positions(df, ["x"]).collect()) == [(i, i) for i in range(101)]


def test_hamming_pairs_equal_all_pairs_with_nulls(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(itertools.product(["x", "y", None], ["p", "q", None]))]
    got = {(r.left_id, r.right_id, r.dimension) for r in canonical.hamming_one(spark.createDataFrame(rows, "cell_id long, a string, b string"), ["a", "b"]).collect()}
    want = {(l[0], r[0], "a" if l[1] != r[1] else "b") for l in rows for r in rows if l[0] < r[0] and (l[1] != r[1]) + (l[2] != r[2]) == 1}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_contrast_matching_equals_sequential_scan(spark, seed):
    rnd = random.Random(seed)
    pairs = sorted({tuple(sorted(rnd.sample(range(14), 2))) for _ in range(30)})
    used, want = set(), set()
    for a, b in pairs:
        if not {a, b} & used:
            want.add((a, b))
            used |= {a, b}
    assert {(r.a, r.b) for r in canonical.contrast_matching(spark.createDataFrame(pairs, "a long, b long")).collect()} == want


def test_sampler_ignores_input_order(spark):
    rows = [("B", "VERBS", "B2"), ("A", "VERBS", "B1"), ("C", "NOUNS", "B1")]
    for data in (rows, rows[::-1]):
        df = curation.scope_filter(spark.createDataFrame(data, "id string, category string, level string"), {"category": "VERBS"})
        assert df.count() == 2
        assert [r.id for r in curation.stratified_sample(df, [{"where": {}, "quota": 1}], "id", ["id"]).collect()] == ["A"]


def test_expected_null_matches_null_alone(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, f string")
    assert [r.id for r in df.where(curation.matches({"f": None})).collect()] == [1]
    assert [r.id for r in df.where(curation.matches({"f": ["x", None]})).orderBy("id").collect()] == [1, 2]


def test_leaked_columns_are_refused(spark):
    df = spark.createDataFrame([(1, "l", 1, 1, "t", 0, 0.5)], "event_id long, learner string, item_id long, seq long, ts string, correct int, mastery double")
    with pytest.raises(ValueError):
        curation.reject_leaks(df)


def test_identical_columns_and_empty_labels(spark):
    df = spark.createDataFrame([(1, ["A", "B"]), (2, [])], "item_id long, kc_ids array<string>")
    assert {(r.kc_left, r.kc_right) for r in labels.identical_columns(df, ["A", "B", "Y", "Z"]).collect()} == {("A", "B"), ("Y", "Z")}
    assert {tuple(r) for r in labels.wide(df, ["A", "B"]).collect()} == {(1, 1, 1), (2, 0, 0)}


def test_projection_checks(spark):
    df = spark.createDataFrame([(["A", "A"], {"A": 1}), (["A"], {"A": 0}), (["A"], {"A": 2})], "k array<string>, i map<string,int>")
    assert [len(r.e) for r in df.select(curation.projection_errors("k", "i").alias("e")).collect()] == [1, 1, 0]


def test_greedy_cover_equals_plain_python(spark):
    rnd = random.Random(4)
    names = [f"c{i}" for i in range(7)]
    cover = {n: {f"o{o}" for o in rnd.sample(range(12), 4)} for n in names}
    cover["c0"] |= {f"o{o}" for o in range(12)} - set().union(*cover.values())
    parents = {"c5": ["c1"]}
    table = spark.createDataFrame([(n, 0, 1, 1 + i % 2, parents.get(n, []), n, n in parents) for i, n in enumerate(names)], "candidate string, origin long, granularity long, complexity long, parents array<string>, represents string, interaction boolean")
    found = spark.createDataFrame([(n, len(cover[n]), 3, True) for n in names], "candidate string, cells long, items long, eligible boolean")
    pairs = spark.createDataFrame([(n, o) for n in names for o in cover[n]], "candidate string, obligation string")
    got = selection.greedy_cover(pairs, table, found).collect()
    chosen, left = [], set().union(*cover.values())
    while left:
        best = min(((-len(set().union(*(cover[m] for m in b)) & left), len(b), sum(1 + names.index(m) % 2 for m in b), sum(len(cover[m]) for m in b), sum(m in parents for m in b), -min(min(len(cover[m]), 3) for m in b), n), b)
                   for n in names for b in [[m for m in [n, *parents.get(n, [])] if m not in chosen]] if b and set().union(*(cover[m] for m in b)) & left)
        chosen += sorted(best[1], key=lambda m: (m in parents, m))
        left -= set().union(*(cover[m] for m in best[1]))
    kept = list(chosen)
    for c in reversed(chosen):
        rest = [k for k in kept if k != c]
        if not any(c in parents.get(k, []) for k in rest) and set().union(*(cover[k] for k in rest)) == set().union(*cover.values()):
            kept = rest
    assert [r.candidate for r in sorted(got, key=lambda r: chosen.index(r.candidate))] == chosen
    assert {r.candidate for r in got if r.status == "selected"} == set(kept)


def test_holdout_rows_do_not_change_support(spark):
    base = spark.createDataFrame([(1, "c1", "development", ["A"]), (2, "c2", "novel_feature_holdout", ["B"])], "item_id long, cell_id string, canonical_split string, kc_ids array<string>")
    more = base.unionByName(base.where("item_id = 2").withColumn("item_id", F.lit(3).cast("long")))
    assert labels.rule_support(base).collect() == labels.rule_support(more).collect()


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"b": "é", "a": null}\n\n{"b": "x", "a": 2}\n', encoding="utf-8")
    df = files.read_jsonl(spark, str(tmp_path / "in.jsonl"), "b string, a int")
    files.write_jsonl(df.coalesce(1), str(tmp_path / "out"), sort_keys=True)
    lines = [x for p in (tmp_path / "out").glob("part-*") for x in p.read_text(encoding="utf-8").splitlines()]
    assert lines == ['{"a":null,"b":"é"}', '{"a":2,"b":"x"}']
    (tmp_path / "ids.txt").write_text("z\n\n a\nm\n")
    assert [tuple(r) for r in files.read_id_list(spark, str(tmp_path / "ids.txt")).orderBy("position").collect()] == [(1, "z"), (2, "a"), (3, "m")]
    (tmp_path / "doc.json").write_text(json.dumps({"rows": [{"k": 1}, {"k": 2}]}))
    assert files.read_json_table(spark, str(tmp_path / "doc.json"), "rows").count() == 2
    import hashlib

    digest = hashlib.sha256((tmp_path / "ids.txt").read_bytes()).hexdigest()
    assert files.require_digest(spark, str(tmp_path / "ids.txt"), digest) == digest
    with pytest.raises(ValueError):
        files.require_digest(spark, str(tmp_path / "ids.txt"), "0" * 64)
    with pytest.raises(ValueError):
        files.require_count(df, 5)
    with pytest.raises(Exception, match="no a"):
        files.checked(df, F.col("a").isNotNull(), "no a").collect()


def test_run_comparison(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k long, v string")
    b = spark.createDataFrame([(2, None), (3, "y"), (4, "n")], "k long, v string")
    assert {tuple(r) for r in canonical.keyed_delta(a, b, ["k"], ["v"]).collect()} == {(1, "removed"), (3, "changed"), (4, "added")}
    same = canonical.fingerprint(a, ["k", "v"]).collect()
    assert same == canonical.fingerprint(a.orderBy(F.desc("k")), ["v", "k"]).collect() != canonical.fingerprint(b, ["k", "v"]).collect()


def test_entry_contract(spark, tables):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


# Guards

def events_of(spark, rows):
    return spark.createDataFrame(rows, "event_id long, learner string, item_id long, seq long, correct int")


def test_exact_projection_refuses_what_does_not_cover(spark):
    events = events_of(spark, [(1, "a", 1, 1, 1), (2, "a", 2, 2, 0)])
    marked = spark.createDataFrame([(1, ["K"]), (2, [])], "item_id long, kc_ids array<string>")
    assert {(r.event_id, tuple(r.kc_ids)) for r in guards.exact_projection(events, marked).collect()} == {(1, ("K",)), (2, ())}
    for bad_events, bad_marks in [(events, marked.where("item_id = 1")), (events.where("item_id = 1"), marked), (events, marked.union(marked)), (events.union(events), marked)]:
        with pytest.raises(ValueError):
            guards.exact_projection(bad_events, bad_marks)


def test_lookup_and_probes_fail_on_unknown_keys(spark):
    left, known = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "x")], "k long, v string")
    assert guards.lookup(left.where("k = 1"), known, "k").collect()[0].v == "x"
    with pytest.raises(Exception, match="unknown k"):
        guards.lookup(left, known, "k").collect()
    history_ = spark.createDataFrame([("a", 1, 1, 1, ["K"], "train")], "learner string, seq long, item_id long, correct int, kc_ids array<string>, dataset_split string")
    probes = history_.withColumn("learner", F.lit("nobody")).drop("dataset_split")
    with pytest.raises(Exception, match="unknown learner"):
        tracing.frozen_probes(history_, probes, tracing.initial_mastery(history_, ["K"])).collect()


def test_paired_predictions_are_of_the_same_events(spark):
    rows = spark.createDataFrame([(1, "a", 1, 1, 0.5), (2, "a", 2, 0, 0.4)], "event_id long, learner string, item_id long, correct int, p double")
    assert guards.paired_predictions(rows, rows, "p").count() == 2
    for other in (rows.where("event_id = 1"), rows.withColumn("correct", 1 - F.col("correct")), rows.withColumn("learner", F.lit("b"))):
        with pytest.raises(Exception):
            guards.paired_predictions(rows, other, "p").collect()


def test_pairs_partitions_and_grids_must_be_whole(spark):
    units = spark.createDataFrame([("u2", "u1"), ("u1", None)], "unit_id string, duplicate_of string")
    outputs = spark.createDataFrame([("u1", 1), ("u2", 2)], "unit_id string, x int")
    assert one(guards.paired_units(units, outputs)).repeat.x == 2
    with pytest.raises(Exception, match="incomplete pair"):
        guards.paired_units(units, outputs.where("unit_id = 'u1'")).collect()
    cells = spark.createDataFrame([("c1",), ("c2",)], "cell_id string")
    splits = spark.createDataFrame([("c1", "development"), ("c2", "novel_feature_holdout")], "cell_id string, canonical_split string")
    assert guards.partition_by_split(cells, splits).count() == 2
    for bad in (splits.where("cell_id = 'c1'"), splits.withColumn("canonical_split", F.lit("other")), splits.withColumn("canonical_split", F.lit("novel_feature_holdout"))):
        with pytest.raises(ValueError):
            guards.partition_by_split(cells, bad)
    frames = spark.createDataFrame([("f",)], "frame string")
    with pytest.raises(ValueError, match="without a realisation"):
        canonical.whole_grid(cells, frames, F.col("cell_id") == "c1")


def test_items_must_have_labels_where_asked(spark):
    items = spark.createDataFrame([(1, "x", "y", [], "development"), (2, "z", "y", [], "novel_feature_holdout")], "item_id long, a string, b string, operations array<string>, canonical_split string")
    rules = [{"kc_id": "K", "rule": {"cell": {"a": "x"}}}]
    assert labels.covered_items(items, C, rules).count() == 2
    with pytest.raises(Exception, match="no label"):
        labels.covered_items(items, C, rules, every=True).collect()
    with pytest.raises(Exception, match="no label"):
        labels.covered_items(items.withColumn("a", F.lit("q")), C, rules).collect()


def test_sample_minimum(spark):
    df = spark.createDataFrame([(i, "x") for i in range(5)], "k long, g string")
    assert curation.stratified_sample(df, [{"where": {"g": "x"}, "quota": 4, "minimum": 3}], "k").count() == 4
    for stratum in ({"where": {"g": "y"}, "quota": 4, "minimum": 1}, {"where": {"g": "x"}, "quota": 2, "minimum": 3}):
        with pytest.raises(ValueError):
            curation.stratified_sample(df, [stratum], "k")


def test_a_report_has_one_row(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    with pytest.raises(ValueError):
        files.write_report(df, str(tmp_path / "two"))
    files.write_report(df.limit(1), str(tmp_path / "one"))


# Policies

def selection_case(spark):
    cells = spark.createDataFrame([(f"c{i}", a, b, split, 2) for i, (a, b, split) in enumerate([("x", "p", "development"), ("x", "q", "development"), ("y", "p", "development"), ("y", "q", "compositional_holdout"), ("z", "p", "novel_feature_holdout")])], "cell_id string, a string, b string, canonical_split string, n_items long")
    candidates = policies.from_template(("A_{VALUE}", 0, 1, 1, "a:{value}"), "a", ["x", "y", "z"]) + policies.from_template(("B_{VALUE}", 0, 1, 1, "b:{value}"), "b", ["p", "q"])
    return cells, cells.withColumn("operations", F.array().cast("array<string>")), policies.interactions(candidates, [("A_X_B_P", "A_X", "B_P")])


def test_discovery_refuses_holdouts_and_ignores_their_content(spark):
    cells, grid, candidates = selection_case(spark)
    dev = "canonical_split = 'development'"
    with pytest.raises(ValueError):
        policies.discover(cells, grid.where(dev), C, candidates, ["a", "b"])
    with pytest.raises(ValueError):
        policies.discover(cells.where(dev), grid, C, candidates, ["a", "b"])
    chosen = []
    for changed in (cells, cells.withColumn("a", F.when(F.col("canonical_split") != "development", "w").otherwise(F.col("a")))):
        rows = changed.where(dev)
        parts = policies.discover(rows, rows.withColumn("operations", F.array().cast("array<string>")), C, candidates, ["a", "b"])
        trace = policies.select_policy(parts)
        chosen.append(sorted((r.candidate, r.status) for r in trace.collect()))
        state = {r.candidate: (r.status, r.reason) for r in policies.statuses(trace, parts["found"], parts["coverage"]).collect()}
        assert state["A_Z"][0] == "ineligible" and "too few cells" in state["A_Z"][1]
        kept = {c for c, (s, _) in state.items() if s == "selected"}
        total = one(policies.objective(trace, parts["found"], parts["table"], parts["obligations"], parts["coverage"]))
        assert total.feasible and total.n_labels == len(kept) == 4 and kept == {"A_X", "A_Y", "B_P", "B_Q"} and total.n_interactions == 0 and total.least_cells == 1
    assert chosen[0] == chosen[1]


def test_uncoverable_obligations_are_an_error(spark):
    cells, grid, candidates = selection_case(spark)
    dev = "canonical_split = 'development'"
    parts = policies.discover(cells.where(dev), grid.where(dev), C, [c for c in candidates if not c[0].startswith("B_") and not c[4]], ["a", "b"])
    with pytest.raises(ValueError, match="obligations"):
        policies.select_policy(parts)


def test_interactions_need_two_known_parents():
    known = policies.from_template(("A_{value}", 0, 1, 1, "a:{value}"), "a", ["x", "y"])
    assert policies.interactions(known, [("I", "A_x", "A_y")])[-1][3] == 3
    for parents in (("A_x",), ("A_x", "A_x"), ("A_x", "A_q")):
        with pytest.raises(ValueError):
            policies.interactions(known, [("I", *parents)])


def test_frozen_policy_is_read_back_as_written(spark, tmp_path):
    _, _, candidates = selection_case(spark)
    name, rules = policies.compile_policy(["A_X", "B_P"], candidates)
    assert policies.thawed(policies.freeze(spark, name, rules, str(tmp_path / "p"))) == rules == policies.thawed(policies.freeze(spark, name, rules))
    assert policies.compile_policy(["B_P", "A_X"], list(reversed(candidates)))[0] == name


def test_transfer_of_the_fixture_case(spark):
    cells, _, candidates = selection_case(spark)
    _, rules = policies.compile_policy(["A_X", "A_Y", "B_P", "B_Q"], candidates)
    facts = cells.select("cell_id", "canonical_split", F.explode(F.array(F.concat(F.lit("a:"), "a"), F.concat(F.lit("b:"), "b"))).alias("fact"))
    out = {r.canonical_split: r for r in policies.transfer(cells, rules, C, facts, canonical.hamming_one(cells, ["a", "b"])).collect()}
    assert (out["compositional_holdout"].fact_recall, out["compositional_holdout"].reused_cells, out["compositional_holdout"].witness_preservation) == (1.0, 1, 1.0)
    assert (out["novel_feature_holdout"].fact_recall, out["novel_feature_holdout"].contrast_preservation) == (0.5, 1.0)


# Compositional probes

def test_component_case_and_empty_holdout(spark):
    schema = "event_id long, learner string, seq long, item_id long, correct int, kc_ids array<string>, dataset_split string"
    known = spark.createDataFrame([(1, "a", 1, 1, 1, ["K"], "train"), (2, "a", 2, 1, 1, ["K"], "train")], schema)
    probes = spark.createDataFrame([(3, "a", 3, 2, 1, ["K"], None), (4, "a", 4, 2, 0, ["K", "COLD"], None)], schema).drop("dataset_split")
    out = {r.seq: r for r in tracing.frozen_probes(known, probes, tracing.initial_mastery(known, ["K", "COLD"])).collect()}
    assert out[3].empirical == 0.75 and out[3].fallback == "none" and out[4].fallback == "cold_label"
    assert {(r.seq, r.kc): r.opportunity for r in tracing.probe_opportunities(known, probes).collect()} == {(3, "K"): 3, (4, "K"): 3, (4, "COLD"): 1}
    labelled = spark.createDataFrame([(1, ["K"], "development"), (2, ["K", "COLD"], "compositional_holdout")], "item_id long, kc_ids array<string>, canonical_split string")
    rows = {r.event_id: r for r in tracing.compositional_projection(known.drop("dataset_split"), probes, labelled).collect()}
    assert rows[2].indices == {"K": 2} and rows[2].fully_supported and rows[4].cold == ["COLD"] and not rows[4].fully_supported
    assert one(tracing.compositional_result(known, probes.limit(0), lambda h, p: p)).status == tracing.NOT_APPLICABLE


def test_long_chains_equal_a_plain_fold(spark):
    rnd = random.Random(8)
    answers = [rnd.randint(0, 1) for _ in range(150)]
    known = spark.createDataFrame([(i, "a", i + 1, 1, y, ["K"], "train") for i, y in enumerate(answers)], "event_id long, learner string, seq long, item_id long, correct int, kc_ids array<string>, dataset_split string")
    start = spark.createDataFrame([("K", 0.3)], "kc string, initial double")
    got = [r.mastery for r in tracing.mastery_before(known, start).orderBy("seq").collect()]
    m, want = 0.3, []
    for y in answers:
        want.append(m)
        m = m * 0.9 / (m * 0.9 + (1 - m) * 0.2) if y else m * 0.1 / (m * 0.1 + (1 - m) * 0.8)
        m += (1 - m) * 0.04
    assert got == pytest.approx(want, abs=1e-12)


def test_logistic_is_at_the_optimum_of_its_loss(spark):
    import numpy as np

    rnd = random.Random(2)
    rows = [(i, rnd.random(), ["K"] if rnd.random() < 0.5 else [], "train") for i in range(300)]
    rows = [(i, x, k, s, int(rnd.random() < 0.2 + 0.6 * x)) for i, x, k, s in rows]
    df = spark.createDataFrame(rows, "event_id long, x double, kc_ids array<string>, dataset_split string, correct int").withColumn("overall", F.lit(0.5))
    out = {r.event_id: r.logistic for r in tracing.logistic_predictions(df, ["x"], ["K"], fallback="overall").collect()}
    assert all(out[i] == 0.5 for i, _, k, _, _ in rows if not k)
    # Newton's method on the same penalised loss: sum of log losses + |w|^2 / 2 with the intercept free
    z, y = np.array([[1.0, x, len(k), float("K" in k)] for _, x, k, _, _ in rows]), np.array([r[4] for r in rows])
    w, ridge = np.zeros(4), np.diag([0.0, 1.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
    want = 1 / (1 + np.exp(-z @ w))
    assert max(abs(out[i] - want[i]) for i, _, k, _, _ in rows if k) < 1e-4


# Reasons against candidates

def reasons_case(spark, candidates, patterns=None, stable=None, descriptors=None, least=1):
    """Cells of two dimensions, one realisation each but for c0, whose two realisations differ in one operation."""
    cells = spark.createDataFrame([(f"c{i}", a, b, "development", 2) for i, (a, b) in enumerate([("x", "p"), ("x", "q"), ("y", "p"), ("y", "q"), ("x", "r")])], "cell_id string, a string, b string, canonical_split string, n_items long")
    grid = cells.withColumn("operations", F.when(F.col("cell_id") == "c0", F.array(F.lit("both"), F.lit("once"))).otherwise(F.array(F.lit("both"))))
    grid = grid.unionByName(cells.where("cell_id = 'c0'").withColumn("operations", F.array(F.lit("both"))))
    held = spark.createDataFrame(stable, "cell_id string, fact string") if stable else None
    found = policies.discover(cells, grid, C, candidates, ["a", "b"], patterns, held, spark.createDataFrame(descriptors, "cell_id string, source_id string") if descriptors else None, least)
    return found, {r.candidate: r for r in found["found"].collect()}


A_X, B_P, B_Q = (("A_X", 0, 1, 1, [], "a:x", {"cell": {"a": "x"}}), ("B_P", 0, 1, 1, [], "b:p", {"cell": {"b": "p"}}), ("B_Q", 0, 1, 1, [], "b:q", {"cell": {"b": "q"}}))
A_X_B_P = ("A_X_B_P", 2, 2, 3, ["A_X", "B_P"], "", {"all": [{"cell": {"a": "x"}}, {"cell": {"b": "p"}}]})


def test_interactions_need_a_fact_beyond_their_parents(spark):
    wide = ("A_X_B_PQ", 2, 2, 3, ["A_X", "B_PQ"], "", {"all": [{"cell": {"a": "x"}}, {"cell": {"b": ["p", "q"]}}]})
    known = [A_X, ("B_PQ", 0, 1, 1, [], "b:pq", {"cell": {"b": ["p", "q"]}}), wide]
    own = [("c0", "chain:x>p"), ("c1", "chain:x>p")]
    for stable, patterns, eligible in (
        (own, {"A_X_B_PQ": ["chain:x>p"]}, True),
        (own, {}, False),  # no pattern declared
        (own[:1], {"A_X_B_PQ": ["chain:x>p"]}, False),  # not in every cell of the interaction
        ([*own, ("c2", "chain:x>p")], {"A_X_B_PQ": ["chain:x>p"]}, False),  # a cell with a parent alone has it
    ):
        _, found = reasons_case(spark, known, patterns, stable)
        assert found["A_X_B_PQ"].eligible == eligible and found["A_X_B_PQ"].reasons == ([] if eligible else ["no fact beyond its parents"])
    _, found = reasons_case(spark, [A_X, B_P, A_X_B_P], {"A_X_B_P": ["f"]}, [("c0", "f")])
    assert found["A_X_B_P"].reasons == ["too few interaction cells"] and found["A_X_B_P"].fragile


def test_candidates_need_source_descriptors(spark):
    sources = [("c0", "s1"), ("c1", "s1"), ("c1", "s2"), ("c2", "s3"), ("c2", "s3")]
    _, found = reasons_case(spark, [A_X, B_P, B_Q], descriptors=sources, least=2)
    assert {c: (r.descriptors, r.reasons) for c, r in found.items()} == {"A_X": (2, []), "B_P": (2, []), "B_Q": (2, [])}
    _, found = reasons_case(spark, [A_X, B_P, B_Q], descriptors=sources[:3], least=2)
    assert found["B_P"].reasons == ["too few source descriptors"] and found["B_Q"].eligible and found["A_X"].descriptors == 2


def test_scope_of_operations(spark):
    known = [A_X, ("O_BOTH", 1, 1, 1, [], "both", {"operation": "both"}), ("O_ONCE", 1, 1, 1, [], "once", {"operation": "once"}), ("O_NEVER", 1, 1, 1, [], "never", {"operation": "never"}), ("O_BARE", 1, 2, 1, [], "", {"operation": "both"})]
    _, found = reasons_case(spark, known)
    assert {c: r.scope for c, r in found.items()} == {"A_X": "cell", "O_BOTH": "cell", "O_ONCE": "realisation", "O_NEVER": "unverified", "O_BARE": "cell"}
    assert "scope is realisation" in found["O_ONCE"].reasons and "scope is unverified" in found["O_NEVER"].reasons and "stands for nothing" in found["O_BARE"].reasons


def test_identical_candidates_collapse_and_are_not_selected(spark):
    twin = ("A_X_TWIN", 1, 1, 2, [], "a:x", {"any": [{"cell": {"a": "x"}}]}, "x or so")
    first = (*A_X, "x or so")
    known = [first, twin, B_P, B_Q, ("A_Y", 0, 1, 1, [], "a:y", {"cell": {"a": "y"}}), ("B_R", 0, 1, 1, [], "b:r", {"cell": {"b": "r"}})]
    parts, found = reasons_case(spark, known)
    assert found["A_X"].eligible and found["A_X_TWIN"].reasons == ["collapsed into an identical activation class"]
    classes = {r.members: r for r in parts["classes"].collect()}
    both = classes["A_X,A_X_TWIN"]
    assert both.unidentifiable and both.representative == "A_X" and both.granularity_groups == "x or so=A_X,A_X_TWIN"
    assert not classes["B_P"].unidentifiable and classes["B_P"].granularity_groups == ""
    trace = policies.select_policy(parts)
    assert "A_X_TWIN" not in {r.candidate for r in trace.collect()}
    whole = policies.objective(trace, parts["found"], parts["table"], parts["obligations"], parts["coverage"]).first()
    part = policies.objective(trace.where("candidate <> 'A_X'"), parts["found"], parts["table"], parts["obligations"], parts["coverage"]).first()
    assert whole.feasible and not part.feasible and whole.n_obligations == part.n_obligations


def test_greedy_cover_of_many_candidates_counts_few_anew(spark, monkeypatch):
    rnd = random.Random(9)
    monkeypatch.setattr(selection, "REFRESH", 3)
    names = [f"c{i:02d}" for i in range(30)]
    cover = {n: {f"o{o}" for o in rnd.sample(range(60), 6)} for n in names}
    parents = {"c05": ["c01"], "c09": ["c02", "c03"]}
    table = spark.createDataFrame([(n, 0, 1, 1 + i % 2, parents.get(n, []), n, n in parents) for i, n in enumerate(names)], "candidate string, origin long, granularity long, complexity long, parents array<string>, represents string, interaction boolean")
    found = spark.createDataFrame([(n, len(cover[n]), 3, True) for n in names], "candidate string, cells long, items long, eligible boolean")
    pairs = spark.createDataFrame([(n, o) for n in names for o in cover[n]], "candidate string, obligation string")
    got = selection.greedy_cover(pairs, table, found).collect()
    chosen, left = [], set().union(*cover.values())
    everything = set(left)
    while left:
        best = min(((-len(set().union(*(cover[m] for m in b)) & left), len(b), sum(1 + names.index(m) % 2 for m in b), sum(len(cover[m]) for m in b), sum(m in parents for m in b), -min(min(len(cover[m]), 3) for m in b), n), b)
                   for n in names for b in [[m for m in [n, *parents.get(n, [])] if m not in chosen]] if b and set().union(*(cover[m] for m in b)) & left)
        chosen += sorted(best[1], key=lambda m: (m in parents, m))
        left -= set().union(*(cover[m] for m in best[1]))
    kept = list(chosen)
    for c in reversed(chosen):
        rest = [k for k in kept if k != c]
        if not any(c in parents.get(k, []) for k in rest) and set().union(*(cover[k] for k in rest)) == everything:
            kept = rest
    assert [r.candidate for r in sorted(got, key=lambda r: chosen.index(r.candidate))] == chosen
    assert {r.candidate for r in got if r.status == "selected"} == set(kept)


def test_matching_by_group_equals_the_scan_of_all_pairs(spark):
    import random

    from lucerna.operators import canonical

    rnd = random.Random(5)
    rows = [(i, rnd.choice(["g", "h", None]), rnd.choice("ab"), rnd.choice(["x", "y", "z", None]), rnd.choice("pq")) for i in range(300)]
    rnd.shuffle(rows)
    for extra in ([], [(7, "g", "a", "x", "p"), (7, "h", "b", "y", "q")]):  # the second time an id stands in several groups
        df = spark.createDataFrame(rows + extra, "id long, word string, d string, e string, f string")
        pairs = {(r.a, r.b) for r in canonical.contrast_pairs(df, "id", "word", ["d", "e", "f"]).collect()}
        used, want = set(), []
        for a, b in sorted(pairs):
            if not {a, b} & used:
                used |= {a, b}
                want.append((a, b))
        got = canonical.contrast_matching_by_group(df, "id", "word", ["d", "e", "f"])
        assert len(want) > 50 and sorted((r.a, r.b) for r in got.collect()) == want
    many = spark.range(3000).selectExpr("id", "'w' as word", "cast(id % 2 as string) as d", "'x' as e", "'p' as f")
    # more rounds than the form by pairs allows, and 2 million pairs
    assert canonical.contrast_matching_by_group(many, "id", "word", ["d", "e", "f"]).count() == 1500


def test_edges_are_counted_once_and_nulls_are_equal(spark):
    from lucerna.operators import guards

    left = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (3, "c")], "k long, v string")
    right = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (3, "c"), (4, "d")], "k long, v string")
    changes = guards.edge_changes(left, right)
    assert sorted(tuple(r) for r in changes.collect()) == [(1, "a", "left_only"), (1, "a", "left_only"), (3, "c", "right_only"), (4, "d", "right_only")]
    assert changes._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
