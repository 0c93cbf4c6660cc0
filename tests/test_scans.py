"""What spreads long keys over tasks, against plain Python: scans in blocks, ranges, draws, digests, and the rule index."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucerna.functions import rules as rule_forms
from lucerna.functions import scans
from lucerna.functions.rules import Compiler
from lucerna.operators import canonical, evaluation, history, labels, rule_index, tracing
from lucerna.operators.tracing import Bkt


def events(spark, seed=0, n=400):
    """One learner of most events and a few of some, with gaps in seq, events without labels and one without an answer."""
    rnd = random.Random(seed)
    rows = []
    for learner, size in ((1, n), (2, 9), (3, 1), (4, 40)):
        seq = 0
        for _ in range(size):
            seq += rnd.choice([1, 1, 1, 2])
            rows.append((learner, seq, None if rnd.random() < 0.01 else int(rnd.random() < 0.7), rnd.sample(["A", "B", "C"], rnd.randint(0, 2)), f"x{seq}"))
    return rows, spark.createDataFrame(rows, "learner long, seq long, correct int, kc_ids array<string>, extra string")


def plain_history(rows):
    out = {}
    for learner, own in itertools.groupby(sorted(rows, key=lambda r: r[:2]), key=lambda r: r[0]):
        k, n, s, all_n, all_s = {}, {}, {}, 0, 0
        for _, seq, correct, kcs, _ in own:
            overall = (all_s + 1) / (all_n + 2)
            rates = [(s.get(x, 0) + 1) / (n.get(x, 0) + 2) for x in kcs]
            seen = [np.log1p(n.get(x, 0)) for x in kcs]
            out[learner, seq] = (overall, sum(rates) / len(rates) if rates else overall, sum(seen) / len(seen) if seen else 0.0, {x: k.get(x, 0) + 1 for x in kcs})
            for x in kcs:
                k[x] = k.get(x, 0) + 1
                n[x] = n.get(x, 0) + (correct is not None)
                s[x] = s.get(x, 0) + (correct or 0)
            all_n, all_s = all_n + (correct is not None), all_s + (correct or 0)
    return out


@pytest.mark.parametrize("block", [7, 64, 32_768])
def test_history_in_blocks_equals_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(scans, "BLOCK", block)
    rows, df = events(spark)
    want = plain_history(rows)
    got = history.prior_rates(df)
    assert got.columns == [*df.columns, "overall_rate", "active_rate", "mean_log_opportunity"]
    found = {(r.learner, r.seq): r for r in got.collect()}
    assert len(found) == len(rows)
    for key, (overall, active, mean_log, _) in want.items():
        r = found[key]
        assert abs(r.overall_rate - overall) < 1e-12 and abs(r.active_rate - active) < 1e-12 and abs(r.mean_log_opportunity - mean_log) < 1e-12
    numbers = {(r.learner, r.seq, r.kc): r.opportunity for r in history.opportunity_index(df).collect()}
    assert numbers == {(*key, x): i for key, w in want.items() for x, i in w[3].items()}


def test_gaps_over_blocks_equal_plain_python(spark, monkeypatch):
    rnd = random.Random(6)
    rows, want = [], {}
    for learner, size in ((1, 200), (2, 3), (3, 1)):
        seq, time, own = 0, 100, [0, 0, 0]
        for i in range(size):
            step, later = rnd.choice([1, 1, 2, 5]), rnd.choice([0, 1, 1, -1])
            own = [own[0] + 1, own[1] + (step != 1), own[2] + (i > 0 and later <= 0)]
            seq, time = seq + step, time + later
            rows.append((learner, seq, time))
        want[learner] = tuple(own)
    df = spark.createDataFrame(rows, "learner long, seq long, ts long")
    for block in (4, 32_768):
        monkeypatch.setattr(scans, "BLOCK", block)
        assert {r.learner: tuple(r)[1:] for r in history.sequence_gaps(df).collect()} == want


@pytest.mark.parametrize("block, run", [(5, 64), (50, 3), (32_768, 64)])
def test_mastery_in_blocks_equals_a_fold(spark, monkeypatch, block, run):
    monkeypatch.setattr(scans, "BLOCK", block)
    monkeypatch.setattr(scans, "RUN", run)
    rows, df = events(spark, 1, 300)
    rows = [(a, b, c or 0, d, e) for a, b, c, d, e in rows]
    df = df.fillna({"correct": 0})
    model, first = Bkt(), {"A": 0.3, "B": 0.5, "C": 0.95}
    start = spark.createDataFrame(list(first.items()), "kc string, initial double")
    want, last = {}, {}
    for learner, seq, correct, kcs, _ in sorted(rows, key=lambda r: r[:2]):
        for x in kcs:
            want[learner, seq, x] = last.get((learner, x), first[x])
            last[learner, x] = model.after(want[learner, seq, x], correct)
    got = {(r.learner, r.seq, r.kc): r.mastery for r in tracing.mastery_before(df, start, model).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    ends = {(r.learner, r.kc): r.mastery for r in tracing.final_mastery(df, start, model).collect()}
    assert ends.keys() == last.keys() and max(abs(ends[k] - last[k]) for k in last) < 1e-9


def test_long_runs_of_answers_stay_in_range(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", 1000)
    answers = [1] * 3000 + [0] * 3000
    df = spark.createDataFrame([(1, i + 1, c, ["A"]) for i, c in enumerate(answers)], "learner long, seq long, correct int, kc_ids array<string>")
    start = spark.createDataFrame([("A", 0.5)], "kc string, initial double")
    got = [r.mastery for r in tracing.mastery_before(df, start).orderBy("seq").collect()]
    assert got[2999] == 1.0 and all(0 <= m <= 1 for m in got) and abs(got[-1] - 0.04 / (1 - 0.1 / 0.8)) < 0.01
    for model in (Bkt(guess=0.0), Bkt(slip=0.0), Bkt(learn=1.0), Bkt(learn=0.0)):
        odd = [r.mastery for r in tracing.mastery_before(df.where("seq <= 2900 or seq > 3100"), start, model).collect()]
        assert all(0 <= m <= 1 for m in odd)


def test_auc_over_ranges_equals_all_pairs(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.choice([0.1, 0.2, 0.3, 0.3 + 1e-12, rnd.random()]), rnd.randint(0, 1)) for k in ("a", "b", None) for _ in range(120)] + [("one class", 0.5, 1)]
    got = {r.k: r.auc for r in evaluation.auc(spark.createDataFrame(rows, "k string, prediction double, correct int"), ["k"]).collect()}
    for k in ("a", "b", None):
        pos, neg = ([p for key, p, c in rows if key == k and c == v] for v in (1, 0))
        assert abs(got[k] - sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)) < 1e-12
    assert got["one class"] is None


def test_draws_are_one_multinomial_however_cut(monkeypatch):
    monkeypatch.setattr(evaluation, "LEAF", 8)
    whole = evaluation.draws(100, 0, 100, 400, 5)
    assert (whole.sum(axis=1) == 100).all()
    assert np.array_equal(whole, np.concatenate([evaluation.draws(100, a, b, 400, 5) for a, b in ((0, 13), (13, 14), (14, 77), (77, 100))], axis=1))
    assert abs(whole.mean(axis=0) - 1).max() < 0.25 and abs(whole.var() - 0.99) < 0.05
    pairs = np.corrcoef(whole[:, ::7].T)  # counts of a multinomial of 100 are nearly independent
    assert abs(pairs[~np.eye(len(pairs), dtype=bool)]).max() < 0.25


def test_bootstrap_by_range_ignores_partitions_and_agrees(spark):
    rnd = random.Random(1)
    rows = [(f"l{i}", rnd.randint(0, 1), 0.3 + 0.4 * rnd.random(), 0.5) for i in range(80) for _ in range(3)]
    df = spark.createDataFrame(rows, "learner string, correct int, a double, b double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("3", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(evaluation.bootstrap_by_range(df, 300).first())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    one, two = found
    other = evaluation.paired_bootstrap(df, 300).first()
    assert (one.n_learners, one.n_events, one.direction) == (80, 240, two.direction) and abs(one.low - two.low) < 1e-12 and abs(one.high - two.high) < 1e-12
    assert abs(one.difference - other.difference) < 1e-12 and abs(one.low - other.low) < 0.02 and abs(one.high - other.high) < 0.02
    assert evaluation.bootstrap_by_range(df.limit(0), 10).count() == 1


def test_digest_depends_on_order_alone(spark):
    rows = [(i, f"v{i % 5}") for i in range(60)]
    digest = lambda r, parts=3: tuple(canonical.ordered_digest(spark.createDataFrame(r, "k int, v string").repartition(parts), ["k"], ["v"]).first())
    whole = digest(rows)
    assert whole == digest(list(reversed(rows)), 7) and whole[0] == 60
    assert whole != digest([(1 - k if k < 2 else k, v) for k, v in rows])  # two events change places
    a, b, c = digest(rows[:11]), digest(rows[11:40]), digest(rows[40:])
    assert canonical.combined(canonical.combined(a, b), c) == canonical.combined(a, canonical.combined(b, c)) == whole
    assert digest([]) == (0, 0, 0) and canonical.combined((0, 0, 0), a) == a


# Rules

C = Compiler({"a": "a", "b": "b"})


def random_rule(rnd, depth=0):
    kind = rnd.choice(["cell", "operation", "field"] if depth > 2 else ["all", "any", "cell", "operation", "field"])
    if kind in ("all", "any"):
        return {kind: [random_rule(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]}
    if kind == "operation":
        return {"operation": f"o{rnd.randint(0, 6)}"}
    value = lambda: rnd.choice(["v0", "v1", ["v1", "v2"], []])
    return {"cell": {d: value() for d in rnd.sample(["a", "b"], rnd.randint(0, 2))}} if kind == "cell" else {"agreement_site": value()}


def items(spark, rnd, n=150):
    one = lambda: rnd.choice(["v0", "v1", "v2", "v3", None])
    rows = [(i, one(), one(), one(), rnd.choice([None, [f"o{k}" for k in rnd.sample(range(8), 3)] + [None, "o1"]]), None) for i in range(n)]
    return spark.createDataFrame(rows, "id int, a string, b string, agreement_site string, operations array<string>, frame_type string")


def test_indexed_rules_equal_compiled_ones(spark):
    rnd = random.Random(7)
    rules = [{"kc_id": f"K{i:03d}", "rule": random_rule(rnd)} for i in range(60)] + [{"kc_id": "K_ALL", "rule": {"all": []}}, {"kc_id": "K_NONE", "rule": {"any": []}}]
    rows = items(spark, rnd)
    got = rule_index.label_by_index(rows, "id", rule_index.rule_table(spark, rules, C), C)
    assert got.columns == [*rows.columns, "kc_ids"]
    want = {r.id: r.kc_ids for r in labels.label_items(rows, C, rules).collect()}
    assert {r.id: r.kc_ids for r in got.collect()} == want and any(want.values())


def test_rows_to_label_are_not_sent_through_the_driver(spark, tmp_path):
    # a small file of many rows looks small enough to broadcast
    rows = items(spark, random.Random(9))
    rows.write.parquet(str(tmp_path / "rows"))
    rules = [{"kc_id": "K", "rule": random_rule(random.Random(7))}]
    got = rule_index.label_by_index(spark.read.parquet(str(tmp_path / "rows")), "id", rule_index.rule_table(spark, rules, C), C)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2 and "strategy=merge" in plan  # the filed rules and the one row of those that hold everywhere


def test_ten_thousand_rules_have_the_plan_of_ten(spark):
    rnd = random.Random(8)
    rows = items(spark, rnd, 40)
    rule = lambda i: {"all": [{"cell": {"a": f"v{i % 4}"}}, {"any": [{"operation": f"o{i % 8}"}, {"operation": f"p{i}"}]}, {"cell": {"b": [f"v{i % 3}", f"w{i}"]}}]}
    plans, counts = [], []
    for n in (10, 10_000):
        out = rule_index.label_by_index(rows, "id", rule_index.rule_table(spark, [{"kc_id": f"K{i}", "rule": rule(i)} for i in range(n)], C), C)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        counts.append({r.id: len(r.kc_ids) for r in out.collect()})
    assert plans[0] == plans[1]
    held = lambda r, i: r.a == f"v{i % 4}" and f"o{i % 8}" in (r.operations or []) and r.b == f"v{i % 3}"
    assert counts[1] == {r.id: sum(held(r, i) for i in range(10_000)) for r in rows.collect()}


def test_nested_alternatives_are_bounded():
    wide = {"all": [{"any": [{"all": [{"operation": f"x{i}{j}"}, {"operation": "y"}]} for j in range(30)]} for i in range(3)]}
    with pytest.raises(ValueError, match="alternatives"):
        rule_forms.conjuncts(wide)


def test_label_vectors_are_sparse(spark):
    kcs = [f"k{i}" for i in range(100_000)]
    df = spark.createDataFrame([(1, ["k7", "k99999"]), (2, []), (3, None), (4, ["unknown", "k0"])], "i int, kc_ids array<string>")
    got = {r.i: r.label_vector for r in labels.with_label_vector(df, kcs).collect()}
    assert got[1].size == 100_000 and list(got[1].indices) == [7, 99_999] and list(got[1].values) == [1.0, 1.0]
    assert got[2].numNonzeros() == got[3].numNonzeros() == 0 and list(got[4].indices) == [0]
    with pytest.raises(ValueError):
        labels.with_label_vector(df, ["a", "a"])


def test_fit_with_very_many_labels(spark):
    rnd = random.Random(2)
    kcs = [f"k{i}" for i in range(100_000)]
    rows = [(i, "train", int(rnd.random() < (0.9 if i % 2 else 0.1)), [kcs[i % 2], kcs[50_000 + i]], 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, dataset_split string, correct int, kc_ids array<string>, overall_rate double").withColumn("x", F.lit(0.0))
    p = {r.i: r.logistic for r in tracing.logistic_predictions(df, ["x"], kcs, strength=10.0).collect()}
    assert np.mean([p[i] for i in range(1, 200, 2)]) > 0.7 > 0.3 > np.mean([p[i] for i in range(0, 200, 2)])


def test_empty_tables_have_empty_results(spark, tmp_path):
    schema = "learner long, seq long, correct int, kc_ids array<string>"
    spark.createDataFrame([(1, 1, 1, ["A"])], schema).write.parquet(str(tmp_path / "x"))
    start = spark.createDataFrame([("A", 0.5)], "kc string, initial double")
    full = spark.read.parquet(str(tmp_path / "x"))
    for df in (spark.createDataFrame([], schema), full.where("seq > 1"), full.join(full.where("seq > 1").select("learner"), "learner")):
        assert history.prior_rates(df).count() == history.opportunity_index(df).count() == tracing.mastery_before(df, start).count() == tracing.final_mastery(df, start).count() == 0
        assert history.sequence_gaps(df, time="correct").count() == 0
    assert evaluation.auc(spark.createDataFrame([], "k string, prediction double, correct int"), ["k"]).count() == 0
    table = rule_index.rule_table(spark, [{"kc_id": "K", "rule": {"operation": "o1"}}], C)
    rows = items(spark, random.Random(1), 5)
    assert rule_index.label_by_index(rows.limit(0), "id", table, C).count() == 0
    assert {tuple(r.kc_ids) for r in rule_index.label_by_index(rows, "id", table.limit(0), C).collect()} == {()}


def test_blocked_rows_are_dealt_once(spark):
    from lucerna.operators import history

    rows = spark.range(400).selectExpr("id % 7 as learner", "id as seq", "cast(id % 2 as int) as correct", "array('A', 'B') as kc_ids")
    plan = history.prior_rates(rows)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text[: text.index("Initial Plan")]
    # after the checkpoint: one exchange for the windows of the learner, of the labels and for the grouping, and of all partitions
    assert final.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in final


def test_blocked_rows_are_dealt_by_their_number(spark, monkeypatch):
    from lucerna.operators import history
    from lucerna.sources import cuts

    rows = spark.range(4000).selectExpr("id % 700 as learner", "id as seq", "cast(id % 3 = 0 as int) as correct", "array('A', 'B') as kc_ids")
    want = sorted(map(tuple, history.prior_rates(rows).drop("kc_ids").collect()))
    monkeypatch.setattr(cuts, "TASK_ROWS", 100)
    dealt, _ = scans.blocked(rows, ["learner"])
    # more tasks than shuffle partitions, so that a task's rows stay as they are when the table grows
    assert dealt.rdd.getNumPartitions() == 40 and max(dealt.rdd.glom().map(len).collect()) < 300
    assert sorted(map(tuple, history.prior_rates(rows).drop("kc_ids").collect())) == want
    assert scans.blocked(rows.limit(0), ["learner"])[0].rdd.getNumPartitions() == 4


def test_draws_are_not_counted_before_they_meet_learners(spark, monkeypatch):
    from lucerna.sources import cuts

    pairs = spark.range(200).selectExpr("id % 20 as learner", "cast(id % 3 = 0 as int) as correct", "(id % 7 + 1) / 9 as a", "(id % 5 + 1) / 8 as b")
    want = evaluation.paired_bootstrap(pairs, 40).first()
    monkeypatch.setattr(cuts, "TASK_ROWS", 10)
    plan = evaluation.paired_bootstrap(pairs, 40)
    got = plan.first()
    assert got[:2] == want[:2] and got.direction == want.direction and np.allclose(got[2:5], want[2:5])
    text = plan._jdf.queryExecution().executedPlan().toString()
    # a table of (repetition, learner) counts would grow with their product; 800 draws of 16 to a row are five tasks
    assert "keys=[rep#" in text and not re.search(r"keys=\[rep#\d+L?, position", text) and re.search(r"hashpartitioning\(position#\d+L?, 5\), REPARTITION_BY_NUM", text)


def test_events_are_dealt_by_their_number(spark, tables, monkeypatch):
    from lucerna.operators import history
    from lucerna.plans import catalog_history as plans
    from lucerna.sources import adapters, cuts

    n = adapters.table(spark, tables, "events").count()
    row = lambda d: sorted(map(str, d.select("learner", "seq", "item_id", "correct", "kc_ids", "dataset_split").collect()))
    want = row(history.chronological_split(plans.small(spark, tables)))
    monkeypatch.setattr(cuts, "TASK_ROWS", max(1, n // 20))
    # windows over a learner and the join of items take as many tasks as the events ask for, whatever their bytes
    events, split = adapters.interactions(spark, tables), plans.small_split(spark, tables)
    assert events.rdd.getNumPartitions() == split.rdd.getNumPartitions() == -(-n // (n // 20))
    assert row(split) == want
    plan = split._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+?)#\d+L?, \d+\), (\w+)", plan)
    # the split is found where the events are numbered: they are dealt by learner once
    assert {e[0] for e in exchanges if e[1] == "REPARTITION_BY_NUM"} == {"item_id", "user_id"} and not any(e[0] == "learner" for e in exchanges)
