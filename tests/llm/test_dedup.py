"""Duplicate finding and decontamination against brute force, with odd rows."""

import math
import random

import numpy as np
import pytest
from brute import components, contaminated, lines, near, repeats
from pyspark.sql import functions as F

from lucerna.llm.common import local_components, shingle_sets
from lucerna.llm.components import connected_components
from lucerna.llm.decontaminate import decontamination_report
from lucerna.llm.embedding_dedup import embedding_dedup
from lucerna.llm.line_dedup import PerfectHash, line_dedup
from lucerna.llm.minhash_dedup import _near, _sketch, near_duplicates
from lucerna.llm.suffix_dedup import multikey_order, suffix_dedup

SCHEMA = "doc_id long, text string, chunk string, rep int, node int, k int, text_hash string, component_id string"


def corpus(seed=0, n=60):
    """Texts with copies, near copies, shared lines and passages, odd letters, and empty and null ones."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéÉßΣσς") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    words = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    shared = " ".join(words(30))
    line = "This Line Is Shared By Many documents, and long enough"
    texts = []
    for i in range(n):
        w = words(rnd.randint(1, 80))
        t = " ".join(w) if i % 3 else "\n".join(" ".join(w[j : j + 9]) for j in range(0, len(w), 9))
        if i % 4 == 0:
            t += "\n\t" + (line.upper() if i % 8 else line) + "  \n" + " ".join(words(5))
        if i % 5 == 0:
            t += " " + shared + " " + " ".join(words(3))
        if texts and i % 6 == 0:
            t = rnd.choice(texts)
        elif texts and i % 7 == 0:
            old = rnd.choice(texts).split(" ")
            old[len(old) // 2] = "changed"
            t = " ".join(old)
        texts.append(t)
    texts += ["", None, " \n\t", "one two", "one  TWO", line, "x" * 49, "y" * 120, "y" * 50, " ".join(words(4000)), "é" * 60, "é" * 30]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    return [(i * 3 - 20, texts[j]) for i, j in enumerate(order)]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "h", "c") for i, t in docs], SCHEMA)


def result(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("operator, plain", [(line_dedup, lines), (suffix_dedup, repeats), (near_duplicates, near)])
def test_equals_brute_force(spark, operator, plain, seed):
    docs = corpus(seed)
    assert result(operator(frame(spark, docs))) == plain(docs)


@pytest.mark.parametrize("operator", [line_dedup, suffix_dedup, near_duplicates])
def test_empty_table_and_null_ids(spark, operator):
    assert operator(frame(spark, [])).count() == 0
    assert operator(frame(spark, [(None, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, None)])).count() == 4


def test_repeated_ids_keep_their_lines(spark):
    line = "a line that is long enough to be counted here"
    docs = [(i, line) for i in (1, 2, 3, 4, 5, 5)]
    got = sorted((r.doc_id, r.n_dropped) for r in line_dedup(frame(spark, docs)).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 0), (5, 0)]


def test_multikey_order_equals_a_plain_sort():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order, new = multikey_order(words)
    rows = [tuple(r) for r in words[order].tolist()]
    assert rows == sorted(map(tuple, words.tolist())) and sorted(order.tolist()) == list(range(500))
    assert new.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(500)]
    assert [len(x) for x in multikey_order(np.zeros((0, 7), np.uint64))] == [0, 0]


def test_common_grams_in_many_surroundings(spark):
    # one 30-byte passage in every text, with other bytes close before and after it, some of them shared
    rnd = random.Random(6)
    mark = "https://www.example.org/path?q"
    side = ["".join(rnd.choice("abcdefgh ") for _ in range(k)) for k in (5, 12, 19, 24, 30) for _ in range(3)]
    docs = [(i, "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 9))) + rnd.choice(side) + mark + rnd.choice(side) + "".join(rnd.choice("uvw") for _ in range(rnd.randint(0, 9)))) for i in range(300)]
    assert result(suffix_dedup(frame(spark, docs))) == repeats(docs)


def test_lines_of_repeated_ids_count_once(spark):
    # three ids only, though five rows hold the line; and ids that meet in different chunks count once
    line = "a line that is long enough to be counted here"
    docs = [(i, f"{line}\n{k}") for k, i in enumerate((1, 1, 1, 2, 3, 3, 3))]
    assert {r.n_dropped for r in line_dedup(frame(spark, docs)).collect()} == {0}
    docs = [(i, f"{line}\n{k}") for k, i in enumerate((1, 1, 2, 3, 3, 4, 5, 5))] + [(None, line), (None, None)]
    got = sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup(frame(spark, docs)).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (4, 1), (5, 0), (5, 0)]


def test_repeated_ids_do_not_remove_from_each_other(spark):
    docs = [(1, "z" * 80), (1, "z" * 80), (2, "z" * 80)]
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup(frame(spark, docs)).collect()) == [(1, 0), (1, 0), (2, 80)]


def small_nodes(monkeypatch, small, pivots):
    monkeypatch.setattr("lucerna.llm.minhash_dedup.BLOCK", small)
    monkeypatch.setattr("lucerna.llm.minhash_dedup.SMALL", small)
    monkeypatch.setattr("lucerna.llm.minhash_dedup.PIVOTS", pivots)


def test_crowd_of_near_copies_equals_brute_force(spark, monkeypatch):
    small_nodes(monkeypatch, 64, 8)
    # nodes over SMALL that tokens don't part: copies with some to many edits, so that only part of them are links
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(90)]
    docs = []
    for i in range(400):
        w = base.copy()
        for _ in range(rnd.choice([1, 2, 2, 3, 4])):
            w[rnd.randint(0, 89)] = f"edit{rnd.randint(0, 10**6)}"
        docs.append((i, " ".join(w)))
    got, want = result(near_duplicates(frame(spark, docs))), near(docs)
    assert len({c for _, c, _ in want.values()}) > 3 and got == want


def test_a_group_is_one_crowd_not_one_a_tree(spark, monkeypatch):
    from lucerna.llm import minhash_dedup

    small_nodes(monkeypatch, 64, 8)
    seen, blocks, plans = [], minhash_dedup._crowd_blocks, []
    monkeypatch.setattr(minhash_dedup, "_crowd_blocks", lambda crowds: seen.append(crowds.count()) or plans.append(crowds._jdf.queryExecution().toString()) or blocks(crowds))
    rnd = random.Random(6)
    docs = [(i, " ".join(f"edit{i}" if k == at else f"w{k}" for k in range(200))) for i in range(600) for at in [rnd.randint(0, 199)]]
    assert result(near_duplicates(frame(spark, docs))) == near(docs)
    # ten trees, two children each: 8,000 rows and more before
    assert 600 <= seen[0] < 5000 and "Broadcast" not in plans[0]


def test_large_nodes_are_branched_once_and_in_few_tasks(spark, monkeypatch):
    from lucerna.llm import minhash_dedup

    small_nodes(monkeypatch, 8, 2)
    monkeypatch.setattr(minhash_dedup, "shuffle_partitions", lambda spark: 211)
    made, checkpoint = [], minhash_dedup.checkpoint
    monkeypatch.setattr(minhash_dedup, "checkpoint", lambda df: made.append((df._jdf.queryExecution().executedPlan().toString().count("MapInArrow"), df.columns, out := checkpoint(df))) or out)
    docs = [(i, " ".join(f"edit{i}" if k == i else f"w{k}" for k in range(100))) for i in range(100)]
    assert result(near_duplicates(frame(spark, docs))) == near(docs)
    # each level's children were made twice before, once to count and once to size them
    assert max(n for n, _, _ in made) == 1
    branched = [out.rdd.getNumPartitions() for n, columns, out in made if n and columns == ["node", "rep", "parent"]]
    assert branched and set(branched) == {1}


def test_pairs_under_a_common_beginning_are_all_linked(spark, monkeypatch):
    small_nodes(monkeypatch, 64, 8)
    # 64 shared words and then 50 of each pair's own: large nodes of sets that are alike, but no links
    n, docs = 2000, []
    shared = [f"s{i}" for i in range(64)]
    for p in range(n // 2):
        own = [f"u{k}_{p}" for k in range(50)]
        docs.append((2 * p, " ".join(shared + own)))
        own[10], own[20] = f"e10_{p}", f"e20_{p}"
        docs.append((2 * p + 1, " ".join(shared + own)))
    got = result(near_duplicates(frame(spark, docs)))
    assert [i for i in got if got[i][1] != i - i % 2] == []


def test_nodes_are_compared_whole(spark):
    from lucerna.llm.minhash_dedup import _meeting

    # nodes joined and dealt by node before, as in the operator: every pair of a node must meet under AQE
    ids = spark.range(3000).select(F.col("id").alias("rep"))
    sketch = _sketch(np.sort(np.random.default_rng(0).integers(0, 2**64, 200, dtype=np.uint64)))
    sets = ids.select("rep", F.lit(bytearray(sketch)).alias("sketch"), F.lit(200).cast("long").alias("size"))
    nodes = ids.select(F.floor(F.col("rep") / 3).cast("long").alias("node"), "rep")
    few = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select(F.col("node").alias("k"))
    rows = nodes.repartition(50).join(few, F.col("node") == F.col("k")).select("node", "rep")
    got = {(r.u, r.v) for r in _meeting(rows, sets, 75).collect()}
    assert got == {(3 * k, 3 * k + b) for k in range(1000) for b in (1, 2)}


def test_texts_of_one_id_are_one_node(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    got = {(r.doc_id, r.component_id) for r in near_duplicates(frame(spark, [(1, a), (7, a), (2, b), (7, b), (3, "c d e f g h")])).collect()}
    assert got == {(1, 1), (2, 1), (7, 1), (3, 3)}


def test_small_sets_are_not_lost_by_their_sketches():
    # the fourth shingle hides one common shingle, and the two others share a bin: 1 of 2 bins agrees at similarity 0.75
    some = np.array([5, 2**57 + 1, 2**57 + 2], np.uint64)
    sketches = np.frombuffer(_sketch(some) + _sketch(np.append(np.uint64(1), some)), np.uint16).reshape(2, -1)
    assert [x.tolist() for x in _near(sketches, np.array([3, 4]))] == [[0], [1]]


def test_branched_nodes_equal_brute_force(spark, monkeypatch):
    small_nodes(monkeypatch, 4, 1)
    docs = corpus(2)
    assert result(near_duplicates(frame(spark, docs))) == near(docs)


@pytest.mark.parametrize("items", [[(1, 30), (2, 12), (3, 10)], [(1, 40), (2, 3), (3, 0), (4, 9)], []])
def test_decontamination_equals_brute_force(spark, items):
    docs = corpus(5)
    rnd = random.Random(3)
    pool = [t.split() for _, t in docs if t and len(t.split()) > 60]
    bench = []
    for i, n in items:
        source = rnd.choice(pool)
        at = rnd.randint(0, len(source) - n - 1)
        bench.append((i, " ".join(source[at : at + n]).upper() if i == 2 else " ".join(source[at : at + n])))
    table = spark.createDataFrame([(i, t, "x") for i, t in [*bench, (99, None), (None, "a b c")]], "item_id long, text string, words string")
    assert result(decontamination_report(frame(spark, docs), table)) == contaminated(docs, bench)


def test_decontamination_repeated_rows_come_out_once(spark):
    bench = spark.createDataFrame([(1, "p q r")], "item_id long, text string")
    docs = frame(spark, [(1, "p q r s"), (1, "p q r s"), (1, "none"), (None, "p q r")])
    got = sorted((str(r.doc_id), r.n_hit) for r in decontamination_report(docs, bench).collect())
    assert got == [("1", 0), ("1", 3), ("None", 3)]


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    for i in range(0, 290, 3):
        x[i + 1] = x[i] + rng.normal(scale=rng.choice([0.0, 0.2, 0.35, 0.5]), size=16)
    x[5] *= 1e-20
    x[7] *= 1e15
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    rows += [(1000, None, "x"), (1001, [0.0] * 16, "x"), (1002, [float("nan")] * 16, "x"), (1003, [float("inf")] + [1.0] * 15, "x"), (1004, [None] + [1.0] * 15, "x"), (1005, [1.0] * 3, "x"), (1006, [2.0] * 3, "x"), (1007, [], "x"), (None, [1.0] * 16, "x")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string")).collect()}
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near_ = unit @ unit.T >= 0.9
    np.fill_diagonal(near_, False)
    c = components(range(300), zip(*map(list, np.nonzero(near_)), strict=True))
    want = {i: (int(near_[i].sum()), c[i], c[i] == i) for i in range(300)}
    want |= {i: (0, i, True) for i in (1000, 1001, 1002, 1003, 1004, 1007)} | {1005: (1, 1005, True), 1006: (1, 1005, False), None: (0, None, True)}
    assert got == want


def test_double_vectors_are_compared_in_double(spark):
    # numbers that single precision can't hold, and angles that it can't tell from the threshold
    at = lambda c: [c, math.sqrt(1 - c * c)]
    rows = [(1, [1.0, 0.0]), (2, at(0.9 + 1e-9)), (3, [1.0, 0.0, 0.0]), (4, [*at(0.9 - 1e-9), 0.0]), (5, [1e-60] * 4), (6, [1e60] * 4)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (1, 5), 6: (1, 5)}


def test_embeddings_empty_table(spark):
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    h = PerfectHash(keys)
    assert h.size == n and sorted(h.index(keys).tolist()) == list(range(n))


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(0)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)] + [(5, 5)]
    nodes = {x for p in links if p[0] != p[1] for x in p}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*links, (None, 1)], "a long, b long")).collect()}
    assert got == {n: c for n, c in components(nodes | {5}, links).items() if n in nodes}
    u, v = local_components(*np.array([p for p in links if p[0] != p[1]]).T)
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == got


@pytest.mark.parametrize("few", [None, 0])
def test_few_links_are_joined_up_in_one_round(spark, monkeypatch, few):
    from lucerna.llm import components as module

    rounds, checkpoint = [], module.checkpoint
    monkeypatch.setattr(module, "checkpoint", lambda df: rounds.append(1) or checkpoint(df))
    if few is not None:
        monkeypatch.setattr(module, "FEW", few)
    rnd = random.Random(1)
    links = [(i + 1, i) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(150)]
    nodes = {x for p in links if p[0] != p[1] for x in p}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in components({x for p in links for x in p}, links).items() if n in nodes}
    assert (len(rounds) == 1) == (few is None)


def test_shingle_sets_do_not_cross_rows():
    text = ["A b c d e f", "", "a  b", "c d e f g h"]
    raw = [t.encode() for t in text]
    h, at = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 5)
    assert np.diff(at).tolist() == [2, 0, 1, 2] and len(set(h.tolist())) == 5


def test_rows_of_one_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [None, 1.0]), (3, [0.0, 1.0]), (5, [0.0, 1.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (7, [-1.0, 0.0]), (7, [0.0, -1.0])]
    got = sorted(map(tuple, embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == [(1, 3, 1, True), (2, 0, 2, True), (2, 3, 1, False), (3, 1, 3, True), (5, 1, 3, False), (5, 3, 1, False), (5, 3, 1, False), (7, 0, 7, True), (7, 0, 7, True)]


def test_suffix_splitters_with_more_buckets_than_leads(spark):
    from lucerna.llm import suffix_dedup as s

    docs = spark.createDataFrame([(i, f"{i} " + " ".join(f"{i * 7919 + k * 104729} word" for k in range(40)), "h") for i in range(30)], "doc_id long, text string, text_hash string")
    few, many = s._splitters(docs, 40), s._splitters(docs, 5000)
    assert 30 <= len(few) <= 39 and 60 < len(many) <= 90 and list(many) == sorted(many)
    # a beginning that very many anchors share still gives splitters, by the bytes that follow it
    hot = spark.createDataFrame([(i, "the very same twenty four" + f" {i:05d} " * 12, "h") for i in range(60)], "doc_id long, text string, text_hash string")
    assert len(s._splitters(hot, 40)) > 20


def test_suffix_dedup_with_more_buckets_than_leads(spark, monkeypatch):
    from lucerna.llm import suffix_dedup as s

    monkeypatch.setattr(s, "CHUNK_CHARS", 40)
    docs = corpus(3, 20)
    assert result(suffix_dedup(frame(spark, docs))) == repeats(docs)


def test_runs_of_a_hot_anchor_spread_over_buckets(spark, monkeypatch):
    from lucerna.llm import suffix_dedup as s

    gram = "a gram of 24 characters!"
    rnd = random.Random(4)
    docs = [(i, " ".join(str(rnd.random()) for _ in range(3)) + gram + " ".join(str(rnd.random()) for _ in range(3))) for i in range(300)]
    docs += [(300 + i, docs[i][1]) for i in range(20)]
    df = spark.createDataFrame([(i, t, F_hash) for (i, t), F_hash in zip(docs, range(320), strict=True)], "doc_id long, text string, text_hash long")
    hot = s._hot_anchors(df)
    assert len(hot) >= 1
    import pyarrow as pa

    chunk = s._Chunk(pa.table({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs], "text_hash": [i for i, _ in docs]}))
    for anchors, spread in ((hot, True), (hot[:0], False)):
        _, _, (bucket, anchor, _, _) = chunk.distinct_runs(64, anchors)
        common = np.bincount(bucket[np.isin(anchor, hot)], minlength=64)
        assert (common.max() <= 4 * max(1, common.sum() // 64) + 8) == spread
    for kinds in (2, 8):
        monkeypatch.setattr(s, "HOT_KINDS", kinds)
        assert result(suffix_dedup(frame(spark, docs))) == repeats(docs)
    monkeypatch.setattr(s, "HOT_KINDS", 1)  # every anchor counts as hot
    assert result(suffix_dedup(frame(spark, corpus(5, 30)))) == repeats(corpus(5, 30))
