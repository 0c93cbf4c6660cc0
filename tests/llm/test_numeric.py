"""Exact top-k, prefix trie and whitening against plain versions, with odd rows."""

import math
import random

import duckdb
import numpy as np
import pytest
from brute import trie
from pyspark.sql import functions as F

from lucerna.llm import prefix_trie as tries
from lucerna.llm import topk
from lucerna.llm.oracles import ORACLES
from lucerna.llm.queries import QUERIES
from lucerna.llm.whitening import whiten

VECTORS = "vec_id long, embedding array<double>, x string, many int, dim string, rank int, component string, salt int, h1 int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "d", 2, "c", 3, 4) for i, v in rows], VECTORS)


def odd_vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(-60, 260)]
    rows += [(i, rows[50][1]) for i in range(300, 330)]  # many equal vectors: ties by id
    rows += [(400, rows[0][1]), (400, rows[0][1]), (400, rows[1][1]), (None, rows[3][1])]  # repeated ids, a null one
    rows += [(450, None), (451, [1.0, None]), (452, [float("nan")] * 20), (453, [float("inf")] * 20), (500, [1.0, 2.0]), (550, [2.0, 1.0]), (600, []), (650, [])]
    return rows


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_top(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if usable(v)]
    out = []
    for at, (i, v) in enumerate(good):
        if i is not None and math.fmod(i, 50) == 0:
            found = [(-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0, j) for b, (j, w) in enumerate(good) if b != at and len(w) == len(v)]
            out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_top_k_equals_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, tiles and dimension blocks; pairs go on one by one early
        for name, value in {"CANDIDATES": 64, "QUERIES": 3, "COLUMNS": 8, "ROWS": 2, "DIMENSIONS": 3, "SPARSE": 0.6, "SAMPLE": 30}.items():
            monkeypatch.setattr(topk, name, value)
    rows = odd_vectors()
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_top(rows)


def test_top_k_of_few_and_of_large_numbers(spark):
    none = topk.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0)
    assert none.count() == 0
    rows = [(0, [1e6, 3.0]), (1, [2e6, 1.0]), (50, [-1e6, 7.0])]
    assert sorted(map(tuple, topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect())) == plain_top(rows)
    with pytest.raises(Exception, match="exceed a long"):
        topk.top_k(vectors(spark, [(0, [1e12, 1e12]), (1, [1e12, 1e12])]), F.col("vec_id") % 50 == 0).collect()


def test_bound_keeps_ties_and_prunes():
    rng = np.random.default_rng(2)
    c = rng.integers(-40, 40, (500, 24))
    c[100:140] = c[7]
    ids, void, many = np.arange(500), np.zeros(500, bool), np.ones(500, np.int64)
    for floor in (topk._NONE, int((c @ c[7]).max())):
        a, d, s, n = topk.search_block(c[7:8], ids[7:8], np.array([floor]), c, ids, void, many, 5)
        best = sorted(zip(s.tolist(), (-d).tolist(), strict=True), reverse=True)[:5]
        assert [-x for _, x in best] == [100, 101, 102, 103, 104] and n.tolist() == [1] * len(a)


def conversation_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(-30, 80), *range(1000, 1150)]:
        for t in range(rnd.choice([1, 2, 3, 4, 6, 40])):
            if rnd.random() < 0.9:
                rows.append((c, t if t or rnd.random() < 0.9 else None, rnd.choice(["user", "x", None, "user"]), rnd.choice(["a b", "a b", "a b", "", "c\x0bd e", None, "w " * 300]) if c < 1000 or t < 2 else "same"))
    rows += [(5000 + i, 0, "u", "one hot turn") for i in range(300)]  # equal conversations over several shards
    rows += [(7, 1, "user", "repeated"), (7, 1, "user", "repeated"), (None, 1, "u", "no id"), (6007, 0, "u", "turnless after its head is taken"), (6008, 0, "u", "so too")]
    return rows


@pytest.mark.parametrize("seed, tile", [(0, 2), (1, 32)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(tries, "LEAST_TURNS", 20)
    monkeypatch.setattr(tries, "SHARD_TURNS", 150)
    monkeypatch.setattr(tries, "TILE", tile)
    monkeypatch.setattr(tries, "LIST_IDS", 7)
    rows = [r for r in conversation_rows(seed)]
    df = spark.createDataFrame([(*r, "x", 1, "h") for r in rows], "conv_id long, turn long, role string, text string, ids string, depth int, hash string")
    got = tries.prefix_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == trie(rows)


def test_trie_of_nothing_and_of_one(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert tries.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    rows = [(20, None, None, None), (20, 3, "u", "x y")]
    assert sorted(map(tuple, tries.prefix_trie(spark.createDataFrame(rows, schema)).collect()), key=repr) == trie(rows)


def plain_whitening(x):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    cov = np.cov((fit - s / n).T, bias=True).reshape(x.shape[1], -1)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ u / np.sqrt(np.maximum(e, 1e-300)), e / e.sum()


@pytest.mark.parametrize("hot", [False, True])
def test_whitening_equals_numpy(spark, hot):
    rows = [r for r in odd_vectors(1) if r[1] is None or len(r[1]) != 2 or r[1][0] is not None]
    if hot:  # a vector held by enough rows to be dealt to several keys
        rows += [(7, rows[9][1])] * 25_000
    got = whiten(vectors(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = got.where("n > 2").orderBy("vec_id", "component").collect()
    good = [(i, v) for i, v in rows if usable(v) and len(v) == 20]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good])
    n, deviation, white, explained = plain_whitening(x)
    assert len(found) == 16 * len(good) and {r.n for r in found} == {n} and len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    want = {}
    for (i, _), d, w in zip(good, deviation, white, strict=True):
        want.setdefault((i, int(d)), w)
    signs = {}
    for r in found:
        w = want[r.vec_id, r.deviation][r.component - 1]
        signs.setdefault(r.component, math.copysign(1, w * r.whitened))
        assert abs(r.whitened * signs[r.component] - w) < 1e-8 and abs(r.explained - explained[r.component - 1]) < 1e-9


def test_whitening_of_odd_populations(spark):
    assert whiten(vectors(spark, [])).count() == 0
    # one vector has no variance; two of another length have one component with some
    got = {(r.vec_id, r.component): r for r in whiten(vectors(spark, [(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [])])).collect()}
    assert sorted(got) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 2)]
    assert got[1, 1].whitened is None and got[1, 1].identity_error is None and got[1, 1].explained == 0 and got[1, 1].deviation == 0
    assert abs(abs(got[2, 1].whitened) - 1) < 1e-12 and got[2, 2].whitened is None and got[2, 1].n == 2 and got[2, 1].identity_error < 1e-9
    # weights by count pull the mean to the repeated vector
    counted = {(r.vec_id, r.component): r for r in whiten(vectors(spark, [(2, [0.0, 0.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0])]), weights="count").collect()}
    assert counted[2, 1].n == 3 and abs(abs(counted[2, 1].whitened) - 2**0.5) < 1e-12


def test_deviations_past_a_long_are_null(spark):
    rows = [(i, [float(i) * 1e11, 0.5 * i]) for i in range(-20, 20)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for (i, _), v in zip(rows, x, strict=True)}
    got = {r.vec_id: r.deviation for r in whiten(vectors(spark, rows)).where("component = 1").collect()}
    assert got == {i: v if v < 2**63 else None for i, v in want.items()} and None in got.values()


@pytest.mark.parametrize("name", ["op11_exact_topk", "op12_prefix_trie"])
def test_registered_query_equals_its_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{tables}/{t}.parquet')")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, tables)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_registered_whitening_covers_every_row(spark, tables):
    got = QUERIES["op13_whitening"](spark, tables)
    n = spark.read.parquet(f"{tables}/embeddings.parquet").count()
    assert got.count() == 16 * n and got.agg(F.max("identity_error")).first()[0] < 1e-9
