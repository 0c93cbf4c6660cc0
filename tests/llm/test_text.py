"""Pseudonyms, quotations, lattices, classifiers and the pipeline."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from brute import contaminated, lines, near
from pyspark.sql import functions as F

from lucerna.llm.pii import ROUNDS, pii_report, pseudonyms
from lucerna.llm.common import word_hashes
from lucerna.llm.quality import BUCKETS, DIM, ENTRIES, TOKENS, WINDOW, Network, _index_vectors, quality_scores, word_vectors
from lucerna.llm.quotation import conversations_by_reply, quotation_links
from lucerna.llm.sentencepiece_lattice import MARK, Lattice, decode_ids, encode_texts
from lucerna.llm.toxicity import fit_cumulative_link, fit_severity, link_loss, score_rows, toxicity_scores


# Pseudonyms

def prf(key, kind, step, value):
    return int(hashlib.sha256(f"{key}|{kind}|{step}|{value}".encode()).hexdigest()[:15], 16)


def feistel(key, kind, left, right, a, b):
    for i in range(1, ROUNDS + 1):
        if i % 2:
            left = (left + prf(key, kind, i, right)) % a
        else:
            right = (right + prf(key, kind, i, left)) % b
    return left, right


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def digits(key, kind, d):
    u = len(d) // 2
    a, b = feistel(key, kind, int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u))
    return f"{a:0{u}d}{b:0{len(d) - u}d}"


def text_of(spark, text, key="key"):
    return pseudonyms(spark.createDataFrame([(1, text)], "doc_id long, text string"), key).first()["text"]


def test_pseudonyms_equal_plain_feistel(spark):
    import datetime as dt

    card, body = "4111111111111111", digits("key", "card", "411111111111111")
    new = next(body + c for c in "0123456789" if luhn(body + c))
    assert text_of(spark, f"a {card}, b") == f"a {new}, b"
    assert text_of(spark, "4111-1111 1111-1111") == f"{new[:4]}-{new[4:8]} {new[8:12]}-{new[12:]}"
    n = (dt.date(2024, 2, 29) - dt.date(1900, 1, 1)).days
    a, b = feistel("key", "date", n % 17, n // 17, 17, 4297)
    day = dt.date(1900, 1, 1) + dt.timedelta(days=17 * b + a)
    assert text_of(spark, "on 2024-02-29.") == f"on {day}."
    assert text_of(spark, "on 29/02/2024") == f"on {day:%d/%m/%Y}"
    a, b = feistel("key", "ip", 10 * 256 + 1, 2 * 256 + 255, 65536, 65536)
    assert text_of(spark, "ip 10.1.2.255") == f"ip {a // 256}.{a % 256}.{b // 256}.{b % 256}"
    p = digits("key", "phone", "0175557713")
    assert text_of(spark, "+1 (017) 555-7713") == f"+1 ({p[:3]}) {p[3:6]}-{p[6:]}"
    a, b = feistel("key", "ssn", 123 - 1, 44 * 9999 + 6788, 898, 99 * 9999)
    area = a + 1 if a < 665 else a + 2
    assert text_of(spark, "123-45-6789") == f"{area:03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def test_short_whole_quotes_link_to_other_conversations(spark):
    long = "On 3 May " + "a very long name " * 40 + "wrote:"
    rows = [(1, 0, "u", "Yes please"), (2, 0, "u", f"Hm.\n{long}\n> Yes please\nAs they said."), (3, 0, "u", "> Yes please\n> and a second line that nobody wrote\nno")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.to_conv, r.to_turn) for r in quotation_links(df).collect()} == {(2, 1, 0), (3, None, None)}
    assert {r.conv_id: r.text for r in conversations_by_reply(df).collect()}[2] == "Hm.\nAs they said."


def test_any_mail_name_is_found(spark):
    names = ["_bob", "x" * 90, "-a.b+c", "9" * 70 + "z", "o'neil"]
    out = [pii_report(spark.createDataFrame([(i, f"to {n}@mail.example.org now")], "doc_id long, text string"), "k").first() for i, n in enumerate(names)]
    assert [r.n_email for r in out] == [1] * 5
    assert all(n not in r.text for n, r in zip(names[:4], out, strict=False)) and all(r.text.endswith("@mail.example.org now") for r in out)
    long = "a" * 300_000 + " and " + "b.c" * 100_000
    assert pii_report(spark.createDataFrame([(1, long)], "doc_id long, text string"), "k").first().text == long


def test_invalid_values_stay_and_odd_rows_have_results(spark):
    rows = [(1, "4111111111111112 30/02/2000 999.1.1.1 000-12-3456 2024-13-01"), (2, None), (3, ""), (None, "call 123 now"), (2, "x"), (4, "9" * 5000 + " a@b.co")]
    out = pii_report(spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1)), "k").collect()
    assert len(out) == 6
    by = {(r.doc_id, r.n_invalid): r for r in out}
    assert by[(1, 5)].text == rows[0][1]
    assert by[(2, 0)] is not None and any(r.text is None and r.n_card == 0 for r in out) and any(r.text == "" for r in out)
    assert next(r for r in out if r.doc_id == 4).n_email == 1


def test_equal_values_link_and_different_ones_differ(spark):
    rnd = random.Random(0)
    ips = list({f"{rnd.randint(0, 255)}.{rnd.randint(0, 255)}.0.{k}" for k in range(200)})
    df = spark.createDataFrame([(i, f"{v} and {v}") for i, v in enumerate(ips)], "doc_id long, text string")
    new = [r.text.split(" and ") for r in pseudonyms(df, "k").collect()]
    assert all(a == b for a, b in new) and len({a for a, _ in new}) == len(ips)
    mails = [f"{''.join(p)}{d}@x.org" for p in itertools.product("ab", repeat=3) for d in (1, 2)]
    out = [r.text for r in pseudonyms(spark.createDataFrame([(i, m) for i, m in enumerate(mails)], "doc_id long, text string"), "k").collect()]
    assert len(set(out)) == len(mails) and all(re.fullmatch(r"[a-z]{3}[0-9]@x\.org", m) for m in out)


# Quotations

def test_quoted_passages_link_to_originals(spark):
    rows = [
        (1, 0, "user", "Hello there my friend.\nHow is the weather today?"), (1, 1, "assistant", "> Hello there my  friend.\n> How is the weather TODAY?\nIt is quite sunny."),
        (1, 2, "user", "On Monday, Ann wrote:\n> It is quite sunny.\n>> How is the weather today?\n\nThanks a lot for that."), (1, 3, "user", "A fresh question here."),
        (2, 0, "user", "> A fresh question here.\nme too"), (None, 1, "user", "x"), (2, 1, "user", None), (2, 1, "user", None), (3, 0, "user", "> nobody ever said these words\nso"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hash", F.lit("x")).withColumn("lines", F.lit(1))
    links = {(r.conv_id, r.turn, r.level): (r.to_conv, r.to_turn) for r in quotation_links(df).collect()}
    assert links == {(1, 1, 1): (1, 0), (1, 2, 1): (1, 1), (1, 2, 2): (1, 0), (2, 0, 1): (1, 3), (3, 0, 1): (None, None)}
    out = [(r.conv_id, r.thread_turn, r.depth, r.turn, r.reply_to, r.text) for r in conversations_by_reply(df).collect()]
    assert out[1:5] == [(1, 0, 0, 0, None, rows[0][3]), (1, 0, 1, 1, 0, "It is quite sunny."), (1, 0, 2, 2, 1, "Thanks a lot for that."), (1, 3, 0, 3, None, "A fresh question here.")]
    assert len(out) == len(rows) and out[0][0] is None and sum(t == "" for *_, t in out) == 2
    assert conversations_by_reply(df.where("conv_id > 99")).count() == 0


def test_long_reply_chain_has_its_depths(spark):
    rows = [(7, 0, "u", "message number 0 of the chain")] + [(7, i, "u", f"> message number {i - 1} of the chain\nmessage number {i} of the chain") for i in range(1, 20)]
    out = conversations_by_reply(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.thread_turn, r.depth, r.turn) for r in out] == [(0, i, i) for i in range(20)]


def test_parts_of_a_message_link(spark):
    first = "The first paragraph says this.\n\nThe second one says that.\nAnd it goes on.\nAnd on.\n\nThe third one ends it.\n-- \nAnn"
    quotes = [
        "> The first paragraph says this.\n>\n> The second one says that.\n> And it goes on.\n> And on.", "> And it goes on.\n> And on.",
        "".join(f"> {x}\n" for x in first.split("\n")[:-2]), "> The third one\n> ends it.",
    ]
    rows = [(1, 0, "u", first), *((1, i, "u", f"{q}\n\nmy answer number {i}") for i, q in enumerate(quotes, 1))]
    rows += [(2, 0, "u", "We could go there. Shall we take the train? It is late."), (2, 1, "u", "> Shall we take the train?\nYes please"), (2, 2, "u", "> Yes please\nfine"), (2, 3, "u", "你好。我们走吧。"), (2, 4, "u", "> 我们走吧。\nok")]
    rows += [(3, 0, "u", "> Yes please\nnot said here"), (4, 0, "u", ">\n> \nblank")]
    out = {(r.conv_id, r.turn): (r.reply_to, r.n_quotes, r.n_linked) for r in conversations_by_reply(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(out[(1, i)] == (0, 1, 1) for i in range(1, 5))
    assert [out[(2, i)] for i in range(5)] == [(None, 0, 0), (0, 1, 1), (1, 1, 1), (None, 0, 0), (3, 1, 1)]
    assert out[(3, 0)] == (None, 1, 0) and out[(4, 0)] == (None, 0, 0)


def plain_passages(text):
    """(level, text) of the runs of quoted lines of one level."""
    out = []
    for line in (text or "").split("\n"):
        mark = re.match(r"(?:[ \t]*>)+[ \t]?", line)
        level, body = (mark[0].count(">"), line[mark.end():]) if mark else (0, line)
        if out and out[-1][0] == level:
            out[-1] = (level, out[-1][1] + "\n" + body)
        else:
            out.append((level, body))
    return [p for p in out if p[0]]


def plain_parts(text):
    cuts = [text, *re.split(r"\n\s*\n", text), *text.split("\n"), *re.split(r"\n\s*\n|(?<=[.!?…])\s+|(?<=[。！？])", text)]
    return {x for x in (re.sub(r"\s+", " ", c).strip(" ").lower() for c in cuts) if x}


def test_links_equal_brute_force(spark):
    rnd = random.Random(9)
    pool = ["Yes.", "No way!", "We meet at noon. Bring the map.", "It rains", "A longer line of words that goes on", "two\nlines here", "para one\n\npara two. And more"]
    rows = []
    for c in range(30):
        for t in range(6):
            said = [rnd.choice(pool) + rnd.choice(["", f" {rnd.randint(0, 40)}"]) for _ in range(rnd.randint(1, 3))]
            body = "\n".join(said)
            if t and rnd.random() < 0.8:
                old = rnd.choice([r[3] for r in rows[-t:]] if rnd.random() < 0.8 else [r[3] for r in rows]).split("\n")
                lo = rnd.randint(0, len(old) - 1)
                body = "\n".join(("> " if rnd.random() < 0.9 else ">> ") + x for x in old[lo : lo + rnd.randint(1, 3)]) + "\n" + body
            rows.append((c, t, "u", body))
    own = lambda text: "\n".join(x for x in text.split("\n") if not re.match(r"[ \t]*>", x)).strip("\n") if re.search(r"(?m)^[ \t]*>", text) else text
    said = {}
    for c, t, _, text in rows:
        for p in plain_parts(own(text)):
            said.setdefault(p, []).append((c, t))
    want = {}
    for c, t, _, text in rows:
        for level, quoted in plain_passages(text):
            best = None
            for p in plain_parts(quoted):
                near = [o for o in said.get(p, []) if o[0] == c and o[1] < t]
                first = min(said.get(p, [(None, None)]))
                if near:
                    found = (len(p), 1, max(o[1] for o in near), 0, c, max(o[1] for o in near))
                elif first[0] is not None and (len(p) >= 12 or p == re.sub(r"\s+", " ", quoted).strip(" ").lower()) and (first[0] != c or first[1] < t):
                    found = (len(p), 0, -first[0], -first[1], *first)
                else:
                    continue
                best = max(best or found, found)
            key = (c, t, level, hashlib.sha256(re.sub(r"\s+", " ", quoted).strip(" ").lower().encode()).hexdigest()[:32])
            if quoted.strip():
                want[key] = best[4:] if best else (None, None)
    got = {(r.conv_id, r.turn, r.level, r.hash): (r.to_conv, r.to_turn) for r in quotation_links(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == want and sum(v[0] is not None for v in want.values()) > 100


def test_long_quotes_are_parsed_in_one_go(spark):
    # many runs of many lines; a fold that copies its runs would take time in the square of them
    text = "\n".join((">" * (1 + i // 3 % 2)) + f" line {i}" for i in range(60_000))
    out = quotation_links(spark.createDataFrame([(1, 0, "u", text)], "conv_id long, turn long, role string, text string"))
    assert out.select("level", "hash").count() == 20_000


# Lattices

@pytest.fixture(scope="module")
def lattice():
    return Lattice.read()


def every_path(lattice, chunk):
    ends = lattice.edges(chunk)

    def back(j):
        if j == 0:
            yield 0.0, ()
            return
        for i, s, p in ends[j]:
            for score, ids in back(i):
                yield score + s, ids + lattice.spell(p, chunk[i:j])

    return back(len(chunk))


def ids_of(raw):
    return tuple(np.frombuffer(raw, np.int32).tolist())


def test_nbest_equals_enumeration(lattice):
    rnd = random.Random(1)
    for _ in range(60):
        text = "".join(rnd.choice("abthenoxi,. 你é") for _ in range(rnd.randint(1, 8)))
        want = sorted((s for s, _ in every_path(lattice, MARK + text.replace(" ", MARK))), reverse=True)[:4]
        best = lattice.segmentations([text], 4)[0]
        assert [s for s, _ in best] == want
        found = {ids_of(raw) for _, raw in best}
        assert all(b"".join(map(lattice.raw.get, ids)).decode()[1:] == text for ids in found)
        assert len(found) == len(best) and ids_of(best[0][1]) in {i for s, i in every_path(lattice, MARK + text.replace(" ", MARK)) if s == want[0]}


def test_lockstep_search_equals_the_search_of_each_chunk(lattice):
    rnd = random.Random(2)
    chunks = sorted({"".join(rnd.choice("abthenoxi▁é你\ud800") for _ in range(rnd.randint(1, 30))) for _ in range(300)}, key=len, reverse=True)
    assert lattice._lockstep(chunks) == [lattice.path(c) for c in chunks]


def test_encoding_round_trips_on_odd_texts(spark):
    texts = ["", None, " ", "\n", "  a  b ", "a▁b ▁", "🙂\r\n);\r", "x" * 30_000, "\x00\x01", "é" * 300, "﷐", "same", "same"]
    out = encode_texts(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int"), n=3)
    assert all(r.round_trip is (None if texts[r.doc_id] is None else True) for r in out.collect())
    assert {r.doc_id: r.text for r in decode_ids(out).collect()} == dict(enumerate(texts))
    assert out.where("doc_id = 0").first().n_tokens == 0 and out.where("doc_id = 1").first().n_tokens is None


def test_every_one_of_the_nbest_leaves_the_task(spark, lattice):
    texts = ["the box on it", "attention, hexane", "a▁b 🙂", "", None]
    out = {r.doc_id: r for r in encode_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=4).collect()}
    assert out[3].nbest == [(0.0, [])] and out[4].nbest is None
    for i, text in enumerate(texts[:3]):
        row, score = out[i], {}
        for s, ids in every_path(lattice, MARK + text.replace(MARK, "\ud800").replace(" ", MARK)):
            score[ids] = max(s, score.get(ids, s))
        assert [b.score for b in row.nbest] == sorted(score.values(), reverse=True)[:4] == row.scores and row.round_trip
        assert len({tuple(b.ids) for b in row.nbest}) == min(4, len(score)) and all(score[tuple(b.ids)] == b.score and b"".join(map(lattice.raw.get, b.ids)).decode()[1:] == text for b in row.nbest)
        assert row.ids == row.nbest[0].ids


def test_chunks_of_all_texts_are_cut_at_once(lattice, monkeypatch):
    from lucerna.llm import sentencepiece_lattice as module

    rnd = random.Random(4)
    texts = ["", " ", "\n", "a▁b ▁ ▁▁", "🙂\r\n);\r", "  \n  "] + ["".join(rnd.choice("ab .,\n▁é你🙂-'\r\t  ") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    signs = re.escape("".join(chr(c) for c in range(128) if lattice.kinds[c] == module._SIGN))
    plain = re.compile(f"{MARK}*[^{MARK}\n{signs}]+|{MARK}*[{signs}]+|{MARK}+|\n")
    want = [plain.findall(MARK + t.replace(MARK, "\ud800").replace(" ", MARK)) if t else [] for t in texts]
    names, first = lattice.split(texts)
    got = [module._chunk(x) for x in names.to_pylist()]
    assert signs and [got[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == want
    # chunks that several texts hold are looked up once, and a text's results don't hang on those beside it
    alone, seen, learned = [lattice.segmentations([t], 4)[0] for t in texts], [], lattice._learned
    monkeypatch.setattr(lattice, "_learned", lambda names: seen.extend(names) or learned(names))
    assert lattice.segmentations(texts + texts, 4) == alone + alone
    assert len(seen) == len(set(seen)) == len({c for cut in want for c in cut})


def test_kept_paths_are_found_by_arrays(monkeypatch):
    from lucerna.llm import sentencepiece_lattice as module

    lattice, rnd, searched = Lattice.read(), random.Random(5), []
    together = lattice._together
    monkeypatch.setattr(lattice, "_together", lambda names, sizes: searched.extend(names.to_pylist()) or together(names, sizes))
    texts = ["".join(rnd.choice("abthenoxi ,.é你") for _ in range(rnd.randint(0, 60))) for _ in range(200)] + ["x" * 100, "a▁b 🙂"]
    want = lattice.segmentations(texts, 4)
    # long chunks are not kept, others are searched once
    assert len(searched) == len(set(searched)) == len(lattice.known) and lattice.segmentations(texts, 4) == want and len(searched) == len(lattice.known)
    assert lattice.paths.each() == [lattice.path(module._chunk(n)) for n in lattice.known.to_pylist()]
    # whatever is kept, and however much is searched at once, results are the same
    monkeypatch.setattr(module, "KEPT_CHUNKS", 20)
    monkeypatch.setattr(module, "AT_ONCE", 50)
    small = Lattice.read()
    for k in range(0, len(texts), 7):
        assert small.segmentations(texts[k : k + 7], 4) == want[k : k + 7] and len(small.known) <= 20
        assert small.paths.each() == [small.path(module._chunk(n)) for n in small.known.to_pylist()]


def test_best_path_is_the_first_of_the_astar(lattice):
    for chunk in ("x" * 7, "aaaa", "hexenxox", MARK * 5, "bathtaxi"):
        assert lattice.learn([chunk])[chunk][:2] == lattice.nbest(chunk, 4)[0][::-1]


# Classifiers

def rank_quality(rows):
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad)


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = spark.read.parquet(f"{tables}/../sf0.01/documents.parquet"), spark.read.parquet(f"{tables}/../sf0.01/labels.parquet")
    out = quality_scores(docs, labels)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    rows = [(r.score, r.quality) for r in out.join(labels, "doc_id").where("held_out").collect()]
    assert rank_quality(rows) > 0.9


def test_word_vectors_equal_plain_sums(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["aa", "Bb", "cc1", "dd!", "ee"]) for _ in range(rnd.randint(0, 12))) for _ in range(40)] + [None, ""]
    place, sign = _index_vectors()
    one = lambda w: (lambda h: int(h[0] % np.uint64(BUCKETS)))(word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), TOKENS)[0])
    want = np.zeros((BUCKETS, DIM))
    for t in texts:
        words = [one(w) for w in re.findall(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]+", t or "")]
        for i, w in enumerate(words):
            for j in range(max(0, i - WINDOW), min(len(words), i + WINDOW + 1)):
                if i != j:
                    for e in range(ENTRIES):
                        want[w, place[words[j], e]] += sign[words[j], e]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    got = word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(150))
    assert np.abs(got - want).max() < 1e-6


def test_network_equals_a_plain_forward_pass():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1000, 2 * DIM))
    y = (x[:, 0] + 0.1 * rng.normal(size=1000) > 0).astype(float)
    net = Network(x, y)
    w1, b1, w2, b2 = net.layers
    for row, score in zip(x[:20], net.score(x[:20]), strict=True):
        z = [(v - c) / s for v, c, s in zip(row, net.centre, net.scale, strict=True)]
        hidden = [math.tanh(sum(v * w for v, w in zip(z, w1[:, k], strict=True)) + b1[k]) for k in range(len(b1))]
        assert score == pytest.approx(1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2[0]) / net.temperature)))
    assert rank_quality(list(zip(net.score(x), y, strict=True))) > 0.95


def test_quality_ignores_held_out_labels_and_other_columns(spark, tables):
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda d, k: {r.doc_id: r.score for r in quality_scores(d, k).collect()}
    first = score(docs, labels)
    assert first == pytest.approx(score(docs.withColumn("lang", F.lit("zz")).withColumn("y", F.lit(1)), flipped), abs=1e-9)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b"), (3, "w " * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    out = quality_scores(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out) and sum(r.held_out is None for r in out) == 1
    assert quality_scores(docs.limit(0), labels.limit(0)).count() == 0


def test_toxicity_finds_labelled_rows(spark, tables):
    docs, labels = spark.read.parquet(f"{tables}/../sf0.1/documents.parquet").limit(4000), spark.read.parquet(f"{tables}/../sf0.1/labels.parquet")
    even = labels.where("doc_id % 2 = 0")
    rows = [(r.out, r.toxic) for r in toxicity_scores(docs, even).withColumnRenamed("toxic", "out").join(labels.where("doc_id % 2 = 1"), "doc_id").select("out", "toxic").collect()]
    found, clean = [o for o, y in rows if y], [o for o, y in rows if not y]
    assert sum(found) / len(found) > 0.6 and sum(clean) / len(clean) < 0.02


def test_toxicity_of_held_out_rows(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/../sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity_scores(docs, labels.where("doc_id % 3 <> 0")).withColumnRenamed("toxic", "out").join(labels.where("doc_id % 3 = 0"), "doc_id").select("out", "toxic").collect()
    found, clean = [r.out for r in out if r.toxic], [r.out for r in out if not r.toxic]
    assert sum(found) / len(found) > 0.9 and sum(clean) / len(clean) < 0.01


def test_link_loss_equals_a_plain_one_and_its_differences():
    rng = np.random.default_rng(0)
    score, grade, cuts = rng.normal(size=40), rng.integers(0, 4, 40), np.array([-0.5, 0.3, 1.1])

    def plain(score, cuts):
        q = lambda s, k: 1.0 if k == 0 else 0.0 if k > 3 else 1 / (1 + math.exp(cuts[k - 1] - s))
        return -sum(math.log(q(s, g) - q(s, g + 1)) for s, g in zip(score, grade, strict=True)) / len(score)

    loss, by_score, by_cut = link_loss(score, grade, cuts)
    step = lambda n, i: np.eye(n)[i] * 1e-6
    assert loss == pytest.approx(plain(score, cuts))
    assert by_score == pytest.approx([(plain(score + step(40, i), cuts) - plain(score - step(40, i), cuts)) / 2e-6 for i in range(40)], abs=1e-6)
    assert by_cut == pytest.approx([(plain(score, cuts + step(3, i)) - plain(score, cuts - step(3, i))) / 2e-6 for i in range(3)], abs=1e-6)


def test_fit_comes_close_to_the_least_loss():
    # one shared weight and two thresholds: the least loss by a fine search
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, 400).astype(float)
    grade = np.clip((x + rng.logistic(size=400)).round().astype(int), 0, 2)
    w, cuts = fit_cumulative_link(np.arange(401), np.zeros(400, np.int64), x, grade, 1, epochs=200, ridge=0.0)
    best = min(link_loss(x * a, grade, np.array([b, b + c]))[0] for a in np.linspace(0.2, 2, 37) for b in np.linspace(-1, 3, 41) for c in np.linspace(0.2, 3, 29))
    assert link_loss(x * w[0], grade, cuts)[0] < best + 0.01 and cuts[0] < cuts[1]


def test_graded_labels_give_ordered_severities(spark):
    rnd = random.Random(5)
    words = [f"plain{chr(97 + i)}word" for i in range(26)]
    rows = []
    for i in range(400):
        g = i % 4
        rows.append((i, " ".join(rnd.choices(words, k=12) + ["vile"] * g + rnd.choices(words, k=3)), g))
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = fit_severity(docs.select("doc_id", "text"), docs.where("doc_id < 300").select("doc_id", "grade"), grade="grade")
    out = score_rows(docs.where("doc_id >= 300").select("doc_id", "text", F.col("grade").alias("true")), model).collect()
    mean = [sum(r.expected_severity for r in out if r.true == g) / 25 for g in range(4)]
    assert len(model.thresholds) == 3 and list(model.thresholds) == sorted(model.thresholds)
    assert all(b - a > 0.5 for a, b in zip(mean, mean[1:], strict=False)) and sum(abs(r.grade - r.true) <= 1 for r in out) > 95


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "a"), (None, "b")], "doc_id long, text string").withColumn("y", F.lit(1)).withColumn("p_toxic", F.lit(1.0))
    none = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [(r.expected_severity, r.toxic) for r in toxicity_scores(docs, none).collect()] == [(0.0, False)] * 4
    few = spark.createDataFrame([(i, f"vile{i % 2} word" if i % 2 else "kind word") for i in range(20)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity_scores(few, marks).collect()}
    assert all(r.toxic == bool(i % 2) and 0 <= r.expected_severity <= 1 and not math.isnan(r.expected_severity) for i, r in got.items())


# Pipeline

def test_stages_do_what_their_operators_say(spark, tables, tmp_path):
    import corpus_pipeline as pipeline

    docs, bench = spark.read.parquet(f"{tables}/documents.parquet"), [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    columns, seen, docs_before = docs.columns, {}, docs.count()
    for name, stage in pipeline.STAGES:
        stage(spark, docs, tables).write.parquet(str(tmp_path / name))
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    from lucerna.llm.toxicity import toxicity_scores

    clean = toxicity_scores(seen["toxicity"][1].limit(0).unionByName(spark.read.parquet(f"{tables}/documents.parquet")), spark.read.parquet(f"{tables}/labels.parquet")).where("not toxic")
    assert {r.doc_id for r in seen["toxicity"][1].collect()} == {r.doc_id for r in clean.collect()} and clean.count() < docs_before
    before, after = seen["line dedup"]
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in after.collect()} == {i: v[2] for i, v in lines(before).items()}
    before, after = seen["MinHash near-dedup"]
    assert {r.doc_id for r in after.collect()} == {i for i, v in near(before).items() if v[2]}
    before, after = seen["benchmark decontamination"]
    assert {r.doc_id for r in after.collect()} == {i for i, v in contaminated(before, bench).items() if not v[4]}
    before, after = seen["SentencePiece encoding"]
    assert {r.doc_id for r in after.where("round_trip").collect()} == {i for i, _ in before}
    assert pipeline.run(spark, tables).count() == after.count()


def odd_documents(spark):
    same = "one text that two rows without an id and one with an id hold, long enough to have some shingles"
    rows = [(1, same), (None, same), (None, same), (5, "a text of its own under an id that repeats"), (5, "and another text under the very same id"), (5, "and another text under the very same id"),
            (6, None), (None, None), (7, ""), (8, "w " * 30_000), (9, "another text under the very same id and")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, rep int, comp string")


def test_stages_take_odd_rows(spark, tables):
    import corpus_pipeline as pipeline

    docs, columns = odd_documents(spark), pipeline.COLUMNS
    counts = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, tables)
        counts[name] = out.count()
        assert stage(spark, docs.limit(0), tables).count() == 0
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = out
    # the copies without an id go, as does one of two equal rows; both texts of id 5 stay, and texts without words
    assert counts["toxicity"] == counts["line dedup"] == 11 and counts["MinHash near-dedup"] == 8


def test_near_dedup_keeps_one_row_of_each_group(spark, tables):
    import corpus_pipeline as pipeline

    out = sorted(((r.doc_id, r.text) for r in pipeline.near_dedup(spark, odd_documents(spark), tables).collect()), key=repr)
    assert [i for i, t in out if t and t.startswith("one text")] == [1] and len(out) == 8 and len([1 for i, _ in out if i == 5]) == 2


def test_features_and_shingles_are_made_of_little_text_at_once():
    """Arrays of some hundred bytes a byte of text, in every worker of an executor: they are bounded by the slice, not the batch."""
    import tracemalloc

    import pyarrow as pa

    from lucerna.llm import minhash_dedup, toxicity

    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rnd.choices(words, k=300)) for _ in range(2000)]
    batch = pa.record_batch({"doc_id": pa.array(range(2000)), "text": pa.array(texts), "text_hash": pa.array(range(2000))})

    def peak(run):
        tracemalloc.start()
        for _ in run():
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / 1e6

    assert peak(lambda: toxicity._vectors(batch.column("text"))) < 50
    assert peak(lambda: minhash_dedup._reader(5)(iter([batch]))) < 50
