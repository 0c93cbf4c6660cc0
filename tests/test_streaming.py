"""The streamed form against the batch form."""

import random
import time

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lucerna.operators import history, tracing
from lucerna.streaming.histories import HELD, Tracing, trace_stream

SCHEMA = "event_id long, learner long, seq long, correct int, kc_ids array<string>"


def timed(df):
    return df.withColumn("ts", F.timestamp_seconds(F.col("seq") * 600 + 1_700_000_000))


def traced(spark, df, batches, tmp_path, name, **options):
    """The stream's rows for batches of seqs, a file each, and its numbers of state rows."""
    for k, seqs in enumerate(batches):
        df.where(F.col("seq").isin(seqs)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        time.sleep(1.1)  # files are read in order of their times
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = trace_stream(source, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    state = [op for p in query.recentProgress for op in p["stateOperators"] if "transformWithState" in op["operatorName"]]
    return spark.table(name), state


def test_late_events_within_the_watermark_get_the_batch_numbers(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, i % 3, i // 3 + 1, rnd.randint(0, 1), rnd.sample(["A", "B"], rnd.randint(0, 2))) for i in range(60)]
    df = timed(spark.createDataFrame(rows, SCHEMA))
    # six numbers an hour: numbers come before their predecessors, and one comes twice
    got, _ = traced(spark, df, [[1, 2, 3, 5], [4, 8, 7, 6], [10, 9, 12], [11, 14, 13, 9], [15, 16, 17, 18, 19, 20]], tmp_path, "late")
    start = spark.createDataFrame([("A", 0.5), ("B", 0.5)], "kc string, initial double")
    want = history.opportunity_index(df).join(tracing.mastery_before(df, start), ["learner", "seq", "kc"])
    key = lambda d: sorted((r.learner, r.kc, r.seq, r.opportunity, round(r.mastery, 9)) for r in d.collect())
    # the watermark ends an hour behind the last event: what it hasn't passed stays held
    assert key(got) == key(want.where("seq <= 14"))


def test_events_behind_the_watermark_are_dropped_and_gone_learners_forgotten(spark, tmp_path):
    rows = [(1, 1, 1, 1, ["A"]), (2, 1, 2, 0, ["A"]), (3, 2, 40, 1, ["A"]), (4, 1, 3, 1, ["A"]), (5, 2, 400, 1, ["A"]), (6, 1, 401, 1, ["A"]), (7, 2, 500, 1, ["A"])]
    df = timed(spark.createDataFrame(rows, SCHEMA))
    got, state = traced(spark, df, [[1, 2], [40], [3], [400], [401], [500]], tmp_path, "gone", idle_seconds=20 * 3600)
    numbers = sorted((r.event_id, r.opportunity, r.mastery) for r in got.collect())
    # event 4 came behind the watermark; by event 6 the learner's chain had been forgotten and starts anew
    assert [(i, n) for i, n, _ in numbers] == [(1, 1), (2, 2), (3, 1), (5, 1), (6, 1)] and numbers[-1][2] == 0.5
    assert state


def test_state_calls_grow_with_buckets_not_with_chains(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, i % 30, i // 30 + 1, rnd.randint(0, 1), rnd.sample("ABCDEF", rnd.randint(0, 4))) for i in range(600)]
    df = timed(spark.createDataFrame(rows, SCHEMA))
    # numbers that come late meet chains of other learners of their bucket, already numbered or held
    got, state = traced(spark, df, [[1, 2, 3, 5], [7, 4, 10, 6, 9, 8], [11, 13, 12, *range(14, 21)]], tmp_path, "buckets", buckets=3)
    start = spark.createDataFrame([(k, 0.5) for k in "ABCDEF"], "kc string, initial double")
    want = history.opportunity_index(df).join(tracing.mastery_before(df, start), ["learner", "seq", "kc"])
    key = lambda d: sorted((r.learner, r.kc, r.seq, r.opportunity, round(r.mastery, 9)) for r in d.collect())
    assert key(got) == key(want.where("seq <= 14"))
    # a bucket's held events and its chains, not a value each of 180 chains
    assert 0 < max(op["numRowsUpdated"] for op in state) <= 2 * 3


def test_events_of_one_millisecond_are_in_order_of_their_times(spark, tmp_path):
    rows = [(1, 1, 1, 1, ["A"], 900), (2, 1, 2, 0, ["A"], 100), (3, 1, 3, None, ["A"], 950), (4, 1, 4, 1, ["A"], 999), (5, 2, 30, 1, ["A"], 0)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, us long").withColumn("ts", F.timestamp_micros(F.when(F.col("seq") < 30, F.col("us")).otherwise(3 * 3600 * 10**6) + 1_700_000_000_000_000)).drop("us")
    got, _ = traced(spark, df, [[1, 2, 3, 4, 30]], tmp_path, "micros")
    numbers = {r.event_id: (r.opportunity, r.mastery) for r in got.collect()}
    assert {i: n for i, (n, _) in numbers.items()} == {2: 1, 1: 2, 3: 3, 4: 4}
    # an answer that isn't known counts as wrong, as in the batch form
    assert numbers[4][1] == tracing.Bkt().after(numbers[3][1], 0)


def test_events_numbered_in_pieces_are_those_of_one_pass():
    rnd, idle, model = random.Random(5), 5000, tracing.Bkt()
    events = sorted((rnd.choice([rnd.randint(0, 10**8), 5 * 10**7]), i, rnd.randint(-3, 3), rnd.randint(0, 1), rnd.sample("ABC", rnd.randint(1, 3))) for i in range(900))
    rows = [{"us": us, "seq": i, "event_id": i, "learner": learner, "correct": c, "kc_ids": kcs} for us, i, learner, c, kcs in events]
    want, chains = {}, {}
    for r in rows:
        for kc in r["kc_ids"]:
            ms = r["us"] // 1000
            seen, mastery, last = chains.get((r["learner"], kc), (0, 0.5, ms))
            if ms - last > idle:
                seen, mastery = 0, 0.5
            want[r["event_id"], r["learner"], kc] = seen + 1, mastery
            chains[r["learner"], kc] = seen + 1, model.after(mastery, r["correct"]), ms
    held, processor = pa.Table.from_pylist(rows, HELD), Tracing(0.5, model, idle)
    assert max(n for n, _ in want.values()) > 1 and sum(n == 1 for n, _ in want.values()) > 21  # some chains start anew
    for size in (900, 7, 1):
        moved = {}
        got = pd.concat([processor.numbered(held.slice(at, size), moved) for at in range(0, 900, size)])
        assert {(e, l, k): (n, m) for e, l, k, n, m in got[["event_id", "learner", "kc", "opportunity", "mastery"]].itertuples(index=False)} == want and len(got) == len(want)
        assert moved == chains
