"""Opportunity numbers and mastery over a stream of labelled events, in event order.

Late data: the reference form has none, so ours is declared. An event is held until the watermark passes its time;
then all events of its learner and label up to that time are numbered in order of (ts, seq). An event that
comes late, but not behind the watermark, thus gets the numbers of the batch form; one behind it is dropped, and one
that repeats an event_id within the watermark too. What the watermark hasn't passed when a bounded stream ends
stays held. State is a count, the mastery and the held events. After `idle` without an event (by the events'
times) a chain is forgotten: a learner who comes back starts anew.

Each call to the state costs a message to Spark and back, so learners are keyed in buckets: a bucket's chains are read and
written at once, and the events of a batch are held as one value, not one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lucerna.operators.tracing import Bkt

OUTPUT = "event_id long, learner long, kc string, seq long, opportunity long, mastery double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of learners. Calls to the state grow with it, a bucket's events fall with it. A checkpoint is bound to it.
BUCKETS = 2048
#: Events numbered at once.
PIECE = 1 << 16
HELD = pa.schema({"learner": pa.int64(), "us": pa.int64(), "seq": pa.int64(), "event_id": pa.int64(), "correct": pa.int32(), "kc_ids": pa.list_(pa.string())})
CHAINS = pa.schema({"learner": pa.int64(), "kc": pa.string(), "seen": pa.int64(), "mastery": pa.float64(), "last": pa.int64()})


def _bytes(columns: list, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema))
    return sink.getvalue().to_pybytes()


def _table(stored: bytes) -> pa.Table:
    return pa.ipc.open_stream(stored).read_all()


class Tracing(StatefulProcessor):
    """The chains of a bucket's learners, one a learner and label: a count and the mastery after the released events, and the
    bucket's events held."""

    def __init__(self, initial: float, model: Bkt, idle_ms: int):
        self.first, self.model, self.idle = initial, model, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chains = handle.getValueState("chains", "stored binary")
        self.held = handle.getListState("held", "stored binary")
        self.released: set[tuple] = set()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, least = timerValues.getCurrentWatermarkInMs(), []
        for frame in rows:
            frame = frame[frame["us"] // 1000 > passed]
            if len(frame):
                self.held.appendValue((_bytes([frame[n].to_numpy() for n in HELD.names], HELD),))
                least.append(int(frame["us"].min()) // 1000)
        if least:
            self.handle.registerTimer(min(least))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed, at once; other timers that have expired with this one find nothing left
        if key in self.released:
            return
        self.released.add(key)
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        chains = {}
        if self.chains.exists():
            learner, kc, *state = (c.to_pylist() for c in _table(self.chains.get()[0]).itercolumns())
            chains = dict(zip(zip(learner, kc), zip(*state)))
        if self.held.exists():
            events = pa.concat_tables(_table(stored) for (stored,) in self.held.get()).sort_by([(n, "ascending") for n in ("us", "seq", "event_id")])
            n = int(np.searchsorted(events["us"].to_numpy(), (now + 1) * 1000))
            if n < len(events):
                later = events.slice(n)
                self.held.put([(_bytes(later.columns, HELD),)])
                self.handle.registerTimer(later["us"][0].as_py() // 1000)
            else:
                self.held.clear()
            for at in range(0, n, PIECE):
                yield self.numbered(events.slice(at, min(PIECE, n - at)), chains)
        chains = {k: c for k, c in chains.items() if now <= c[2] + self.idle}
        if chains:
            self.chains.update((_bytes(list(zip(*[(*k, *c) for k, c in chains.items()])), CHAINS),))
            self.handle.registerTimer(min(last for _, _, last in chains.values()) + self.idle + 1)
        else:
            self.chains.clear()

    def numbered(self, events: pa.Table, chains: dict[tuple[int, str], tuple[int, float, int]]) -> pd.DataFrame:
        """The numbered rows of events that come in order; their chains are moved on."""
        labels = events["kc_ids"].combine_chunks()
        at = np.repeat(np.arange(len(events)), pc.list_value_length(labels).to_numpy())
        coded = labels.flatten().dictionary_encode()
        names, kc = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        learners, learner = np.unique(events["learner"].to_numpy(), return_inverse=True)
        chain = learner[at] * len(names) + kc
        order = np.argsort(chain, kind="stable")
        at, chain = at[order], chain[order]
        times = events["us"].to_numpy()[at] // 1000
        starts = np.flatnonzero((np.diff(chain, prepend=-1) != 0) | (np.diff(times, prepend=times[:1]) > self.idle))
        ends = np.append(starts[1:], len(at))
        correct, seens, before, after = events["correct"].to_numpy()[at].tolist(), [], [], self.model.after
        for a, b, c, came, went in zip(starts.tolist(), ends.tolist(), chain[starts].tolist(), times[starts].tolist(), times[ends - 1].tolist()):
            key = int(learners[c // len(names)]), names[c % len(names)]
            seen, mastery, last = chains.get(key) or (0, self.first, came)
            if came - last > self.idle:
                seen, mastery = 0, self.first
            for right in correct[a:b]:
                before.append(mastery)
                mastery = after(mastery, right)
            seens.append(seen)
            chains[key] = seen + b - a, mastery, went
        numbers = np.arange(1, len(at) + 1) + np.repeat(np.array(seens, "int64") - starts, ends - starts)
        given = {n: events[n].to_numpy()[at] for n in ("event_id", "learner", "seq")}
        return pd.DataFrame({"event_id": given["event_id"], "learner": given["learner"], "kc": np.array(names, object)[kc[order]], "seq": given["seq"], "opportunity": numbers, "mastery": before})

    def close(self) -> None:
        pass


def use_rocks(spark: SparkSession) -> None:
    """Timers and typed state need the RocksDB state store. It isn't to count its rows, which takes a read before each write."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")


def trace_stream(events: DataFrame, initial: float = 0.5, model: Bkt = Bkt(), watermark: str = "1 hour", idle_seconds: int = 30 * 24 * 3600, buckets: int = BUCKETS) -> DataFrame:
    """events: event_id, learner, seq, ts, correct, kc_ids. For each event and label, once the watermark has passed it:
    its opportunity number and the mastery before it."""
    use_rocks(events.sparkSession)
    once = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    some = once.where(F.size("kc_ids") > 0).select("event_id", "learner", "seq", F.unix_micros("ts").alias("us"), F.coalesce("correct", F.lit(0)).cast("int").alias("correct"), "kc_ids", F.pmod(F.xxhash64("learner"), F.lit(buckets)).alias("bucket"))
    return some.groupBy("bucket").transformWithStateInPandas(Tracing(initial, model, idle_seconds * 1000), OUTPUT, "append", "eventTime")
