"""Suffix-array dedup of byte strings of SPAN bytes that an earlier document holds.

Every string of SPAN bytes has an anchor: the place of the least hash among its GRAM-byte grams, which depends
on the string alone. Neighbouring strings with one anchor make a run, whose bytes are one longer string. First,
runs meet by anchor: a run that an earlier document holds whole is removed whole. What is left to decide are
runs whose anchor also occurs in other surroundings. These are sorted as suffixes: a run is sent as the
suffix at its anchor, for the strings that reach back less than HALF bytes from it, and as the suffix HALF
bytes before, for the others. Either way all of a suffix's strings hold its first SPAN - HALF bytes, so sampled
splitters can range-partition the suffixes by their leading LEAD bytes: equal strings never lie across a splitter, and a
gram that is common in many surroundings still spreads. Each bucket sorts the strings of its suffixes by
multikey quicksort on their bytes, eight at a time; equal neighbours take the smallest doc_id.

Runs whose anchor a sample shows in many surroundings are dealt to buckets by their bytes instead of their anchor (each of
them is known to have others beside it), so that a gram that most documents hold isn't one task's group.

A chunk of documents sends each distinct run once, so a passage that a third of the documents hold is one entry
per chunk, and never are more entries sent than runs. Chunks hold about CHUNK_CHARS of text. In the first step
hashes of 80 bits stand for equal runs; in the second strings are compared byte by byte.

Defined results: a null text is empty. Rows that repeat an id don't remove from each other; a null id
counts as larger than any id. Texts under SPAN bytes lose nothing. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import bounded_sample, mix, shuffle_partitions, slices, utf8

SPAN, GRAM, HALF, LEAD = 50, 24, 13, 37
#: Documents whose runs tell common anchors, kinds of run there that make an anchor common, and most anchors kept as such.
HOT_SAMPLE, HOT_KINDS, MOST_HOT = 2_000, 8, 100_000
#: Documents that the splitters are drawn from, and characters of text in a chunk.
SAMPLES, CHUNK_CHARS = (20_000, 200_000), 16 << 20
_LAST = 2**63 - 1
_PIECE_BITS = 17
_PIECE = 1 << _PIECE_BITS
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BYTE = np.random.default_rng(50).integers(0, 2**64, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(0x9E3779B97F4A7C15, _PIECE + 2 * SPAN)
_DOWN = _powers(pow(0x9E3779B97F4A7C15, -1, 2**64), _PIECE + 2 * SPAN)


def _pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for lo in range(0, len(data) - SPAN + 1, _PIECE):
        yield lo, np.ascontiguousarray(data[lo : lo + _PIECE + SPAN - 1])


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any substring follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _UP[: len(data)], out=out[1:])
    return out


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first position, number of strings, anchor hash, hash of the run's bytes, anchor's position) of each run."""
    parts = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)]]
    wide = SPAN - GRAM + 1
    for base, b in _pieces(data):
        m = len(b) - GRAM + 1
        x = np.ndarray((len(b) - 7,), "<u8", b.data, strides=(1,)).copy()
        h = x[:m] * _C[0]
        h ^= h >> np.uint64(29)
        h += x[8 : 8 + m]
        h *= _C[1]
        h ^= h >> np.uint64(32)
        h += x[16 : 16 + m]
        h *= _C[2]
        h ^= h >> np.uint64(29)
        low = (h >> np.uint64(_PIECE_BITS + 1) << np.uint64(_PIECE_BITS + 1)) | np.arange(m, dtype=np.uint64)
        size = 1
        while 2 * size <= wide:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < wide:
            low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
        anchor = (low & np.uint64(2 * _PIECE - 1)).astype(np.int64)
        # documents that these strings start in, and those strings that end in the same one
        first = int(np.searchsorted(offsets, base, side="right")) - 1
        last = int(np.searchsorted(offsets, base + len(anchor), side="left"))
        cut = np.clip(offsets[first : last + 1] - base, 0, len(anchor))
        doc = np.repeat(np.arange(first, last), np.diff(cut))
        at = np.arange(len(anchor))
        ok = at + base + SPAN <= offsets[1:][doc]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (ok[1:] != ok[:-1])
        start = np.flatnonzero(new)
        many = np.diff(np.append(start, len(at)))
        keep = ok[start]
        start, many = start[keep], many[keep]
        s = _sums(b)
        whole = mix((s[start + many + SPAN - 1] - s[start]) * _DOWN[start] + many.astype(np.uint64) * _C[1])
        parts.append([doc[start], start + base, many, mix(h[anchor[start]]), whole, anchor[start] + base])
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The LEAD bytes at each of the positions (at the data's end the last byte again), in an order that equals theirs."""
    out = np.zeros((len(at), LEAD), np.uint8)
    for k in range(LEAD if len(at) else 0):
        out[:, k] = data[np.minimum(at + k, len(data) - 1)]
    return out.view(f"S{LEAD}").ravel()


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by their words, first to last, and which ordered rows differ from the one before.
    Multikey quicksort with whole words as characters: each further word is read only where rows still tie."""
    n, width = words.shape
    order, new = np.arange(n), np.zeros(n, bool)
    new[:1] = True
    live = np.arange(n)  # places in the order whose rows tie so far, with their group
    group = np.zeros(n, np.int64)
    for k in range(width):
        if len(live) == 0:
            break
        w = words[order[live], k]
        by = np.lexsort((w, group))
        order[live] = order[live[by]]
        w = w[by]
        first = np.ones(len(live), bool)
        first[1:] = (w[1:] != w[:-1]) | (group[1:] != group[:-1])
        new[live[first]] = True
        size = np.diff(np.append(np.flatnonzero(first), len(live)))
        tied = np.repeat(size > 1, size)
        group = np.cumsum(first)[tied]
        live = live[tied]
    return order, new


class _Chunk:
    """A chunk's documents in a fixed order, with their bytes end to end."""

    def __init__(self, table: pa.Table):
        ids = np.array([_LAST if d is None else d for d in table.column("doc_id").to_pylist()], np.int64)
        hashes = np.asarray(table.column("text_hash"))
        self.order = np.lexsort((hashes, ids))
        self.ids = ids[self.order]
        self.data, self.offsets = utf8(table.column("text").take(pa.array(self.order)))

    def distinct_runs(self, buckets: int, hot: np.ndarray):
        """Runs; for each the number of its distinct (bucket, anchor, bytes); the distinct ones in order of
        bucket with their smallest id. Runs of one anchor share a bucket, but those of a hot one are dealt by their bytes."""
        doc, at, many, anchor, whole, place_of = runs(self.data, self.offsets)
        dealt = anchor.copy()
        common = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor) if len(hot) else np.zeros(0, np.int64)
        dealt[common] = mix(anchor[common] ^ whole[common])
        bucket = ((dealt >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
        key = mix(anchor ^ mix(whole))
        _, first, which = np.unique(key, return_index=True, return_inverse=True)  # documents come in order of id
        rank = np.lexsort((first, bucket[first]))
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        first = first[rank]
        return (doc, at, many, place_of), place[which], (bucket[first].astype(np.int64), anchor[first], whole[first], self.ids[doc[first]])


def _packed(name: str, chunk: int, bucket: np.ndarray, arrays: list[np.ndarray]) -> pa.Table:
    """One row for each bucket, of the arrays' parts; rows are in order of bucket."""
    ids = np.unique(bucket)
    lo, hi = np.searchsorted(bucket, ids), np.searchsorted(bucket, ids, side="right")
    cols = {"bucket": pa.array(ids, pa.int64()), "chunk": pa.array(np.full(len(ids), chunk), pa.int64())}
    for i, a in enumerate(arrays):
        cols[f"{name}{i}"] = pa.array([a[x:y].tobytes() for x, y in zip(lo, hi, strict=True)], pa.binary())
    return pa.table(cols)


def _send_runs(buckets: int, hot: np.ndarray):
    def send(table: pa.Table) -> pa.Table:
        _, _, (bucket, anchor, whole, ids) = _Chunk(table).distinct_runs(buckets, hot)
        return _packed("a", table.column("chunk")[0].as_py(), bucket, [anchor.astype(np.uint32), (whole >> np.uint64(32)).astype(np.uint32), (whole >> np.uint64(16)).astype(np.uint16), ids])

    return send


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _answers(table: pa.Table, kind: int, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    ends = np.cumsum([0, *sizes])
    return pa.table({"chunk": table.column("chunk"), "kind": pa.array(np.full(len(sizes), kind), pa.int32()), "bucket": table.column("bucket"), "flags": pa.array([flags[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})


def _meet_runs(hot: np.ndarray):
    """For each run: 1 if an earlier document holds it whole; 2 if it is the first of its kind and its
    anchor has other kinds, as hot ones have (some may lie in other buckets); else 0."""
    known = np.unique(hot.astype(np.uint32))

    def meet(table: pa.Table) -> pa.Table:
        a, w, v, ids = _joined(table, "a0", np.uint32), _joined(table, "a1", np.uint32), _joined(table, "a2", np.uint16), _joined(table, "a3", np.int64)
        order = np.lexsort((ids, v, w, a))
        a, w, v, ids = a[order], w[order], v[order], ids[order]
        anchor = np.ones(len(a), bool)
        anchor[1:] = a[1:] != a[:-1]
        kind = anchor.copy()
        kind[1:] |= (w[1:] != w[:-1]) | (v[1:] != v[:-1])
        least = ids[kind][np.cumsum(kind) - 1]
        kinds = np.add.reduceat(kind.astype(np.int64), np.flatnonzero(anchor))[np.cumsum(anchor) - 1]
        flags = np.zeros(len(a), np.uint8)
        flags[order] = np.where(least < ids, 1, np.where((kinds > 1) | np.isin(a, known), 2, 0))
        return _answers(table, 1, flags, [len(x) // 4 for x in table.column("a0").to_pylist()])

    return meet


def _flags(replies: pa.Table, kind: int, of: type = np.uint8) -> np.ndarray:
    """A chunk's flags of one kind, in order of bucket."""
    rows = sorted((b, f) for k, b, f in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "flags")), strict=True) if k == kind)
    return np.frombuffer(b"".join(f for _, f in rows), of)


def _open_runs(chunk: _Chunk, buckets: int, hot: np.ndarray, replies: pa.Table, splitters: np.ndarray):
    """Runs removed whole (start, strings); runs still open (start, and their number among the chunk's distinct
    open ones); and the suffixes of these (bucket, run's start, length, anchor's offset, far, id, number), in order of bucket."""
    (doc, at, many, anchor), which, (_, _, _, least) = chunk.distinct_runs(buckets, hot)
    flag = _flags(replies, 1)[which] if len(which) else np.zeros(0, np.uint8)
    gone = (flag == 1) | (chunk.ids[doc] > least[which])
    ask = np.flatnonzero((flag == 2) & ~gone)
    _, first, number = np.unique(which[ask], return_index=True, return_inverse=True)
    one = ask[first]
    offset = anchor[one] - at[one]
    near, far = offset - many[one] + 1 < HALF, offset >= HALF
    run = np.concatenate([np.flatnonzero(near), np.flatnonzero(far)])
    back = np.concatenate([np.zeros(int(near.sum()), np.int64), np.full(int(far.sum()), HALF)])
    bucket = np.searchsorted(splitters, _leading(chunk.data, anchor[one][run] - back), side="right")
    order = np.argsort(bucket, kind="stable")
    run, back = run[order], back[order]
    rows = one[run]
    return (at[gone], many[gone]), (at[ask], number, len(one)), (bucket[order].astype(np.int64), at[rows], many[rows] + SPAN - 1, offset[run], back > 0, chunk.ids[doc[rows]], run)


def _send_suffixes(buckets: int, hot: np.ndarray, splitters: np.ndarray):
    def send(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if docs.num_rows == 0:
            return _packed("a", 0, np.zeros(0, np.int64), [np.zeros(0, np.uint8)] * 5)
        chunk = _Chunk(docs)
        _, _, (bucket, at, length, offset, far, ids, _) = _open_runs(chunk, buckets, hot, replies, splitters)
        ends = np.cumsum(length)
        blob = chunk.data[np.repeat(at - (ends - length), length) + np.arange(int(length.sum()))]
        # the bytes lie end to end by bucket, so they are cut where the buckets' runs end
        packed = _packed("a", docs.column("chunk")[0].as_py(), bucket, [length.astype(np.uint8), offset.astype(np.uint8), far.astype(np.uint8), ids])
        cuts = np.append(0, np.append(0, ends)[np.searchsorted(bucket, packed.column("bucket").to_numpy(), side="right")])
        return packed.append_column("a4", pa.array([blob[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))

    return send


def _sort_suffixes(table: pa.Table) -> pa.Table:
    """Sort the strings of a bucket's suffixes; for each suffix a bit for each string of its run, 1 where an
    earlier document has an equal one."""
    length, offset, far = (_joined(table, f"a{i}", np.uint8).astype(np.int64) for i in range(3))
    ids, blob = _joined(table, "a3", np.int64), _joined(table, "a4", np.uint8)
    start = np.cumsum(length) - length
    # a string starts `back` bytes before the anchor: under HALF in the near suffix, HALF and more in the far one
    low = np.where(far, 0, np.maximum(offset - HALF + 1, 0))
    high = np.minimum(length - SPAN, np.where(far, offset - HALF, offset))
    many = high - low + 1
    row = np.repeat(np.arange(len(ids)), many)
    place = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    wide = -(-SPAN // 8) * 8
    text = np.zeros((len(row), wide), np.uint8)
    for lo in range(0, len(row), 1 << 18):
        part = slice(lo, lo + (1 << 18))
        text[part, :SPAN] = blob[(start[row[part]] + place[part])[:, None] + np.arange(SPAN)]
    order, new = multikey_order(text.view(">u8").astype(np.uint64))
    del text
    mine = ids[row][order]
    least = np.minimum.reduceat(mine, np.flatnonzero(new))[np.cumsum(new) - 1] if len(mine) else mine
    earlier = np.zeros(len(row), bool)
    earlier[order] = least < mine
    bits = np.bincount(row, weights=np.where(earlier, 2.0**place, 0.0), minlength=len(ids)).astype(np.uint32)
    return _answers(table, 2, bits, [len(x) for x in table.column("a0").to_pylist()])


def _remove(buckets: int, hot: np.ndarray, splitters: np.ndarray):
    def remove(docs: pa.Table, replies: pa.Table) -> pa.Table:
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
        if docs.num_rows == 0:
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        chunk = _Chunk(docs)
        (at, many), (open_at, number, distinct), (_, _, _, _, _, _, run) = _open_runs(chunk, buckets, hot, replies, splitters)
        bits = np.zeros(distinct, np.uint32)
        np.bitwise_or.at(bits, run, _flags(replies, 2, np.uint32))
        mine = bits[number] if distinct else np.zeros(0, np.uint32)
        pos = np.concatenate([open_at[:0], *[open_at[(mine >> np.uint32(k)) & np.uint32(1) == 1] + k for k in range(SPAN - GRAM + 1)]])
        start, end = np.concatenate([at, pos]), np.concatenate([at + many + SPAN - 1, pos + SPAN])
        sort = np.argsort(start, kind="stable")
        start, end = start[sort], end[sort]
        n_removed, n_spans, kept = [], [], []
        for lo, hi in slices(chunk.offsets):  # some documents at a time: no array as long as the chunk's text
            base, edges = chunk.offsets[lo], chunk.offsets[lo : hi + 1] - chunk.offsets[lo]
            n = int(edges[-1])
            mine = slice(*np.searchsorted(start, [base, base + n]))
            change = np.bincount(start[mine] - base, minlength=n + 1) - np.bincount(end[mine] - base, minlength=n + 1)
            covered = np.cumsum(change)[:n] > 0
            begins = covered.copy()
            begins[1:] &= ~covered[:-1]
            first = edges[:-1][edges[:-1] < n]
            begins[first] = covered[first]
            for flags, out in ((covered, n_removed), (begins, n_spans)):
                sums = np.append(0, np.cumsum(flags))
                out.append(sums[edges[1:]] - sums[edges[:-1]])
            data, keep = chunk.data[base : base + n], ~covered
            kept += [data[x:y][keep[x:y]].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)]
        lengths = np.diff(chunk.offsets)
        names = docs.column("doc_id").take(pa.array(chunk.order))
        return pa.table([names, pa.array(lengths, pa.int64()), pa.array(np.concatenate(n_removed), pa.int64()), pa.array(np.concatenate(n_spans), pa.int64()), pa.array(kept, pa.binary())], names=list(kinds))

    return remove


def _anchor_leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leading bytes at a few anchors of each text."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        doc, _, _, hashed, _, anchor = runs(data, offsets)
        order = np.lexsort((hashed, doc))
        rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        yield pa.RecordBatch.from_arrays([pa.array(_leading(data, anchor[order[rank < 3]]).tolist(), pa.binary())], names=["lead"])


def _splitters(rows: DataFrame, buckets: int) -> np.ndarray:
    """Quantiles of the leading bytes at sampled anchors, three in each of as many documents as there are buckets, but
    SAMPLES[0] at least and SAMPLES[1] at most; as many quantiles as sampled anchors give."""
    sample = bounded_sample(rows.where(F.length("text") >= SPAN).select("text", "text_hash", "doc_id"), ["text_hash", "doc_id"], min(max(SAMPLES[0], buckets), SAMPLES[1])).select("text")
    leads = np.sort(np.array([r[0] for r in sample.mapInArrow(_anchor_leads, "lead binary").collect()], f"S{LEAD}"))
    return np.unique(leads[(np.arange(1, buckets) * len(leads)) // buckets]) if len(leads) else leads


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchor and the bytes' hash of each text's runs."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for lo, hi in slices(offsets):
            _, _, _, anchor, whole, _ = runs(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64))], names=["anchor", "whole"])


def _hot_anchors(rows: DataFrame) -> np.ndarray:
    """Anchors that very many kinds of run have, by a sample of HOT_SAMPLE documents, sorted. What is not among them is
    rare enough for one bucket; what is may be common or not, the results are the same."""
    sample = bounded_sample(rows.where(F.length("text") >= SPAN).select("text", "text_hash", "doc_id"), ["text_hash", "doc_id"], HOT_SAMPLE).select("text")
    found = sample.mapInArrow(_kinds, "anchor long, whole long").groupBy("anchor").agg(F.countDistinct("whole").alias("n")).where(F.col("n") >= HOT_KINDS)
    most = found.orderBy(F.desc("n"), "anchor").limit(MOST_HOT).select("anchor").collect()
    return np.sort(np.array([r[0] for r in most], np.int64).view(np.uint64))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = max(shuffle_partitions(docs.sparkSession), -(-chars // CHUNK_CHARS))
    splitters, hot = _splitters(rows, n), _hot_anchors(rows)
    # by id and text, so that no id and no text that very many rows have fills a chunk
    chunks = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(n)))
    reply = "chunk long, kind int, bucket long, flags binary"
    run_flags = (
        chunks.groupBy("chunk").applyInArrow(_send_runs(n, hot), "bucket long, chunk long, a0 binary, a1 binary, a2 binary, a3 binary")
        .groupBy("bucket").applyInArrow(_meet_runs(hot), reply)
    )
    suffix_flags = (
        chunks.groupBy("chunk").cogroup(run_flags.groupBy("chunk")).applyInArrow(_send_suffixes(n, hot, splitters), "bucket long, chunk long, a0 binary, a1 binary, a2 binary, a3 binary, a4 binary")
        .groupBy("bucket").applyInArrow(_sort_suffixes, reply)
    )
    flags = run_flags.unionByName(suffix_flags)
    return chunks.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(_remove(n, hot, splitters), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
