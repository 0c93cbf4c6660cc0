r"""Line dedup: a sharded minimal perfect hash over the distinct line hashes, probed by documents.

Each chunk of documents sends its distinct line hashes once to the shards of their leading bits, with
the `min_docs` largest distinct ids that hold them, which is all that the rule needs of them. A shard lays a minimal
perfect hash over its distinct hashes, with arrays of fingerprints, document counts (up to `min_docs`) and last holders;
the chunks' hashes probe these arrays, and only what is frequent goes back to its chunk. So a line that a
third of the documents holds is one entry per chunk, and never are more entries sent than lines. Chunks hold about CHUNK_CHARS of text, whatever the number of shuffle partitions.

A line's key is the line without `[\x20\x09-\x0D]` at its ends and with A-Z lower-cased. Keys of at
least `min_chars` code points found in at least `min_docs` documents lose all their lines but those in
the largest doc_id holding the key.

Defined results: null and empty texts are one empty line. Rows that repeat an id each come out and count
as one document; the lines of all rows of the largest id stay. A null id is an id of its own, the smallest. Other columns
are carried through by `drop_repeated_lines`. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import BLANKS, mix, shuffle_partitions

#: Characters of text in a chunk, at which a task holds a few chunks at once.
CHUNK_CHARS = 16 << 20
#: Levels of the perfect hash, with two bits a key at each; what is left over goes to a sorted list.
LEVELS = 24
_LEAST = -(2**63)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level a key alone in its slot stays there and
    the others go on; a key's index is the number of slots taken before its own."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        base, rest = 0, keys
        for level in range(LEVELS):
            if len(rest) == 0:
                break
            slots = 2 * len(rest) + 1
            at = (mix(rest + np.uint64(level * 0x51ED27)) % np.uint64(slots)).astype(np.int64)
            taken = np.bincount(at, minlength=slots) == 1
            self.levels.append((taken, base + np.cumsum(taken) - taken))
            base += int(taken.sum())
            rest = rest[~taken[at]]
        self.rest, self.base = np.sort(rest), base
        self.size = base + len(rest)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """An index below `size` for every key; that of a key outside the set means nothing."""
        out = np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        for level, (taken, rank) in enumerate(self.levels):
            if len(open_) == 0:
                return out
            at = (mix(keys[open_] + np.uint64(level * 0x51ED27)) % np.uint64(len(taken))).astype(np.int64)
            hit = taken[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        if len(open_):
            out[open_] = np.minimum(self.base + np.searchsorted(self.rest, keys[open_]), max(self.size - 1, 0))
        return out


class ShardIndex:
    """Fingerprints, document counts (`most` at most) and last holders of a shard's lines, in the order of the
    perfect hash; given as (hash, id) entries of which some may repeat."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, most: int):
        order = np.lexsort((ids, hi, lo))
        lo, hi, ids = lo[order], hi[order], ids[order]
        line = np.ones(len(lo), bool)
        line[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        new = line.copy()
        new[1:] |= ids[1:] != ids[:-1]
        at = np.flatnonzero(line)
        keys = mix(lo[at] ^ mix(hi[at]))
        self.hash = PerfectHash(np.unique(keys))
        place = self.hash.index(keys)
        self.fingerprint = np.zeros(self.hash.size, np.uint64)
        self.fingerprint[place] = hi[at]
        self.count = np.zeros(self.hash.size, np.int64)
        self.count[place] = np.minimum(np.add.reduceat(new.astype(np.int64), at), most) if len(at) else 0
        self.last = np.zeros(self.hash.size, np.int64)
        self.last[place] = ids[np.append(at[1:], len(ids)) - 1] if len(at) else 0

    def probe(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (0 where the fingerprint differs) and last holders."""
        at = self.hash.index(mix(lo ^ mix(hi)))
        return np.where(self.fingerprint[at] == hi, self.count[at], 0), self.last[at]


def _line_keys(text: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    """Line numbers and 16-byte hashes of the lines long enough to count."""
    for i, line in enumerate(text.split(b"\n")):
        if len(line) >= least:
            key = line.strip(BLANKS)
            if len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode()) >= least):
                yield i, xxhash.xxh3_128_digest(key.lower())


def _texts(table: pa.Table) -> list[bytes]:
    return [t or b"" for t in table.column("text").cast(pa.large_binary()).to_pylist()]


def _ids(table: pa.Table) -> np.ndarray:
    return np.array([_LEAST if d is None else d for d in table.column("doc_id").to_pylist()], np.int64)


def _sender(shards: int, least: int, most: int):
    def send(table: pa.Table) -> pa.Table:
        """A chunk's distinct line hashes, a row of packed arrays for each shard that has any."""
        found: dict[bytes, int | set[int]] = {}
        for doc, text in zip(_ids(table).tolist(), _texts(table), strict=True):
            for key in {k for _, k in _line_keys(text, least)}:
                x = found.setdefault(key, doc)
                if isinstance(x, set):
                    x.add(doc)
                    if len(x) > most:
                        x.remove(min(x))
                elif x != doc:
                    found[key] = {x, doc} if most > 1 else max(x, doc)
        both = np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)
        held = [[x] if isinstance(x, int) else sorted(x) for x in found.values()]
        many = np.array([len(x) for x in held], np.int64)
        ids = np.array(list(chain.from_iterable(held)), np.int64)
        shard = (mix(both[:, 0]) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        start = np.cumsum(many) - many
        of = np.repeat(start[order] - (np.cumsum(many[order]) - many[order]), many[order]) + np.arange(len(ids))
        ids, stop = ids[of], np.append(0, np.cumsum(many[order]))
        chunk, out = table.column("chunk")[0].as_py(), []
        for s in np.flatnonzero(np.diff(ends)):
            a, b = ends[s], ends[s + 1]
            out.append((int(s), chunk, both[order[a:b]].tobytes(), many[order[a:b]].astype(np.int32).tobytes(), ids[stop[a] : stop[b]].tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(("shard", "chunk", "hashes", "counts", "ids"), kinds, strict=True))})

    return send


def _answer(min_docs: int):
    def answer(table: pa.Table) -> pa.Table:
        """Build one shard's index, probe it with each chunk's hashes, return what is frequent."""
        packed = table.column("hashes").to_pylist()
        both = np.frombuffer(b"".join(packed), np.uint64).reshape(-1, 2)
        many = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int32)
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
        index = ShardIndex(np.repeat(both[:, 0], many), np.repeat(both[:, 1], many), ids, min_docs)
        chunk, hashes, lasts = [], [], []
        for c, raw in zip(table.column("chunk").to_pylist(), packed, strict=True):
            mine = np.frombuffer(raw, np.uint64).reshape(-1, 2)
            n, holder = index.probe(mine[:, 0], mine[:, 1])
            hit = n >= min_docs
            if hit.any():
                chunk.append(c)
                hashes.append(mine[hit].tobytes())
                lasts.append(holder[hit].tobytes())
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "hashes": pa.array(hashes, pa.binary()), "lasts": pa.array(lasts, pa.binary())})

    return answer


def _dropper(least: int):
    def drop(docs: pa.Table, hits: pa.Table) -> pa.Table:
        raw = b"".join(hits.column("hashes").to_pylist())
        last = np.frombuffer(b"".join(hits.column("lasts").to_pylist()), np.int64).tolist()
        keep = {raw[16 * i : 16 * i + 16]: d for i, d in enumerate(last)}
        lines, dropped, kept = [], [], []
        for doc, text in zip(_ids(docs).tolist(), _texts(docs), strict=True):
            parts = text.split(b"\n")
            gone = {i for i, k in _line_keys(text, least) if keep.get(k, doc) != doc} if keep else set()
            lines.append(len(parts))
            dropped.append(len(gone))
            kept.append(b"\n".join(x for i, x in enumerate(parts) if i not in gone) if gone else text)
        done = docs.drop_columns(["text", "chunk"])
        return done.append_column("n_lines", pa.array(lines, pa.int64())).append_column("n_dropped", pa.array(dropped, pa.int64())).append_column(
            "text", pa.array(kept, pa.binary()).cast(pa.string())
        )

    return drop


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the columns named in `carry`, n_lines, n_dropped and the text without its repeated lines."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(carry or []))
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = max(shuffle_partitions(docs.sparkSession), -(-chars // CHUNK_CHARS))
    # by id and text, so that no id and no text that very many rows have fills a chunk
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))
    sent = rows.select("chunk", "doc_id", "text").groupBy("chunk").applyInArrow(_sender(n, min_chars, min_docs), "shard long, chunk long, hashes binary, counts binary, ids binary")
    hits = sent.groupBy("shard").applyInArrow(_answer(min_docs), "chunk long, hashes binary, lasts binary")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ["doc_id", *(carry or [])]] + ["n_lines long", "n_dropped long", "text string"])
    return rows.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_dropper(min_chars), schema)


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    out = drop_repeated_lines(docs, min_chars, min_docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
