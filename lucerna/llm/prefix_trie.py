"""Prefix trie of conversations: padded matrices of turn ids, sorted and reduced in range shards, boundary nodes recombined.

A turn is known by two 64-bit hashes of its role and text, so texts never travel. Conversations are rows of ids,
range-partitioned by their sequence and conversation id. A shard sorts its rows tile by tile (so many columns
of the padded matrix at a time, for the rows that reach them): lexsort, column change masks accumulated by OR
mark where nodes start, reduceat aggregates each depth. In row order a node's subtree is a contiguous run of
the nodes in preorder, so subtree sums are differences of one cumulative sum. Nodes on the paths of a shard's
first and last row may go on in other shards: a shard returns their partial figures, which are added up by
prefix hash, and their subtrees by suffix sums along these paths. Rows of the smallest depths or of equal
conversations, however many, thus lie in as many shards as it takes.

Defined results: turns are ordered by number, null first, and equal numbers by the turns' hashes; a null role or
text is empty; repeated rows are turns like others. Rows without a conversation id are left out. Other columns
are ignored. An empty table gives no rows. A conversation's ids (16 bytes a turn) lie in one row; equal turns of
different roles or texts would need both hashes to agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.llm.common import checkpoint, shuffle_partitions

#: Turns that a shard should hold, turns under which it isn't split further to use all tasks, and columns of
#: the matrix sorted at a time.
SHARD_TURNS, LEAST_TURNS, TILE = 500_000, 10_000, 32
#: Ids of one row of a boundary node's list.
LIST_IDS = 50_000
_EMPTY = hashlib.sha256(b"").hexdigest()
CLOSED, PARENT_OPEN, OPEN, LIST = 0, 1, 2, 3
_OUT = (
    "kind int, shard int, path long, hash binary, parent_hash binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, words long, longer boolean, part long, ends string"
)
_NAMES = [f.strip().split(" ")[0] for f in _OUT.split(",")]


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """conv_id, ids (two longs a turn), words: each conversation with its first h turns, h being crc32 of its id
    modulo `most`, replaced by the first h of conversation c - c % every."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    c = F.col("conv_id")
    turn = F.struct(
        F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"), F.xxhash64(F.lit(1), empty("role"), empty("text")).alias("a"), F.xxhash64(F.lit(2), empty("role"), empty("text")).alias("b"),
        F.regexp_count(empty("text"), F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )
    rows = turns.where("conv_id is not null").select(c.cast("long").alias("conv_id"), (c - c % every).cast("long").alias("base"), turn.alias("t"))
    # one shuffle by the shared conversation serves the grouping and the join
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    heads = own.where("conv_id = base").select("base", F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    whole = F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    found = own.join(heads, "base", "left").select("conv_id", whole.alias("turns"))
    return found.select("conv_id", F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"]))).alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words"))


def ordered(a: np.ndarray, b: np.ndarray, starts: np.ndarray, sizes: np.ndarray, conv: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Rows in the order of their sequences, a prefix before what goes on, and conv; and the nodes.

    The sequence of row r is the pairs (a, b) from starts[r] on, sizes[r] of them. Nodes come as arrays for each
    depth from 1 on: (first row in the order, rows, smallest conv, any longer row, place of the last turn).
    """
    order, nodes = np.arange(len(sizes)), []
    active, offset = np.arange(len(sizes)), 0
    # where the active rows lie in the order, and the run of equal prefixes that each belongs to
    place, group = np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
    while len(active):
        width = int(min(TILE, max(sizes[active].max() - offset, 1)))
        at = starts[active][:, None] + offset + np.arange(width)
        there = offset + np.arange(width) < sizes[active][:, None]
        at = np.where(there, at, 0)
        high, low = (np.where(there, m[at] if len(m) else 0, 0) for m in (a, b))
        keys = [conv[active]]
        for j in range(width - 1, -1, -1):
            keys += [low[:, j], high[:, j], there[:, j]]
        by = np.lexsort([*keys, group])
        # rows change places only inside their group, whose places are consecutive
        active, high, low, there, group = active[by], high[by], low[by], there[by], group[by]
        order[place] = active
        new = np.ones(len(active), bool)
        new[1:] = group[1:] != group[:-1]
        changed = np.zeros((len(active), width), bool)
        changed[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1]) | (there[1:] != there[:-1])
        changed = np.logical_or.accumulate(np.concatenate([new[:, None], changed], axis=1), axis=1)[:, 1:]
        for j in range(width):
            first = np.flatnonzero(changed[:, j])
            n = np.diff(np.append(first, len(active)))
            real = there[first, j]
            longest = np.maximum.reduceat(sizes[active], first)
            least = np.minimum.reduceat(conv[active], first)
            row = active[first]
            nodes.append((place[first][real], n[real], least[real], longest[real] > offset + j + 1, (starts[row] + offset + j)[real]))
        on = sizes[active] > offset + width
        group = np.cumsum(changed[:, -1])[on]
        active, place = active[on], place[on]
        offset += width
    return order, nodes


def _path(a: np.ndarray, b: np.ndarray, start: int, size: int) -> list[bytes]:
    """Hashes of the prefixes of a sequence, the empty one first."""
    out = [hashlib.md5(b"").digest()]
    for x, y in zip(a[start : start + size].tolist(), b[start : start + size].tolist(), strict=True):
        out.append(hashlib.md5(out[-1] + x.to_bytes(8, "big", signed=True) + y.to_bytes(8, "big", signed=True)).digest())
    return out


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def shard_nodes(table: pa.Table, shard: int) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard's rows: closed ones whole, those that may go on elsewhere in parts."""
    conv = np.asarray(table.column("conv_id").combine_chunks())
    ids, words = table.column("ids").combine_chunks(), table.column("words").combine_chunks()
    sizes = np.asarray(words.value_lengths()).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.asarray(ids.flatten())
    a, b, words = flat[0::2], flat[1::2], np.asarray(words.flatten()).astype(np.int64)
    order, deeper = ordered(a, b, starts, sizes, conv)
    root = (np.array([0]), np.array([len(conv)]), np.array([conv.min()]), np.array([sizes.max() > 0]), np.array([-1]))
    parts = [root, *deeper]
    level = np.append(0, np.cumsum([len(p[0]) for p in parts]))
    depth = np.repeat(np.arange(len(parts)), np.diff(level))
    row, n, least, longer, last = (np.concatenate([p[i] for p in parts]) for i in range(5))
    pre = np.lexsort((depth, row))
    at = np.empty(len(pre), np.int64)  # the place in preorder of the nodes by depth and row
    at[pre] = np.arange(len(pre))

    row_by_level = row

    def covering(d: int, rows: np.ndarray) -> np.ndarray:
        """The nodes of depth d that hold the rows, in preorder."""
        return at[level[d] + np.searchsorted(row_by_level[level[d] : level[d + 1]], rows, side="right") - 1]

    depth, row, n, least, longer, last = (x[pre] for x in (depth, row, n, least, longer, last))
    total = len(depth)
    word = np.where(last >= 0, words[np.maximum(last, 0)] if len(words) else 0, 0)
    end = np.searchsorted(row, row + n)  # preorder: the first node that starts after the subtree's rows
    parent = np.full(total, -1)
    for d in range(1, len(parts)):
        parent[at[level[d] : level[d + 1]]] = covering(d - 1, row_by_level[level[d] : level[d + 1]])
    children = np.bincount(parent[1:], minlength=total)
    # members that end at a node are the first of its rows
    by_size = np.argsort(sizes[order], kind="stable")
    cut = np.searchsorted(sizes[order][by_size], np.arange(len(parts) + 1))
    ended = np.bincount(np.concatenate([covering(d, by_size[cut[d] : cut[d + 1]]) for d in range(len(parts))]), minlength=total)
    # open nodes: prefixes of the first and of the last row
    lists = [_path(a, b, int(starts[r]), int(sizes[r])) for r in (order[0], order[-1])]
    chains = [np.concatenate([covering(d, np.array([r])) for d in range(len(hashes))]) for r, hashes in zip((0, len(order) - 1), lists, strict=True)]
    is_open = np.zeros(total, bool)
    is_open[np.concatenate(chains)] = True
    saved = np.where(is_open, 0, (n - 1) * word)
    leaf = np.where(is_open, 0, ~longer).astype(np.int64)
    sums = lambda x: np.append(0, np.cumsum(x))[end] - np.append(0, np.cumsum(x))[:-1]
    saved, leaves = sums(saved), sums(leaf)
    open_children = np.bincount(parent[1:][is_open[1:]], minlength=total)
    ids_in_order = conv[order]
    closed = np.flatnonzero(~is_open)
    ends = [hashlib.sha256(_joined(ids_in_order[r : r + k]).encode()).hexdigest() if k else _EMPTY for r, k in zip(row[closed].tolist(), ended[closed].tolist(), strict=True)]
    under = is_open[parent[closed]]
    hash_of = {}
    for chain, hashes in zip(chains, lists, strict=True):
        hash_of.update(zip(chain.tolist(), hashes, strict=True))
    yield _rows(
        kind=np.where(under, PARENT_OPEN, CLOSED), shard=np.full(len(closed), shard), parent_hash=[hash_of[p] if u else None for p, u in zip(parent[closed].tolist(), under.tolist(), strict=True)], conv_id=least[closed], depth=depth[closed],
        parent_conv_id=least[parent[closed]], n_convs=n[closed], n_children=children[closed], n_leaves=leaves[closed], saved_tokens=saved[closed], ends=ends,
    )
    seen: set[int] = set()
    for side, (chain, hashes) in enumerate(zip(chains, lists, strict=True)):
        fresh = np.array([x not in seen for x in chain.tolist()])
        seen.update(chain.tolist())
        n_here, n_kids, n_leaves, n_saved = (np.where(fresh, x[chain], 0) for x in (n, children - open_children, leaves, saved))
        yield _rows(
            kind=np.full(len(chain), OPEN), shard=np.full(len(chain), shard), path=np.full(len(chain), 2 * shard + side), hash=hashes, parent_hash=[None, *hashes[:-1]], conv_id=least[chain], depth=depth[chain], n_convs=n_here,
            n_children=n_kids, n_leaves=n_leaves, saved_tokens=n_saved, words=word[chain], longer=longer[chain],
        )
        for node, h, new in zip(chain.tolist(), hashes, fresh.tolist(), strict=True):
            for lo in range(0, int(ended[node]) if new else 0, LIST_IDS):
                some = ids_in_order[row[node] + lo : row[node] + min(lo + LIST_IDS, int(ended[node]))]
                yield _rows(kind=[LIST], shard=[shard], hash=[h], part=[lo], ends=[_joined(some)])


def _rows(**columns) -> pa.RecordBatch:
    n = len(columns["kind"])
    kinds = {"binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}
    types = [kinds[f.strip().split(" ")[1]] for f in _OUT.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, types, strict=True)], names=_NAMES)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        yield from shard_nodes(pa.Table.from_batches(held), TaskContext.get().partitionId())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each hash's lists, joined by commas, as they come; one list is held at a time."""
    now, digest = None, None
    for batch in batches:
        done = []
        for h, ids in zip(batch.column("hash").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if h == now:
                digest.update(b"," + ids.encode())
                continue
            if now is not None:
                done.append((now, digest.hexdigest()))
            now, digest = h, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["hash", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["hash", "ends"])


def prefix_trie(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie_of(rebuilt(conversations, every, most))


def trie_of(convs: DataFrame) -> DataFrame:
    """The nodes of conversations given as conv_id (one row each), ids (two longs a turn) and words (a number a turn)."""
    spark = convs.sparkSession
    convs = checkpoint(convs)
    turns = convs.agg((F.sum(F.size("words")) + F.count("*")).alias("n")).first()["n"] or 0
    shards = max(1, -(-turns // SHARD_TURNS), min(shuffle_partitions(spark), -(-turns // LEAST_TURNS)))
    found = checkpoint(convs.repartitionByRange(shards, "ids", "conv_id").mapInArrow(_shards, _OUT))
    opened = found.where(F.col("kind") == OPEN)
    total = lambda c: F.sum(c).alias(c)
    nodes = checkpoint(
        opened.groupBy("hash").agg(
            F.max("parent_hash").alias("parent_hash"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.min("path").alias("home"), F.max("words").alias("words"), F.max("longer").alias("longer"),
            *[total(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        )
    )
    # what an open node adds to itself and to those above it counts on one path, its home
    own = nodes.select("hash", "home", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (~F.col("longer")).cast("long").alias("leaf"))
    upward = Window.partitionBy("path").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = lambda c: F.sum(F.when(F.col("home") == F.col("path"), F.col(c)).otherwise(0)).over(upward).alias(c)
    below = opened.select("path", "depth", "hash").join(own, "hash").select("hash", here("saved"), here("leaf")).groupBy("hash").agg(total("saved"), total("leaf"))
    kids = nodes.where("parent_hash is not null").groupBy(F.col("parent_hash").alias("hash")).agg(F.count("*").alias("kids"))
    above = nodes.select(F.col("hash").alias("parent_hash"), F.col("conv_id").alias("parent_conv_id"))
    lists = found.where(F.col("kind") == LIST).select("hash", "shard", "part", "ends")
    digests = lists.repartition("hash").sortWithinPartitions("hash", "shard", "part").select("hash", "ends").mapInArrow(_digests, "hash binary, ends string")
    none = lambda c: F.coalesce(c, F.lit(0))
    open_rows = nodes.join(below, "hash").join(kids, "hash", "left").join(above, "parent_hash", "left").join(digests, "hash", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("n_children") + none("kids")).alias("n_children"), (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends", F.lit(_EMPTY)).alias("ends"),
    )
    # a shard's nodes under an open one take its smallest conversation from the shard's own few open nodes
    names = opened.select("shard", F.col("hash").alias("parent_hash")).distinct().join(above, "parent_hash")
    under = found.where(F.col("kind") == PARENT_OPEN).drop("parent_conv_id").join(names, ["shard", "parent_hash"])
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    rows = found.where(F.col("kind") == CLOSED).select(*columns).unionByName(under.select(*columns)).unionByName(open_rows)
    return rows.withColumnRenamed("ends", "ends_sha256")
