r"""MinHash near-dedup: a chosen-path set-similarity join over word shingles.

Documents with equal shingle sets are one class. Each class enters TREES independent trees at the node of
one minwise token. A node of up to SMALL classes is compared exhaustively; a larger one is branched: each
class goes on to two children named by further minwise tokens that the node selects, until nodes are
small. Two sets of similarity 0.75 meet in one tree with probability 0.75, or at least 0.66 however often
nodes are branched (with two children, 0.89 of such pairs go on for ever), and so in one of ten with over
0.9999; more similar ones almost surely.

A large child that keeps more than CROWD of its node's classes is a crowd: sets so alike that tokens don't
part them. It is dealt into blocks, each with the same pivots, so the members of a group of near copies
meet a pivot or each other at linear cost; what is then outside the crowd's largest part meets all of its
members. So every pair across parts of a crowd is compared too.

Nodes are compared by sketches. Each shingle that only one set holds spoils one bin at most, and sets at
the threshold have at most (|A| + |B|) / 7 of them, so pairs with more spoilt bins are no links: this loses
nothing. Only pairs of 7 * BINS shingles together or more, for which that says nothing, are judged by the
estimate (six standard deviations under the threshold). Similar pairs make candidate components.

Candidates are confirmed on full sets, component by component. A large component is cut into blocks: each
block meets the first one, and then what is outside the component's largest confirmed part meets every
block. Within a task too, a class is compared with all others at once, and only classes outside the largest
part are asked. So every pair across parts is compared, no pair is ever sent, and a group of copies costs linear work.

Words are `[^\x20\x09-\x0D]+` after lower-casing A-Z. A document's set: distinct 5-word shingles; with
fewer words the whole sequence as one; without words none, and it links with nothing.

Defined results: null texts count as empty. Every row comes out; rows that repeat an id are one node,
at which the links of all their sets meet. A null id links with nothing and has a null component. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import checkpoint, group_bounds, local_components, mix, shingle_sets, shuffle_partitions, slices, utf8
from lucerna.llm.components import connected_components

#: Trees, most classes of a node that is compared whole, and the share of its node that makes a large child a crowd.
TREES, SMALL, CROWD = 10, 512, 0.6
#: One-permutation minwise sketch: bins, and the estimate below which a pair of large sets isn't confirmed.
BINS, FAR = 128, 0.52
#: Pivots in every block of a crowd, and rows whose sketches are compared at once.
PIVOTS, AT_ONCE = 64, 1024
#: Rows of large nodes that a task branches, where that makes few tasks.
BRANCHED = 8192
#: Bytes of text whose shingles are made at once: a byte takes some hundred bytes of arrays.
TEXT_BYTES = 1 << 19
#: Classes and characters in a block of exact comparison, and characters of small components compared at once.
BLOCK, BLOCK_CHARS, BUCKET_CHARS = 512, 8 << 20, 1 << 20
_EDGES = (np.arange(BINS + 1, dtype=object) * (2**64 // BINS)).tolist()
_EDGES = np.array([min(e, 2**64 - 1) for e in _EDGES], np.uint64)


def _sketch(h: np.ndarray) -> bytes:
    """First (least) hash of each bin of a sorted set, as 16 bits; 0 for an empty bin."""
    at = np.searchsorted(h, _EDGES[:-1])
    end = np.append(at[1:], len(h))
    full = at < end
    out = np.zeros(BINS, np.uint16)
    out[full] = ((h[at[full]] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    return out.tobytes()


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BINS)


def _reader(width: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id")
            for lo, hi in slices(offsets, TEXT_BYTES):
                h, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                digest, sketch, tokens = [], [], np.zeros((hi - lo, TREES), np.int64)
                full = np.flatnonzero(np.diff(at))
                for t in range(TREES):
                    if len(full):
                        tokens[full, t] = np.minimum.reduceat(mix(h ^ np.uint64((t + 1) * 0x632BE59BD9B4E019 % 2**64)), at[full]).view(np.int64)
                for i in range(hi - lo):
                    one = h[at[i] : at[i + 1]]
                    digest.append(xxhash.xxh3_128_digest(one.tobytes()) if len(one) else None)
                    sketch.append(_sketch(one) if len(one) else None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * TREES, pa.int32()), pa.array(tokens.ravel()))],
                    names=["doc_id", "text_hash", "n_shingles", "digest", "sketch", "tokens"],
                )

    return read


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two children of each class of a large node. A child is named by the sketch's first full bin from a
    place that the node selects: a minwise token, equal for two sets with the chance of their similarity."""
    for batch in batches:
        node, sketch = np.asarray(batch.column("node")), _sketches(batch.column("sketch"))
        children = []
        for salt in (1, 2):
            chosen = mix(node.view(np.uint64) ^ np.uint64(salt * 0x632BE59BD9B4E019))
            places = ((chosen % np.uint64(BINS)).astype(np.int64)[:, None] + np.arange(BINS)) % BINS
            tokens = np.take_along_axis(sketch, places, 1)
            step = (tokens != 0).argmax(1)
            token = tokens[np.arange(len(node)), step].astype(np.uint64) << np.uint64(8) | step.astype(np.uint64)
            children.append(mix(chosen + mix(token)).view(np.int64))
        twice = lambda name: pa.concat_arrays([batch.column(name)] * 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(children)), twice("rep"), twice("n")], names=["node", "rep", "parent"])


def _alike(a: np.ndarray, b: np.ndarray, together: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of sketches of sets with so many shingles together may be links."""
    either = ((a != 0) | (b != 0)).sum(-1)
    agree = ((a == b) & (a != 0)).sum(-1)
    allowed = (100 - percent) * together
    return np.where(allowed < (100 + percent) * BINS, (100 + percent) * (either - agree) <= allowed, agree >= FAR * either)


def _near(sketches: np.ndarray, sizes: np.ndarray, percent: int = 75) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that may be links by their sketches."""
    us, vs = [], []
    for i in range(len(sketches) - 1):
        j = np.flatnonzero(_alike(sketches[i], sketches[i + 1 :], sizes[i] + sizes[i + 1 :], percent)) + i + 1
        us.append(np.full(len(j), i))
        vs.append(j)
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, int), np.zeros(0, int))


def _comparer(percent: int):
    def compare(table: pa.Table) -> pa.Table:
        """Links that span the similar pairs of each of a bucket's nodes, which the bucket holds whole."""
        table = table.sort_by([("node", "ascending"), ("rep", "ascending")]).combine_chunks()
        node, rep, sizes = (np.asarray(table.column(k)) for k in ("node", "rep", "size"))
        sketches = _sketches(table.column("sketch"))
        bounds = group_bounds([node])
        held = np.diff(bounds)
        x = bounds[:-1][held == 2]
        x = x[_alike(sketches[x], sketches[x + 1], sizes[x] + sizes[x + 1], percent)]
        us, vs = [rep[x]], [rep[x + 1]]
        for s, n in zip(bounds[:-1][held > 2].tolist(), held[held > 2].tolist(), strict=True):
            u, v = _near(sketches[s : s + n], sizes[s : s + n], percent)
            if len(u):
                u, v = local_components(rep[s + u], rep[s + v])
                us.append(u[u != v])
                vs.append(v[u != v])
        u, v = np.concatenate(us), np.concatenate(vs)
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return compare


def _forest(h: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (100 * common >= percent * union) that span the exact components of some sets.

    The pass for a row compares it with all rows at once; rows outside the largest component known so
    far are asked until none is left, so every pair across components has had its pass.
    """
    n, sizes = len(at) - 1, np.diff(at)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    group = np.cumsum(np.append(False, h[1:] != h[:-1]))
    starts = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
    by_row = np.argsort(owner, kind="stable")
    label, asked, us, vs = np.arange(n), np.zeros(n, bool), [], []
    while True:
        count = np.bincount(label, minlength=n)
        left = np.flatnonzero(~asked & (label != count.argmax()))
        if len(left) == 0 and (asked.any() or n < 2):
            break
        x = left[0] if len(left) else 0
        asked[x] = True
        mine = group[by_row[at[x] : at[x + 1]]]
        lens = starts[mine + 1] - starts[mine]
        first = np.cumsum(lens) - lens
        where = np.arange(int(lens.sum())) - np.repeat(first, lens) + np.repeat(starts[mine], lens)
        common = np.bincount(owner[where], minlength=n)
        near = np.flatnonzero(100 * common >= percent * (sizes + sizes[x] - common))
        near = near[label[near] != label[x]]
        if len(near):
            us.append(np.full(len(near), x))
            vs.append(near)
            low = min(label[x], label[near].min())
            label[np.isin(label, np.append(label[near], label[x]))] = low
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, int), np.zeros(0, int))


def _confirmer(width: int, percent: int):
    def confirm(table: pa.Table) -> pa.Table:
        """Links of a bucket's groups (comp, i, j), each of which the bucket holds whole."""
        keys = ["comp", "i", "j"]
        table = table.sort_by([(k, "ascending") for k in [*keys, "rep"]]).combine_chunks()
        rep = np.asarray(table.column("rep"))
        bounds = group_bounds([np.asarray(table.column(k)) for k in keys])
        data, offsets = utf8(table.column("text"))
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            sets, at = [], [0]
            mine = offsets[s : e + 1]
            for lo, hi in slices(mine, TEXT_BYTES):
                h, o = shingle_sets(data[mine[lo] : mine[hi]], mine[lo : hi + 1] - mine[lo], width)
                sets.append(h)
                at.extend((o[1:] + at[-1]).tolist())
            u, v = _forest(np.concatenate(sets), np.array(at), percent)
            us.append(rep[s + u])
            vs.append(rep[s + v])
        return pa.table({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return confirm


def _own_exchange(key: str) -> Column:
    """The key, by a no-op: both sides of a join keep exchanges of their own, which Spark may split."""
    return F.col(key).bitwiseXOR(F.lit(0).cast("long"))


def _dealt(side: DataFrame) -> DataFrame:
    """The side of a join that is dealt by key: Spark would send one that looks small through the driver, some thirty times a run."""
    return side.hint("merge")


def _blocks(count: Column, size: int) -> Column:
    return F.greatest(F.ceil(count / size), F.lit(1)).cast("long")


def _all_below(count: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), count - 1)


def _bucketed(rows: DataFrame, key: Column, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(key, F.lit(max(1, buckets))))


def _tasks(count: int, a_task: int) -> int:
    return max(1, -(-count // a_task))


def _gathered(rows: DataFrame, count: int, a_task: int) -> DataFrame:
    """Few rows in as few tasks as their number asks for: a Python task costs some 70 ms, also an empty one."""
    tasks = _tasks(count, a_task)
    return rows.repartition(tasks) if 4 * tasks <= shuffle_partitions(rows.sparkSession) else rows


def _meeting(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that span the similar pairs of the nodes of rows (node, rep).

    Grouping by bucket is what Spark must honour: a node's rows are in one bucket, and a bucket in one task."""
    held = rows.join(_dealt(sets.select(F.col("rep").alias("k"), "sketch", "size")), F.col("rep") == F.col("k")).drop("k")
    return _bucketed(held, F.xxhash64("node"), -(-rows.count() // AT_ONCE)).groupBy("bucket").applyInArrow(_comparer(percent), "u long, v long")


def _trees(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Small nodes of two classes or more, and crowds, as (node, rep); crowds merged, with their size n."""
    nodes = sets.select("rep", F.posexplode("tokens").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "rep", F.lit(None).cast("long").alias("parent"))
    small, crowds, left = [], [], 0
    while True:  # nodes that go on have at most CROWD of their parents' classes
        counts = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select(_own_exchange("node").alias("k"), "n")
        joined = nodes.join(_dealt(counts), F.col("node") == F.col("k")).select("node", "rep", "n", "parent")
        sized = checkpoint(joined.coalesce(_tasks(2 * left, BRANCHED)) if left else joined)  # children of few rows: few tasks here and in all that reads them
        small.append(sized.where(F.col("n") <= SMALL).select("node", "rep"))
        stuck = F.coalesce(F.col("n") > CROWD * F.col("parent"), F.lit(False))
        big = sized.where(F.col("n") > SMALL)
        crowds.append(big.where(stuck).select("node", "rep"))
        big = big.where(~stuck)
        left = big.count()
        if not left:
            break
        drawn = big.join(_dealt(sets.select(F.col("rep").alias("k"), "sketch")), F.col("rep") == F.col("k")).select("node", "rep", "n", "sketch")
        nodes = checkpoint(_gathered(drawn, left, BRANCHED).mapInArrow(_branch, "node long, rep long, parent long"))  # read twice: counted and sized
    union = lambda dfs: dfs[0] if len(dfs) == 1 else union([dfs[0].unionByName(dfs[1]), *dfs[2:]])
    return union(small), _merged(union(crowds))


def _merged(crowds: DataFrame) -> DataFrame:
    """Crowds (node, rep) of nearly the same classes as one, with their size n.

    A group of near copies is a crowd in each tree and in both children. Crowds are one if two minwise hashes of
    their members agree; their union holds every pair that one of them holds.
    """
    least = lambda salt: F.min(F.xxhash64(F.lit(salt), "rep"))
    names = crowds.groupBy("node").agg(F.xxhash64(least(1), least(2)).alias("name")).select(_own_exchange("node").alias("k"), "name")
    members = checkpoint(crowds.join(_dealt(names), F.col("node") == F.col("k")).select(F.col("name").alias("node"), "rep").distinct())
    sizes = members.groupBy("node").agg(F.count("*").alias("n")).select(_own_exchange("node").alias("k"), "n")
    return checkpoint(members.join(_dealt(sizes), F.col("node") == F.col("k")).select("node", "rep", "n"))


def _crowd_blocks(crowds: DataFrame) -> DataFrame:
    """A crowd's members in blocks of about SMALL, each with the same pivots."""
    size, block = _blocks(F.col("n"), SMALL - PIVOTS), lambda b: F.xxhash64("node", b)
    own = crowds.select(block(F.pmod(F.xxhash64("rep"), size)).alias("node"), "rep")
    pivots = crowds.where(F.pmod(F.xxhash64("rep", "node"), _blocks(F.col("n"), PIVOTS)) == 0)
    return own.unionByName(pivots.select("node", "rep", F.explode(_all_below(size)).alias("b")).select(block(F.col("b")).alias("node"), "rep")).distinct()


def _outside(members: DataFrame, key: str, size: int) -> DataFrame:
    """key, its largest part, and the number of blocks of `size` of what is outside it, where anything is."""
    top = members.groupBy(key, "part").agg(F.count("*").alias("m")).groupBy(key).agg(F.max(F.struct("m", "part")).alias("top"), F.sum("m").alias("all")).where("all > top.m")
    return top.select(_own_exchange(key).alias("k"), F.col("top.part").alias("largest"), _blocks(F.col("all") - F.col("top.m"), size).alias("asked"))


def _mine(count: Column) -> Column:
    return F.pmod(F.xxhash64("rep"), count)


def _crowd_rest(crowds: DataFrame, parts: DataFrame) -> DataFrame:
    """Blocks in which what is outside a crowd's largest part meets all members of the crowd."""
    half = SMALL // 2
    placed = checkpoint(crowds.join(_dealt(parts), "rep", "left").withColumn("part", F.coalesce("part", "rep")))
    met = placed.join(_dealt(_outside(placed, "node", half)), F.col("node") == F.col("k")).withColumn("blocks", _blocks(F.col("n"), half))
    ask = met.where("part <> largest").select("node", "rep", _mine(F.col("asked")).alias("i"), F.explode(_all_below(F.col("blocks"))).alias("j"))
    told = met.select("node", "rep", F.explode(_all_below(F.col("asked"))).alias("i"), _mine(F.col("blocks")).alias("j"))
    return ask.unionByName(told).select(F.xxhash64("node", "i", "j").alias("node"), "rep").distinct()


def _parts(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("node").alias("rep"), F.col("component").alias("part"))


def _confirmed(groups: DataFrame, rows: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """Links on full sets that span the components of the candidate components `groups` (rep, part)."""
    wanted = sets.select("rep", "rep_hash").join(_dealt(groups), "rep")
    texts = rows.join(_dealt(wanted), (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).groupBy("rep", "rep_hash").agg(F.first("part").alias("comp"), F.first("text").alias("text"))
    texts = checkpoint(texts.withColumn("size", F.length("text").cast("long")))
    blocks = F.greatest(_blocks(F.count("*"), BLOCK), _blocks(F.sum("size"), BLOCK_CHARS)).alias("blocks")
    sizes = texts.groupBy("comp").agg(blocks).select(_own_exchange("comp").alias("k"), "blocks")
    members = texts.join(_dealt(sizes), F.col("comp") == F.col("k")).select("rep", "comp", "blocks", _mine(F.col("blocks")).alias("own"), "text", "size")
    buckets = -(-(texts.agg(F.sum("size")).first()[0] or 0) // BUCKET_CHARS)

    def links(grouped: DataFrame) -> DataFrame:
        small = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(max(1, buckets))))
        bucketed = grouped.withColumn("bucket", F.coalesce(small, F.xxhash64("comp", "i", "j"))).select("bucket", "comp", "i", "j", "rep", "text")
        return checkpoint(bucketed.groupBy("bucket").applyInArrow(_confirmer(width, percent), "u long, v long"))

    # every block with block 0; that settles small components, and large ones whose members are alike
    zero = F.lit(0).cast("long")
    sure = links(members.select("comp", "blocks", zero.alias("i"), F.explode(F.when(F.col("own") == 0, _all_below(F.col("blocks"))).otherwise(F.array("own"))).alias("j"), "rep", "text"))
    large = members.where("blocks > 1")
    if large.isEmpty():
        return sure
    placed = checkpoint(large.select("rep", "comp", "blocks", "own").join(_dealt(_parts(sure)), "rep", "left").withColumn("part", F.coalesce("part", "rep")))
    met = placed.join(_dealt(_outside(placed, "comp", BLOCK)), F.col("comp") == F.col("k")).drop("k")
    ask = met.where("part <> largest").select("comp", "rep", _mine(F.col("asked")).alias("i"), F.explode(_all_below(F.col("blocks"))).alias("j"))
    told = met.select("comp", "rep", F.explode(_all_below(F.col("asked"))).alias("i"), F.col("own").alias("j"))
    again = ask.unionByName(told).distinct().join(_dealt(large.select(F.col("rep").alias("k"), "blocks", "text")), F.col("rep") == F.col("k")).drop("k")
    return sure.unionByName(links(again))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    read = checkpoint(rows.mapInArrow(_reader(width), "doc_id long, text_hash long, n_shingles long, digest binary, sketch binary, tokens array<long>"))
    named = read.where("doc_id is not null and digest is not null")
    sets = checkpoint(
        named.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("sketch").alias("sketch"), F.first("tokens").alias("tokens"), F.first("n_shingles").alias("size"))
        .select("digest", F.col("least.doc_id").alias("rep"), F.col("least.text_hash").alias("rep_hash"), "sketch", "tokens", "size")
    )
    small, crowds = _trees(sets)
    similar = checkpoint(_meeting(small.unionByName(checkpoint(_crowd_blocks(crowds))), sets, percent))
    groups = _parts(similar)
    if not crowds.isEmpty():
        rest = checkpoint(_crowd_rest(crowds, groups))
        if not rest.isEmpty():
            groups = _parts(checkpoint(similar.unionByName(_meeting(rest, sets, percent))))
    links = _confirmed(groups, rows, sets, width, percent)
    # an id that repeats joins the classes of its texts
    repeated = named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id"))
    of_one = named.join(_dealt(repeated), F.col("doc_id") == F.col("id")).select("doc_id", "digest").join(_dealt(sets.select("digest", "rep")), "digest")
    least = of_one.groupBy("doc_id").agg(F.min("rep").alias("v")).select(_own_exchange("doc_id").alias("k"), "v")
    links = checkpoint(links.unionByName(of_one.join(_dealt(least), F.col("doc_id") == F.col("k")).where("rep <> v").select(F.col("rep").alias("u"), "v").distinct()))
    parts = _parts(links)
    found = checkpoint(sets.select("digest", "rep").join(_dealt(parts), "rep", "left").select("digest", F.coalesce("part", "rep").alias("component")))
    out = read.select("doc_id", "n_shingles", "digest").join(_dealt(found), "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
