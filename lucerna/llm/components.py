"""Connected components of a large link table by local contraction and pointer jumping.

A round deals the links by their larger end, joins up what meets in a task (so each task's links become
a forest), and then lets every node point past its parent to the parent's least parent. The jump is a join
whose hot side Spark can split, and its other side a grouped minimum, so a node that very many others
point to stays no single task's work. Nothing goes to the driver but the links' number and whether a round
settled. Up to FEW links, counted first, are joined up by one task in one round: dealing them out would cost
three rounds of tasks that hold nearly nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import checkpoint, local_components, shuffle_partitions

#: Links that a task joins up at once; what is left apart meets in a later round.
AT_ONCE = 1 << 20
#: Links (4 MB) up to which one task joins up all; any more are dealt.
FEW = 1 << 18


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def forest(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        node, root = local_components(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        below = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[below]), pa.array(root[below])], names=["u", "v"])

    held, size = [], 0
    for batch in batches:
        held.append((np.asarray(batch.column("u")), np.asarray(batch.column("v"))))
        size += batch.num_rows
        if size >= AT_ONCE:
            yield forest(held)
            held, size = [], 0
    if size:
        yield forest(held)


def _settled(edges: DataFrame) -> bool:
    """Whether every linked node has one parent and no parent has one."""
    end = lambda c, child: edges.select(F.col(c).alias("node"), F.lit(child).alias("child"), F.lit(1 - child).alias("parent"))
    ends = end("u", 1).unionByName(end("v", 0))
    return ends.groupBy("node").agg(F.sum("child").alias("children"), F.max("parent").alias("parent")).where("children + parent > 1").isEmpty()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: two long columns. Returns (node, component): each linked node and the smallest reachable.

    Self-links and nulls are dropped; a node without links isn't in the result.
    """
    n = shuffle_partitions(links.sparkSession)
    a, b = links.columns[:2]
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    few = edges.count() <= FEW
    for _ in range(0 if few else most_rounds):
        edges = checkpoint(edges.repartition(n, "u").mapInArrow(_contract, "u long, v long"))
        if _settled(edges):
            break
        # the no-op on the key keeps both sides of the join behind exchanges of their own, and neither goes through the driver
        above = edges.groupBy("u").agg(F.min("v").alias("top")).select(F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("k"), "top")
        edges = edges.join(above.hint("merge"), F.col("v") == F.col("k"), "left").select("u", F.coalesce("top", "v").alias("v"))
    else:
        if not few:
            raise RuntimeError("components did not settle")
        edges = checkpoint(edges.repartition(1).mapInArrow(_contract, "u long, v long"))
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
