"""Connected components over an edge table, without a node or component on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticevec.llm.common import checkpoint, join_facts

#: Edges that one task joins at most (16 bytes each); more are contracted first.
TASK_EDGES = 100_000


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a and b in place; a label is the least index of its set."""
    while True:
        x, y = label[a], label[b]
        if (differ := x != y).any():
            np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
            while (deeper := label[label]) is not None and (deeper != label).any():
                label[:] = deeper
        else:
            return


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of at most TASK_EDGES edges."""
    parts = [np.stack([batch.column(k).to_numpy() for k in (0, 1)]) for batch in batches if batch.num_rows]
    if parts:
        nodes, ends = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
        label = np.arange(len(nodes))
        merge_labels(label, *ends.reshape(2, -1))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "root"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node with an edge to another one.

    While edges are many, each round maps every node to the neighbour, or itself, that comes first in
    a fresh pseudo-random order, and relabels the edges. An edge stays an edge
    between the images of its ends, so components stay whole, and a constant
    part of the nodes goes in each round whatever the shape of the graph. When no
    more than TASK_EDGES are left, one task joins them. Nulls and loops are
    ignored; repeated edges count once.
    """
    now = edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"))
    now = checkpoint(now.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct())
    maps: list[DataFrame] = []
    while now.count() > TASK_EDGES:
        order = lambda c, n=len(maps): F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("p"), F.col(c).alias("n"))
        both = now.select(F.col("a").alias("node"), order("b").alias("x")).unionAll(now.select(F.col("b"), order("a")))
        first = both.groupBy("node").agg(F.min("x").alias("x"))
        step = checkpoint(first.select("node", F.least(order("node"), F.col("x"))["n"].alias("root")))
        maps.append(step)
        # A node can have a large part of all edges; such are joined by broadcast.
        for end in ("a", "b"):
            ends = now.groupBy(end).agg(F.count(F.lit(1)).alias("weight")).withColumnRenamed(end, "node").join(step, "node")
            facts = checkpoint(ends.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"), "weight"))
            now = join_facts(now, facts, end, "b" if end == "a" else "a")
        now = checkpoint(now.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    out = now.coalesce(1).mapInArrow(_joined, "node long, root long")
    while maps:
        step = maps.pop()
        mapped = step.groupBy("root").agg(F.count(F.lit(1)).alias("weight"))
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        facts = checkpoint(mapped.join(later, "root", "left").select("root", "weight", F.coalesce("last", "root").alias("last")))
        out = join_facts(step, facts, "root", "node").select("node", F.col("last").alias("root"))
    return out
