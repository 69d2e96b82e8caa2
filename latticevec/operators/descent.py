"""A proximity graph without comparing all pairs: neighbours of neighbours are likely neighbours.

The rows are put in order along a few random directions, and in each order
windows of consecutive rows are searched exactly; the best of that is the first
graph. Then, round after round, the rows that have an edge to or from the same
row are compared with each other, unless both of these edges have been there
before, and what is nearer than a row's farthest neighbour takes its place. It
ends when few edges change.

A round's work and shuffle are in proportion to the edges. Rows that very many
edges lead to are taken in pieces of a bounded size, each with the row's own edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticevec.functions.vec import matrix_of, nearest_in_block, total, usable, vector
from latticevec.lineage import checkpoint
from latticevec.operators.knn import RESULT, adjacency, ranked

#: Rows of a window that is searched exactly; half of it is in the next one.
WINDOW = 512
#: Edges to a row that are taken at once, and rows that a task's group holds, on average.
PIECE, GROUP_ROWS = 64, 16_384


def _first(rows: DataFrame, directions: np.ndarray, degree: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, max(1, batch.num_rows - WINDOW // 2), WINDOW // 2):
                ids, x = batch.column("id").to_numpy()[a : a + WINDOW], matrix_of(batch.column("vec").slice(a, WINDOW))
                d, near = nearest_in_block(x, x, ids, degree, ids)
                row, col = np.nonzero(near >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(near[row, col]), pa.array(d[row, col])], ["qid", "id", "dist"])

    def ordered(direction: np.ndarray) -> DataFrame:
        along = total(F.zip_with("vec", vector(direction), lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))))
        return rows.withColumn("at", along).repartitionByRange("at", "id").sortWithinPartitions("at", "id").select("id", "vec")

    return reduce(DataFrame.unionByName, [ordered(d).mapInArrow(search, RESULT) for d in directions])


def _compared(table: pa.Table, degree: int) -> pa.Table:
    """(qid, id, dist): what is nearer than a row's farthest neighbour among those that share a centre with it."""
    columns = [table.column(c).to_numpy() for c in ("centre", "piece", "id")]
    order = np.lexsort((columns[2], columns[1], columns[0]))
    centre, piece, ids = (c[order] for c in columns)
    x, fresh, bound = matrix_of(table.column("vec"))[order], table.column("fresh").to_numpy(zero_copy_only=False)[order], table.column("bound").to_numpy()[order]
    begin = np.flatnonzero(np.append(True, (centre[1:] != centre[:-1]) | (piece[1:] != piece[:-1])))
    made: list[list[np.ndarray]] = [[], [], []]
    for a, b in zip(begin, np.append(begin[1:], len(centre)), strict=True):
        mine, at = np.unique(ids[a:b], return_index=True)
        new, y, far = np.logical_or.reduceat(fresh[a:b], at), x[a:b][at], bound[a:b][at]
        if not new.any() or len(mine) < 2:
            continue
        d = ((y[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)
        d[~(new[:, None] | new[None, :]) | np.eye(len(mine), dtype=bool) | (d >= far[:, None])] = np.inf
        if len(mine) > degree:
            d[d > np.partition(d, degree - 1, axis=1)[:, degree - 1 : degree]] = np.inf
        row, col = np.nonzero(np.isfinite(d))
        for out, part in zip(made, (mine[row], mine[col], d[row, col]), strict=True):
            out.append(part)
    kinds = (np.int64, np.int64, np.float64)
    return pa.table({name: np.concatenate([np.zeros(0, kind), *parts]) for name, kind, parts in zip(("qid", "id", "dist"), kinds, made, strict=True)})


def _round(rows: DataFrame, graph: DataFrame, degree: int, n_edges: int) -> DataFrame:
    """The graph of (qid, id, dist, rank, fresh) after one round; the edges that it finds are fresh."""
    full = F.when(F.count(F.lit(1)) >= degree, F.max("dist")).otherwise(F.lit(float("inf")))
    held = rows.join(graph.groupBy(F.col("qid").alias("id")).agg(full.alias("bound")), "id", "left").select("id", "vec", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    pieces = graph.groupBy(F.col("id").alias("centre")).agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    own = graph.select(F.col("qid").alias("centre"), "id", "fresh").join(pieces, "centre", "left")
    own = own.select("centre", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"), "id", "fresh")
    others = graph.select(F.col("id").alias("centre"), F.col("qid").alias("id"), "fresh").join(pieces, "centre")
    others = others.select("centre", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), "id", "fresh")
    groups = -(-2 * n_edges // GROUP_ROWS)
    members = own.unionByName(others).join(held, "id").withColumn("g", F.pmod(F.xxhash64("centre", "piece"), F.lit(groups)))
    found = members.groupBy("g").applyInArrow(lambda table: _compared(table, degree), RESULT)
    both = graph.select("qid", "id", "dist", F.lit(False).alias("fresh")).unionByName(found.withColumn("fresh", F.lit(True)))
    return ranked(both.groupBy("qid", "id").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh")), degree)


def descent_graph(base: DataFrame, degree: int, directions: int = 4, rounds: int = 12, least: float = 0.002, seed: int = 7, id: str = "id", vec: str = "vec") -> DataFrame:
    """(id, neighbors): about the ``degree`` nearest other rows of each row, nearest first.

    It ends after ``rounds``, or when no more than ``least`` of all edges change
    in one. Ids must not be negative and are unique. Rows without an id, and
    those whose vector is null or has a component that is null or not finite,
    have no part in the graph; short vectors go on with zeros. Up to as many
    rows as a window holds, in one partition, it is the exact graph but for ties.
    """
    rows = checkpoint(base.where(F.col(id).isNotNull() & usable(F.col(vec))).select(F.col(id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")))
    dim = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    # Each row has the longest one's length, so that batches are even.
    rows = rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vec"))))
    found = _first(rows, np.random.default_rng(seed).standard_normal((directions, dim)), degree).withColumn("fresh", F.lit(True))
    graph = checkpoint(ranked(found.groupBy("qid", "id").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh")), degree))
    n_edges = graph.count()
    for _ in range(rounds if n_edges else 0):
        graph = checkpoint(_round(rows, graph, degree, n_edges))
        if graph.where("fresh").count() <= least * n_edges:
            break
    return adjacency(graph.select(F.col("qid").alias("id"), "rank", F.col("id").alias("neighbor")))
