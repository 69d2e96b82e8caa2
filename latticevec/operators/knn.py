"""Exact nearest neighbours, proximity graphs and walks over them, as DataFrames.

A table of vectors has an id and an array column. Distances are squared
Euclidean, in double precision; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticevec.functions.vec import matrix_of, merged, nearest_in_block, squared_l2, usable

#: Bytes of queries that are broadcast at most; beyond that, queries and base rows meet in blocks.
BROADCAST_BYTES = 64_000_000
QUERY_BLOCK, BASE_BLOCK = 4096, 32_768
RESULT = "qid long, id long, dist double"


def ranked(pairs: DataFrame, k: int, by: str = "qid", *order: Column) -> DataFrame:
    """The first k rows of each group, with their rank from 1."""
    w = Window.partitionBy(by).orderBy(*(order or (F.col("dist"), F.col("id"))))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def as_rows(qids: np.ndarray, d: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """(qid, id, dist) of (query, k) distances and ids; places without a row are left out."""
    row, col = np.nonzero(ids >= 0)
    return pa.RecordBatch.from_arrays([pa.array(qids[row], pa.int64()), pa.array(ids[row, col], pa.int64()), pa.array(d[row, col], pa.float64())], ["qid", "id", "dist"])


def exact_knn(base: DataFrame, queries: DataFrame, k: int, dims: int | None = None, skip_self: bool = False, id: str = "id", vec: str = "vec", qid: str = "qid", qvec: str = "vec") -> DataFrame:
    """(qid, rank, id, dist): the k nearest base rows of each query, by its first ``dims`` components or all.

    With ``skip_self`` the row of the query's own id is no answer. Ids must not
    be negative. Rows and queries without an id, and those whose vector is null
    or has a component that is null or not finite, take no part; short vectors
    go on with zeros. Few queries are broadcast, after their size is known, and
    the base is read where it lies; many meet the base in blocks.
    """
    rows = base.where(F.col(id).isNotNull() & usable(F.col(vec))).select(F.col(id).cast("long").alias("id"), F.col(vec).alias("vec"))
    asked = queries.where(F.col(qid).isNotNull() & usable(F.col(qvec))).select(F.col(qid).cast("long").alias("qid"), F.col(qvec).alias("vec"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("m")).first()
    if 8 * (size["m"] + size["n"]) <= BROADCAST_BYTES:
        return ranked(_by_broadcast(rows, asked, k, dims, skip_self), k).select("qid", "rank", "id", "dist")
    return ranked(_by_blocks(rows, asked, size["n"], k, dims, skip_self), k).select("qid", "rank", "id", "dist")


def _by_broadcast(rows: DataFrame, asked: DataFrame, k: int, dims: int | None, skip_self: bool) -> DataFrame:
    table = asked.toArrow()  # at most BROADCAST_BYTES
    shared = rows.sparkSession.sparkContext.broadcast((table.column("qid").to_numpy(), matrix_of(table.column("vec"), dims)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        best, who = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
        for batch in batches:
            if batch.num_rows and len(q):
                found = nearest_in_block(q, matrix_of(batch.column("vec"), dims), batch.column("id").to_numpy(), k, qids if skip_self else None)
                best, who = merged(best, who, *found)
        yield as_rows(qids, best, who)

    # Each partition gives k rows for each query, so there are a few partitions for each core, however many files there are.
    return rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(scan, RESULT)


def _by_blocks(rows: DataFrame, asked: DataFrame, n_asked: int, k: int, dims: int | None, skip_self: bool) -> DataFrame:
    n_q, n_b = -(-n_asked // QUERY_BLOCK), max(1, -(-rows.count() // BASE_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("q", F.pmod(F.xxhash64("qid"), F.lit(n_q)).cast("int")).withColumn("b", every(n_b))
    right = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n_b)).cast("int")).withColumn("q", every(n_q))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        qids = a.column("qid").to_numpy()
        d, ids = nearest_in_block(matrix_of(a.column("vec"), dims), matrix_of(b.column("vec"), dims), b.column("id").to_numpy(), k, qids if skip_self else None)
        return pa.Table.from_batches([as_rows(qids, d, ids)])

    return left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(meet, RESULT)


def knn_graph(base: DataFrame, degree: int, dims: int | None = None, id: str = "id", vec: str = "vec") -> DataFrame:
    """(id, neighbors): the exact graph of the ``degree`` nearest other rows, nearest first."""
    found = exact_knn(base, base, degree, dims, True, id, vec, id, vec)
    return adjacency(found.select(F.col("qid").alias("id"), "rank", F.col("id").alias("neighbor")))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbors) of (id, rank, neighbor)."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "neighbor")))
    return edges.groupBy("id").agg(F.transform(pairs, lambda p: p["neighbor"]).alias("neighbors"))


def graph_edges(graph: DataFrame, nodes: int | None = None) -> DataFrame:
    """(id, rank, neighbor) of a graph; ``nodes`` is the id that stands for no edge, and all from it on are dropped."""
    edges = graph.select("id", F.posexplode("neighbors").alias("p", "neighbor")).select("id", (F.col("p") + 1).alias("rank"), F.col("neighbor").cast("long").alias("neighbor"))
    return edges if nodes is None else edges.where(F.col("neighbor") < nodes)


def in_degree(edges: DataFrame) -> DataFrame:
    """(id, in_degree) of each node that an edge leads to."""
    return edges.groupBy(F.col("neighbor").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


def expand(frontier: DataFrame, edges: DataFrame, visited: DataFrame) -> DataFrame:
    """(qid, id): the neighbours of (qid, id) in the frontier that are not in visited, each once."""
    reached = frontier.join(edges, "id").select("qid", F.col("neighbor").alias("id")).distinct()
    return reached.join(visited, ["qid", "id"], "left_anti")


def score(pairs: DataFrame, base: DataFrame, queries: DataFrame, dims: int | None = None) -> DataFrame:
    """(qid, id, dist) of (qid, id): the distances between the named rows of (id, vec) and (qid, vec)."""
    cut = lambda c: F.col(c) if dims is None else F.slice(c, 1, dims)
    x = base.select("id", cut("vec").alias("__x"))
    q = queries.select("qid", cut("vec").alias("__q"))
    return pairs.join(x, "id").join(q, "qid").select("qid", "id", squared_l2(F.col("__x"), F.col("__q")).alias("dist"))


def rerank(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, dist): the k best of (qid, id) by the distance of the whole vectors."""
    return ranked(score(candidates.select("qid", "id").distinct(), base, queries), k).select("qid", "rank", "id", "dist")


def merge_beams(beam: DataFrame, batch: DataFrame, width: int) -> DataFrame:
    """The ``width`` best (qid, id, dist, expanded) of both for each query; ids in both stay once, expanded if either is."""
    both = beam.unionByName(batch).groupBy("qid", "id").agg(F.min("dist").alias("dist"), F.max("expanded").alias("expanded"))
    return ranked(both, width)


def frontier(beam: DataFrame, width: int) -> DataFrame:
    """(qid, id): the first ``width`` entries of each beam that are not expanded."""
    return ranked(beam.where(~F.col("expanded")), width).select("qid", "id")
