"""Training samples, the least dimension that finds enough, and parameter sweeps."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticevec.functions import bits
from latticevec.functions.vec import matrix_of
from latticevec.lineage import checkpoint
from latticevec.operators.knn import exact_knn

#: Components of truth that one broadcast holds at most.
BROADCAST_NUMBERS = 8_000_000


def training_sample(base: DataFrame, n: int = 100, seed: int = 43, id: str = "id") -> DataFrame:
    """n rows, those of the least pseudo-random state of seed and id: the same ones whatever the partitions."""
    state = bits.lcg(bits.lcg((F.col(id) + F.lit(seed)) % F.lit(bits.WORD)))
    return base.orderBy(state, id).limit(n)


def dimension_recalls(base: DataFrame, queries: DataFrame, dims: Iterable[int], n_candidates: int, k: int = 10) -> DataFrame:
    """(dim, recall): how many of the k nearest rows are among the ``n_candidates`` nearest by the first components.

    A neighbour is among these if fewer rows than that are nearer. How many are
    is counted for every neighbour and dimension in one scan of the rows, whose
    distances by ever more components are running sums. ``queries`` are few, a
    training sample; many are an error.
    """
    dims = sorted(dims)
    truth = checkpoint(exact_knn(base, queries, k).select("qid", "id"))
    found = truth.join(queries.select(F.col("qid").cast("long"), F.col("vec").alias("q")), "qid").join(base.select(F.col("id").cast("long"), "vec"), "id")
    if truth.count() * len(dims) > BROADCAST_NUMBERS:
        raise ValueError("take a training sample: these are too many queries")
    rows = found.orderBy("qid", "id").toArrow()  # at most BROADCAST_NUMBERS / len(dims)
    qids, ids = rows.column("qid").to_numpy(), rows.column("id").to_numpy()
    q, x = matrix_of(rows.column("q")), matrix_of(rows.column("vec"))
    at = np.minimum(dims, max(1, q.shape[1])) - 1
    true = ((q - x) ** 2).cumsum(axis=1)[:, at] if len(q) else np.zeros((0, len(dims)))
    first = np.flatnonzero(np.append(True, qids[1:] != qids[:-1])) if len(qids) else np.zeros(0, int)
    shared = base.sparkSession.sparkContext.broadcast((ids, q, true, np.append(first, len(qids)), at))

    def nearer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, true, first, at = shared.value
        count = np.zeros(true.shape, np.int64)
        for batch in batches:
            rows, own = matrix_of(batch.column("vec")), batch.column("id").to_numpy()
            for a, b in zip(first[:-1], first[1:], strict=True):
                for c in range(0, len(rows), 4096):
                    d = ((rows[c : c + 4096] - q[a]) ** 2).cumsum(axis=1)[:, at]
                    for t in range(a, b):
                        count[t] += ((d < true[t]) | ((d == true[t]) & (own[c : c + 4096] < ids[t])[:, None])).sum(axis=0)
        t, d = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(d), pa.array(count[t, d])], ["t", "d", "n"])

    counts = base.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(nearer, "t long, d long, n long").groupBy("t", "d").agg(F.sum("n").alias("n"))
    lost = counts.where(F.col("n") >= n_candidates).groupBy("d").agg(F.count(F.lit(1)).alias("lost"))
    every = base.sparkSession.createDataFrame([(j, d) for j, d in enumerate(dims)], "d long, dim int")
    share = 1 - F.coalesce("lost", F.lit(0)) / F.lit(float(max(1, len(qids))))
    whole = F.lit(float(len(qids) / max(1, k * (len(first)))))
    return every.join(F.broadcast(lost), "d", "left").select("dim", (share * whole).alias("recall"))


def least_dimension(recalls: DataFrame, goal: float = 0.99) -> DataFrame:
    """One row, (dim): the least dimension whose recall reaches the goal; null if none does."""
    return recalls.where(F.col("recall") >= goal).agg(F.min("dim").alias("dim"))


def sweep(run: Callable[..., dict[str, float]], grid: dict[str, list[Any]], repeats: int = 5) -> list[dict[str, Any]]:
    """What ``run`` returns for every combination of a grid, repeated; each row has its settings and the seconds that it took."""
    rows = []
    for repeat, values in itertools.product(range(repeats), itertools.product(*grid.values())):
        settings = dict(zip(grid, values, strict=True))
        began = time.perf_counter()
        rows.append(settings | {"repeat": repeat} | run(**settings) | {"seconds": time.perf_counter() - began})
    return rows
