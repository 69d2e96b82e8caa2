"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A vector is turned by pseudo-random rotations, made of random signs and fast
Hadamard transforms, and each of them gives the signed axis that is nearest.
The axes together are the vector's bucket. As many rotations are used, the last
of them over as few axes, as leave a handful of rows in a bucket, so buckets
become more as the table grows and not fuller. A query looks into the buckets
whose axes are nearest to it together, in that order, and everything found
there is scored exactly.

Largest inner product is turned into smallest angle by one more component that
gives all vectors the length of the longest; a query has a zero there.

How many buckets a query looks into is measured: for some queries the true
neighbours are found by a scan of all rows, and so many are probed as find them
at the target rate. Where that would be more work than to look at all rows, all
rows are looked at, and so they are for queries that find too few.

Equal vectors are searched as one, with the least of their ids, which are all
that can be among the nearest. Buckets are dealt out in groups; rows and queries
of a group meet in blocks of bounded size, however full it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from latticevec.llm.common import checkpoint

TABLES = 10
TARGET = 0.93
#: Queries that the number of probes is measured on, at most.
SAMPLE = 200
#: Rows whose products tell what can't be among a query's nearest: as many as the first, or so often the root of all rows, in so many bytes.
LEAST_SAMPLE, ROOTS, SAMPLE_BYTES = 2000, 40, 16_000_000
#: Rows, and queries, of a task.
TASK_ROWS, TASK_QUERIES = 16_384, 512
#: Rows of a bucket, and of a group of buckets, on average; rows and queries that meet at once, at most.
BUCKET_ROWS, GROUP_ROWS, BLOCK_ROWS, BLOCK_QUERIES = 6, 2048, 8192, 8192
#: Rows up to which all are looked at.
FEW = 4096
#: Groups of more than a block that are broadcast at most (24 bytes each).
BROADCAST_GROUPS = 1_000_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, unit length kept; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


def widths(rows: int, width: int) -> list[int]:
    """The axes of each rotation: all, and for the last so many that a bucket has about BUCKET_ROWS rows."""
    out, left = [], rows / BUCKET_ROWS
    while left > 2:
        out.append(min(width, 1 << max(0, round(np.log2(left / 2)))))
        left /= 2 * out[-1]
    return out


@dataclass
class Hash:
    """The rotations of all tables; of a fixed size. Without rotations there is one bucket."""

    dim: int
    longest: float
    even: bool  # all vectors have the same length
    parts: list[int]  # axes of each rotation
    groups: int = 1
    probes: int = 1
    tables: int = TABLES
    recall: float = 1.0  # as measured
    seed: int = 11

    @staticmethod
    def width(dim: int, even: bool) -> int:
        return 1 << (dim - even).bit_length() if dim > 1 else 2

    @property
    def size(self) -> int:
        """Buckets of a table."""
        return int(np.prod([2 * w for w in self.parts], dtype=object)) if self.parts else 1

    def turned(self, x: np.ndarray, query: bool) -> Iterator[list[np.ndarray]]:
        """For each table and rotation: (row, signed axis) nearness, the positive axes first."""
        width = self.width(self.dim, self.even)
        unit = np.zeros((len(x), width))
        norm = np.linalg.norm(x, axis=1)
        unit[:, : x.shape[1]] = x / (norm if query or self.even else np.full(len(x), self.longest))[:, None]
        if not query and not self.even:
            unit[:, self.dim] = np.sqrt(np.maximum(0, 1 - (norm / self.longest) ** 2))
        draw = np.random.default_rng(self.seed)
        for _ in range(self.tables):
            each = []
            for axes in self.parts:
                y = unit
                for signs in draw.choice([-1.0, 1.0], (3, width)):
                    y = hadamard(y * signs)
                each.append(np.concatenate([y[:, :axes], -y[:, :axes]], axis=1))
            yield each

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(row, table): the bucket of each row; the first rotation counts most."""
        out = np.zeros((len(x), self.tables), np.int64)
        for t, each in enumerate(self.turned(x, False)):
            for y in each:
                out[:, t] = out[:, t] * y.shape[1] + y.argmax(axis=1)
        return out

    def order(self, each: list[np.ndarray], most: int) -> np.ndarray:
        """(row, probe): the ``most`` buckets that are nearest to turned queries by the sum of their axes' nearness."""
        n = len(each[0]) if each else 0
        total, code = np.zeros((n, 1)), np.zeros((n, 1), np.int64)
        for y in each:
            total = (total[:, :, None] + y[:, None, :]).reshape(n, -1)
            code = (code[:, :, None] * y.shape[1] + np.arange(y.shape[1])).reshape(n, -1)
            if total.shape[1] > most:  # no bucket behind the first ``most`` of the first rotations is among the first of all
                best = np.argpartition(-total, most - 1, axis=1)[:, :most]
                total, code = np.take_along_axis(total, best, axis=1), np.take_along_axis(code, best, axis=1)
        return code

    def rank(self, each: list[np.ndarray], queries: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """For pairs of turned queries and buckets: how many buckets are nearer to the query."""
        axes, rest = [], bucket.copy()
        for y in reversed(each):
            axes.append(rest % y.shape[1])
            rest //= y.shape[1]
        own = sum(y[queries, a] for y, a in zip(each, reversed(axes), strict=True))
        sums = lambda part, q: np.sort(reduce(np.add.outer, [y[q] for y in part], np.zeros(())).ravel())
        half, out = (len(each) + 1) // 2, np.zeros(len(queries), np.int64)
        for q in np.unique(queries):
            one, two = sums(each[:half], q), sums(each[half:], q)
            for k in np.flatnonzero(queries == q):
                out[k] = (len(one) - np.searchsorted(one, own[k] - two + 1e-12, "right")).sum()
        return out

    def group(self, bucket: np.ndarray) -> np.ndarray:
        """The group of each bucket: neighbours by the first rotation are together."""
        return (bucket * (self.groups / self.size)).astype(np.int64)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column in double precision; short ones go on with zeros."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    sizes = np.asarray(column.value_lengths())
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    at = np.cumsum(sizes) - sizes
    for k, (a, n) in enumerate(zip(at, sizes, strict=True)):
        out[k, :n] = flat[a : a + n]
    return out


def best_of(y: np.ndarray, x: np.ndarray, ids: np.ndarray, row: np.ndarray, col: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): the k best of each query's pairs, ties to the smaller id. Products are summed in a fixed order, so that ties are ties wherever they stand."""
    score = np.concatenate([(y[row[a : a + 65536]] * x[col[a : a + 65536]]).sum(axis=1) for a in range(0, len(row), 65536)]) if len(row) else np.zeros(0)
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(y)))[row] < k
    return row[keep], col[keep], score[keep]


FOUND = "query_id long, id long, score double"


def _clean(df: DataFrame, vec_id: str, vec: str) -> DataFrame:
    """(id, vec): the rows that take part; of rows that share an id the greatest vector's."""
    kind = "array<float>" if isinstance(df.schema[vec].dataType, ArrayType) and isinstance(df.schema[vec].dataType.elementType, FloatType) else "array<double>"
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).cast(kind).alias("vec"))
    rows = rows.where("id is not null and vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)")
    return rows.groupBy("id").agg(F.max("vec").alias("vec"))


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _true_neighbours(rows: DataFrame, asked: DataFrame, dim: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, query of each neighbour, neighbours): SAMPLE queries at most, with their nearest of all rows."""
    some = asked.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    ids, y = some.column("id").to_numpy(), matrix(some.column("vec").combine_chunks(), dim)
    shared = rows.sparkSession.sparkContext.broadcast((ids, y))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y = shared.value
        for batch in batches:
            rough = y @ matrix(batch.column("vec"), dim).T
            rough[ids[:, None] == batch.column("id").to_numpy()[None, :]] = -np.inf
            near = np.argsort(-rough, axis=1)[:, :k]
            near, q = near.ravel(), np.repeat(np.arange(len(ids)), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), batch.column("id").take(pa.array(near)), pa.array(rough[q, near]), batch.column("vec").take(pa.array(near))], ["query_id", "id", "score", "vec"])

    kind = rows.schema["vec"].dataType.simpleString()
    found = _top(rows.mapInArrow(scan, f"{FOUND}, vec {kind}").where("score > double('-Infinity')"), k).toArrow()
    return y, found.column("query_id").to_numpy(), matrix(found.column("vec").combine_chunks(), dim)


def measured(out: Hash, queries: np.ndarray, of: np.ndarray, neighbours: np.ndarray, target: float) -> Hash:
    """The hash with as many probes as find the queries' neighbours at the target rate."""
    own, best = out.buckets(neighbours), np.full(len(of), out.size)
    for t, each in enumerate(out.turned(queries, True)):
        best = np.minimum(best, out.rank(each, of, own[:, t]))
    out.probes = int(np.quantile(best, target, method="higher")) + 1 if len(of) else 1
    out.recall = float((best < out.probes).mean()) if len(of) else 1.0
    return out


def _meet(rows: DataFrame, asked: DataFrame, shape: Hash, sample: np.ndarray, k: int) -> DataFrame:
    """(query_id, id, score): for each query the k best rows of each block where it meets rows of its buckets, its own row among them.

    What is worse than a query's k best of the ``sample``, some of the rows, is left out.
    """
    hashed, some_rows = rows.sparkSession.sparkContext.broadcast(shape), rows.sparkSession.sparkContext.broadcast(sample)
    dim, kind = shape.dim, rows.schema["vec"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each table."""
        shape = hashed.value
        for batch in batches:
            at = shape.buckets(matrix(batch.column("vec"), dim))
            take = pa.array(np.repeat(np.arange(len(at)), shape.tables))
            columns = [pa.array(np.tile(np.arange(shape.tables, dtype=np.int32), len(at))), pa.array(shape.group(at).ravel()), batch.column("id").take(take), batch.column("vec").take(take), pa.array(at.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["t", "g", "id", "vec", "bucket"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each table and group that a query looks into, with the buckets there."""
        shape = hashed.value
        for whole in batches:
            for a in range(0, whole.num_rows, step := max(1, (1 << 22) // max(1, 128 * shape.probes))):
                batch = whole.slice(a, step)
                x, n = matrix(batch.column("vec"), dim), batch.num_rows
                bound = np.full(n, -np.inf)
                if len(some_rows.value) >= k:
                    bound = np.partition(x @ some_rows.value.T, -k, axis=1)[:, -k]
                    bound -= 1e-9 * (1 + np.abs(bound))  # products can differ in their last digits by where they stand
                for t, each in enumerate(shape.turned(x, True)):
                    at = np.sort(shape.order(each, shape.probes), axis=1) if each else np.zeros((n, 1), np.int64)
                    g = shape.group(at)
                    new = np.concatenate([np.ones((n, 1), bool), g[:, 1:] != g[:, :-1]], axis=1)
                    begin = np.flatnonzero(new.ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, at.size).astype(np.int32)), pa.array(at.ravel()))
                    take = pa.array(begin // at.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(begin), t, np.int32)), pa.array(g.ravel()[begin]), batch.column("id").take(take), batch.column("vec").take(take), lists, pa.array(bound[begin // at.shape[1]])], ["t", "g", "id", "vec", "buckets", "bound"])

    left = checkpoint(rows.mapInArrow(index, f"t int, g long, id long, vec {kind}, bucket long"))
    right = checkpoint(asked.mapInArrow(probe, f"t int, g long, id long, vec {kind}, buckets array<long>, bound double"))
    # Groups of one block, nearly all, need no table; the others are cut into blocks.
    some = lambda df, name, size: df.groupBy("t", "g").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    cut = checkpoint(some(left, "n_rows", BLOCK_ROWS).join(some(right, "n_asked", BLOCK_QUERIES), ["t", "g"]).where("n_rows > 1 or n_asked > 1"))
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_GROUPS else cut
    whole = lambda c: F.coalesce(c, F.lit(1))
    each = lambda c: F.explode(F.sequence(F.lit(0), whole(F.col(c)) - 1))
    own = lambda c: F.pmod(F.xxhash64("id"), whole(F.col(c))).cast("int")
    left = left.join(cut, ["t", "g"], "left").select("t", "g", own("n_rows").alias("r"), each("n_asked").alias("s"), "id", "vec", "bucket")
    right = right.join(cut, ["t", "g"], "left").select("t", "g", each("n_rows").alias("r"), own("n_asked").alias("s"), "id", "vec", "buckets", "bound")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        made = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if a.num_rows and b.num_rows:
            bucket = a.column("bucket").to_numpy()
            order = np.argsort(bucket, kind="stable")
            bucket, ids, x = bucket[order], a.column("id").to_numpy()[order], matrix(a.column("vec").combine_chunks(), dim)[order]
            begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            there, end = bucket[begin], np.append(begin[1:], len(bucket))
            asks, y, lists, bound = b.column("id").to_numpy(), matrix(b.column("vec").combine_chunks(), dim), b.column("buckets").combine_chunks(), b.column("bound").to_numpy()
            looks, of = np.asarray(lists.flatten()), np.repeat(np.arange(len(asks)), np.asarray(lists.value_lengths()))
            order = np.argsort(looks, kind="stable")
            looks, of = looks[order], of[order]
            low, high = np.searchsorted(looks, there, "left"), np.searchsorted(looks, there, "right")
            row, col = [np.zeros(0, int)], [np.zeros(0, int)]
            for k_ in np.flatnonzero(high > low):
                q = of[low[k_] : high[k_]]
                i, j = np.nonzero(y[q] @ x[begin[k_] : end[k_]].T >= bound[q][:, None])
                row.append(q[i])
                col.append(j + begin[k_])
            i, j, score = best_of(y, x, ids, np.concatenate(row), np.concatenate(col), k)
            made = [asks[i], ids[j], score]
        return pa.table({"query_id": pa.array(made[0], pa.int64()), "id": pa.array(made[1], pa.int64()), "score": pa.array(made[2], pa.float64())})

    key = ["t", "g", "r", "s"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vec: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by inner product in double precision, nearest first, ties to the smaller id.

    ``queries`` has the columns of ``vectors``. A query's own id is no answer to
    it. Vectors that are null, empty or zero or hold a null or a component that
    is not finite take no part, nor do rows without an id; short vectors go on
    with zeros. Rows that share an id are one, with the greatest of their
    vectors. Every query has k rows, or all others where they are fewer. Empty
    tables give an empty result; other columns are ignored.
    """
    rows, asked = checkpoint(_clean(vectors, vec_id, vec)), checkpoint(_clean(queries, vec_id, vec))
    norm = "sqrt(aggregate(vec, double(0), (a, x) -> a + double(x) * double(x)))"
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"), F.expr(f"max({norm})").alias("most"), F.expr(f"min({norm})").alias("least")).first()
    asks = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if not facts["n"] or not asks["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, dim, longest = facts["n"], max(facts["dim"], asks["dim"]), facts["most"]
    even = (longest - facts["least"]) <= 1e-3 * longest
    # Of equal vectors the first k + 1 ids: one of them may be the query's own.
    first = Window.partitionBy("vec").orderBy("id")
    kept = rows.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k + 1)
    alike = checkpoint(kept.groupBy("vec").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")))
    # Hashing costs far more than rows weigh, so they are dealt out by number, not by size.
    single, asked = alike.select("id", "vec").repartition(-(-n // TASK_ROWS), "id"), asked.repartition(-(-asks["n"] // TASK_QUERIES), "id")
    known = min(max(LEAST_SAMPLE, int(ROOTS * n**0.5)), max(k + 1, SAMPLE_BYTES // (8 * dim)))
    sample = matrix(single.orderBy(F.xxhash64("id"), "id").limit(known).toArrow().column("vec").combine_chunks(), dim)
    every = Hash(dim, longest, even, [], tables=1)

    def expanded(found: DataFrame) -> DataFrame:
        """The ids of the k + 1 best vectors of each query. What is found in several tables counts once."""
        best = _top(found.groupBy("query_id", "id").agg(F.max("score").alias("score")), k + 1).drop("rank")
        ids = best.join(alike.select("id", "ids"), "id").select("query_id", F.explode("ids").alias("id"), "score")
        return _top(ids.where("id <> query_id"), k)

    def own(found: DataFrame) -> DataFrame:
        return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")

    if n <= FEW:
        return own(expanded(_meet(single, asked, every, sample, k + 1)))
    shape = Hash(dim, longest, even, widths(n, Hash.width(dim, even)), groups=max(1, n // GROUP_ROWS))
    shape = measured(shape, *_true_neighbours(single, asked, dim, k), target)
    if shape.tables * shape.probes >= shape.size:  # as many buckets as there are: as much work as all rows
        return own(expanded(_meet(single, asked, every, sample, k + 1)))
    found = checkpoint(expanded(_meet(single, asked, shape, sample, k + 1)))
    short = asked.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
    if short.isEmpty():
        return own(found)
    rest = expanded(_meet(single, checkpoint(short), every, sample, k + 1))
    return own(found.join(rest.select("query_id").distinct(), "query_id", "left_anti").unionByName(rest))


def every_twentieth(vectors: DataFrame, k: int = 20, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """:func:`nearest` for the rows whose id is divisible by 20."""
    return nearest(vectors, vectors.where(F.col(vec_id) % 20 == 0), k, vec_id, vec)
