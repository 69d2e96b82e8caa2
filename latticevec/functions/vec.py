"""Vector arithmetic as column expressions, and as numpy blocks for Arrow batches.

Columns are arrays of numbers; sums run in double precision in the order of the
components. A null vector gives null.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = Sequence[Sequence[float]]


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def squared_l2(a: Column, b: Column) -> Column:
    """The sum of squared differences; no root is taken. The shorter vector goes on with zeros."""
    whole = lambda x: F.coalesce(x, F.lit(0.0))
    return total(F.transform(F.zip_with(_double(a), _double(b), lambda x, y: whole(x) - whole(y)), lambda x: x * x))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def leading(v: Column, dims: int) -> Column:
    """The first components of a vector."""
    return F.slice(v, 1, dims)


def truncated_l2(a: Column, b: Column, dims: int) -> Column:
    return squared_l2(leading(a, dims), leading(b, dims))


def subspace(v: Column, space: int = 0) -> Column:
    """Three components as a point: numbers 3s, 3s+1 and 3s+2."""
    return F.struct(*[F.get(v, F.lit(3 * space + k)).alias(n) for k, n in enumerate("xyz")])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(_double(a), _double(b), lambda x, y: x - y)


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def times(v: Column, matrix: Matrix) -> Column:
    """A row vector times a matrix given by its rows."""
    columns = list(zip(*matrix, strict=True))
    return F.array(*[dot(v, vector(c)) for c in columns])


def gemm(v: Column, matrix: Matrix, alpha: float = 1.0, beta: float = 0.0, c: Column | None = None) -> Column:
    """A row of alpha A B + beta C."""
    scaled = F.transform(times(v, matrix), lambda x: x * F.lit(float(alpha)))
    return scaled if c is None or not beta else F.zip_with(scaled, _double(c), lambda x, y: x + y * F.lit(float(beta)))


def project(v: Column, mean: Sequence[float], rotation: Matrix) -> Column:
    """(v - mean) R."""
    return times(subtract(v, vector(mean)), rotation)


def next_power_of_two(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long")


def quantised(v: Column, scale: float) -> Column:
    """Components times a scale, rounded towards zero and held within plus or minus 127."""
    return F.transform(_double(v), lambda x: F.greatest(F.least((x * F.lit(float(scale))).cast("long"), F.lit(127)), F.lit(-127)).cast("int"))


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def usable(v: Column) -> Column:
    """Whether a vector takes part in a search: it is not null, and all its components are finite numbers."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def matrix_of(column: pa.Array | pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """The first ``dims`` components of a list column as doubles, or as many as the longest has; short rows go on with zeros, null ones are zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dims or 0))
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if (sizes == sizes[0]).all():
        x = flat.reshape(len(column), -1)
    else:
        x = np.zeros((len(column), sizes.max()))
        x[np.arange(x.shape[1]) < sizes[:, None]] = flat
    return x if dims is None else widened(x[:, :dims], dims)


def widened(x: np.ndarray, width: int) -> np.ndarray:
    """The rows, with zeros behind them."""
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def list_array(x: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel(), kind))


def nearest_in_block(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids), each (query, k): the k rows nearest to each query, nearest first, ties to the smaller id.

    A matrix product finds the candidates, whose distances are then summed anew
    from the differences, so they don't depend on where a row stands. Rows of the id in
    ``skip`` are passed over. Places without a row have distance infinity and id -1.
    """
    best, who = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
    q, x = widened(q, x.shape[1]), widened(x, q.shape[1])
    norms = squares(x)
    for a in range(0, len(q), 256):
        part = q[a : a + 256]
        rough = squares(part)[:, None] + norms[None, :] - 2 * (part @ x.T)
        if skip is not None:
            rough[skip[a : a + 256, None] == ids[None, :]] = np.inf
        cut = np.partition(rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] > k else np.full(len(part), 1e300)
        slack = 1e-10 * (1 + squares(part) + norms.max(initial=0))
        row, col = np.nonzero(rough <= np.minimum(cut, 1e300)[:, None] + slack[:, None])
        d = np.empty(len(row))
        for b in range(0, len(row), 1 << 16):
            d[b : b + (1 << 16)] = ((part[row[b : b + (1 << 16)]] - x[col[b : b + (1 << 16)]]) ** 2).sum(axis=1)
        order = np.lexsort((ids[col], d, row))
        row, col, d = row[order], col[order], d[order]
        rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(part)))[row]
        keep = rank < k
        best[a + row[keep], rank[keep]], who[a + row[keep], rank[keep]] = d[keep], ids[col[keep]]
    return best, who


def merged(d: np.ndarray, ids: np.ndarray, d2: np.ndarray, ids2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The better half of two lists of nearest rows for each query."""
    k = d.shape[1]
    both, who = np.concatenate([d, d2], axis=1), np.concatenate([ids, ids2], axis=1)
    order = np.lexsort((who, both), axis=-1)[:, :k]
    return np.take_along_axis(both, order, axis=1), np.take_along_axis(who, order, axis=1)
