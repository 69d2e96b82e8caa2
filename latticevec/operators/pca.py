"""Principal components: the mean and Gram matrix by partial sums, the rotation on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticevec.functions.vec import list_array, matrix_of, usable

#: Rows of partial sums that the driver adds up at most.
GROUPS = 32


@dataclass
class PCA:
    """The mean, the eigenvectors of the covariance as columns, and the eigenvalues, largest first."""

    mean: np.ndarray
    rotation: np.ndarray
    eigenvalues: np.ndarray

    def ratio(self, k: int) -> float:
        """The share of the variance that the first k components have."""
        total = float(self.eigenvalues.sum())
        return float(self.eigenvalues[:k].sum()) / total if total else 0.0

    def apply(self, x: np.ndarray, dims: int) -> np.ndarray:
        """(x - mean) R, by its first ``dims`` columns; the mean's part is computed once."""
        return x @ self.rotation[:, :dims] - self.mean @ self.rotation[:, :dims]

    def to_df(self, spark: SparkSession) -> DataFrame:
        row = (self.mean.tolist(), self.rotation.tolist(), self.eigenvalues.tolist())
        return spark.createDataFrame([row], "mean array<double>, rotation array<array<double>>, eigenvalues array<double>")

    @classmethod
    def from_df(cls, model: DataFrame) -> PCA:
        row = model.first()
        return cls(np.array(row["mean"]), np.array(row["rotation"]), np.array(row["eigenvalues"]))


def column_mean(base: DataFrame, vec: str = "vec") -> DataFrame:
    """(dim, mean) by component, from 0."""
    return base.select(F.posexplode(vec).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def moments(base: DataFrame, vec: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance with n - 1), each partition adding up its centred products first.

    Vectors that are null or have a component that is null or not finite take no part; short ones go on with zeros.
    """
    base = base.where(usable(F.col(vec)))
    dims = base.agg(F.max(F.size(vec))).first()[0]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0), dims)
                n, mean, m2 = combined(n, mean, m2, len(x), x.mean(axis=0), (c := x - x.mean(axis=0)).T @ c)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), list_array(mean[None]), list_array(m2.reshape(1, -1))], ["n", "mean", "m2"])

    def together(table: pa.Table) -> pa.Table:
        n, mean, m2 = 0, None, None
        for k in range(table.num_rows):
            other = np.array(table.column("mean")[k].values)
            n, mean, m2 = combined(n, mean, m2, table.column("n")[k].as_py(), other, np.array(table.column("m2")[k].values).reshape(len(other), -1))
        return pa.table({"n": pa.array([n], pa.int64()), "mean": list_array(mean[None]), "m2": list_array(m2.reshape(1, -1))})

    shape = "n long, mean array<double>, m2 array<double>"
    sums = base.select(vec).mapInArrow(part, shape).withColumn("g", F.spark_partition_id() % GROUPS)
    n, mean, m2 = 0, None, None
    for row in sums.groupBy("g").applyInArrow(lambda t: together(t), shape).collect():  # at most GROUPS rows of d x d sums
        m = np.array(row["mean"])
        n, mean, m2 = combined(n, mean, m2, row["n"], m, np.array(row["m2"]).reshape(len(m), -1))
    if not n:
        raise ValueError("no vectors to learn from")
    return n, mean, m2 / max(1, n - 1)


def combined(n: int, mean: np.ndarray | None, m2: np.ndarray | None, k: int, other: np.ndarray, other2: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Counts, means and centred products of two disjoint sets together."""
    if not n:
        return k, other, other2
    d = other - mean
    return n + k, mean + d * (k / (n + k)), m2 + other2 + np.outer(d, d) * (n * k / (n + k))


def fit(base: DataFrame, vec: str = "vec") -> PCA:
    """The components of all rows; of each eigenvector the component of largest size is made positive."""
    _, mean, cov = moments(base, vec)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return PCA(mean, vectors * np.where(lead < 0, -1.0, 1.0), values)


def transform(df: DataFrame, model: PCA, dims: int, vec: str = "vec", out: str = "pca") -> DataFrame:
    """All columns and the projection to the first ``dims`` components, as floats; rows whose vectors take no part in a search are left out."""
    df = df.where(usable(F.col(vec)))
    shared, names = df.sparkSession.sparkContext.broadcast(model), df.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column(names.index(vec)), len(shared.value.mean))
            y = shared.value.apply(x, dims) if len(x) else np.zeros((0, dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, list_array(y.astype(np.float32))], [*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(scan, f"{fields}, `{out}` array<float>")
