"""Parts of an index, built once and kept as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class Store:
    """A folder on any file system that Spark reaches; without one, parts are built and kept through the shared folder."""

    def __init__(self, path: str | None):
        self.path = path

    def cached(self, name: str, build: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
        """The part of that name, built and written if it isn't there. Names must tell all settings and inputs apart."""
        if self.path is None:
            from latticevec.lineage import checkpoint

            return checkpoint(build())
        where = f"{self.path.rstrip('/')}/{name}"
        try:
            return spark.read.parquet(where)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        build().write.mode("overwrite").parquet(where)
        return spark.read.parquet(where)
