"""Queries that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from latticevec.plans.index import VectorIndex


def search_stream(index: VectorIndex, queries: DataFrame, path: str, checkpoint: str, k: int | None = None, **trigger) -> StreamingQuery:
    """Search a stream of (qid, vec) batch by batch; results go to Parquet under ``path``, a folder for each batch, so a batch that runs again leaves its rows once."""

    def each(batch: DataFrame, number: int) -> None:
        index.search(batch, k).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
