"""Run logs: lines of text that name a stage and its time, and metrics as rows."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Timer:
    """Times of nested stages."""

    def __init__(self, run_id: str):
        self.run_id, self.rows, self.open = run_id, [], []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        self.open.append(name)
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((self.run_id, "/".join(self.open), (time.perf_counter() - began) * 1000))
            self.open.pop()

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "run_id string, stage string, ms double")

    def append(self, spark: SparkSession, path: str) -> None:
        self.to_df(spark).write.mode("append").json(path)


def parse_log(lines: DataFrame) -> DataFrame:
    """(stage, ms, recall) of the lines of a log, in a column ``value``: ``time <stage>: <x> ms`` and ``recall@<m> = <x>``; other lines are passed over."""
    stage = F.regexp_extract("value", r"time ([^:]+): *([0-9.eE+-]+) *ms", 1)
    ms = F.regexp_extract("value", r"time ([^:]+): *([0-9.eE+-]+) *ms", 2)
    at = F.regexp_extract("value", r"(recall@[0-9]+) *= *([0-9.eE+-]+)", 1)
    got = F.regexp_extract("value", r"(recall@[0-9]+) *= *([0-9.eE+-]+)", 2)
    number = lambda c: F.when(c != "", c).cast("double")
    rows = lines.select(F.when(stage != "", stage).otherwise(at).alias("stage"), number(ms).alias("ms"), number(got).alias("recall"))
    return rows.where("stage <> ''")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))


def write_report(averages: DataFrame, path: str) -> None:
    """One line of text for each row of a table of averages."""
    averages.select(F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in averages.columns]).alias("value")).write.mode("overwrite").text(path)
