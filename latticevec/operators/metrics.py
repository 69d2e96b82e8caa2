"""Recall against ground truth, and statistics of candidates and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hits(results: DataFrame, truth: DataFrame, m: int) -> DataFrame:
    """(qid, found): how many of each query's first m true ids are anywhere in its results; truth is (qid, rank, id)."""
    first = truth.where(F.col("rank") <= m).select("qid", "id")
    listed = results.select("qid", "id").distinct().withColumn("hit", F.lit(1))
    return first.join(listed, ["qid", "id"], "left").groupBy("qid").agg(F.count("hit").alias("found"))


def recall(results: DataFrame, truth: DataFrame, m: int) -> DataFrame:
    """One row, (recall, n_queries): the share of all queries' first m true ids that their results hold; m divides even where there are fewer."""
    found = hits(results, truth, m)
    return found.agg((F.sum("found").cast("double") / (F.count(F.lit(1)) * m)).alias("recall"), F.count(F.lit(1)).alias("n_queries"))


def recall_by(results: DataFrame, truth: DataFrame, m: int, groups: DataFrame, by: str) -> DataFrame:
    """(by, recall, n_queries), by a column of (qid, by)."""
    found = hits(results, truth, m).join(groups.select("qid", by), "qid")
    return found.groupBy(by).agg((F.sum("found").cast("double") / (F.count(F.lit(1)) * m)).alias("recall"), F.count(F.lit(1)).alias("n_queries"))


def candidate_report(candidates: DataFrame, truth: DataFrame, m: int) -> DataFrame:
    """One row, (recall, mean_candidates): recall of candidate lists, and how long they are for the queries that have any."""
    sizes = candidates.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("mean_candidates"))
    return recall(candidates, truth, m).select("recall").crossJoin(sizes)  # one row each


def count_at_or_below(value: Column, limit: Column) -> Column:
    return F.sum(F.when(value <= limit, 1).otherwise(0))


def mean_over_repeats(metrics: DataFrame, *config: str) -> DataFrame:
    """(config, stage, ms): the mean of a stage's times over runs of the same configuration."""
    return metrics.groupBy(*config, "stage").agg(F.avg("ms").alias("ms"))
