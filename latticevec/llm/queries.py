"""The corpus operators as queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from latticevec.llm import ann, bpe, decontam, lines, pii, quality, simhash, tokens, toxicity, urls
from latticevec.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: A stand-in; a production job passes its own secret.
PII_KEY = "replace-this-key"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.every_twentieth(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_nearest": op3_nearest,
    "op4_token_counts": op4_token_counts,
    "op5_bpe": op5_bpe,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {"op2_url_filter": urls.ORACLE_SQL, "op9_line_dedup": lines.ORACLE_SQL}
