"""Cleaning pipeline over ``documents``: each stage is one operator of ``roadpoints.llm`` and works on what the last one kept.

A stage takes (spark, docs, sf_dir) and returns the columns of ``documents``, the last one (doc_id, n_tokens, ids_sha256,
decoded_sha256). Rows with a null doc_id cannot be decided on and leave at the first stage; rows of equal doc_id share a decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadpoints.llm import bpe_codec, decontaminate, line_dedup, minmax_dedup, quality_rules
from roadpoints.session import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    return docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the quality rules reject."""
    return _keep(docs, quality_rules.quality(docs).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated passages; every document stays, n_chars follows its new text."""
    out = line_dedup.dedup_passages(docs.select(*COLUMNS), counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return _keep(docs, minmax_dedup.near_duplicates(docs).where("kept"))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold benchmark passages."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.where("contaminated").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document that is left."""
    return bpe_codec.digests(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("contamination", contamination), ("encoded", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
