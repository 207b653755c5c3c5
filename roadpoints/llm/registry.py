"""The subpackage's registered queries: importing the modules below fills the registry."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("line_dedup", "html_extract", "quality_rules", "minmax_dedup", "decontaminate", "token_counts", "warc", "url_filter", "bpe_codec", "pii",
           "multi_index", "permuterm", "collocations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def llm_queries() -> tuple[dict, dict]:
    for m in MODULES:
        import_module(f"roadpoints.llm.{m}")
    return QUERIES, ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
