"""A training corpus from ``documents`` in stages, each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from decklake.llm import pipeline_stages
from decklake.llm.common import table, written

STAGES = pipeline_stages.STAGES
#: SQL expresses neither the models nor the fingerprint index; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return docs
