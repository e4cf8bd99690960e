"""The training-data pipeline: each stage is one operator, written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atlasweave.llm import stages

#: (name, function) in order; a function takes (spark, docs, sf_dir).
STAGES = stages.STAGES

#: SQL cannot express the models and the tokenizer; tests hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder before the next reads them."""
    return stages.run(spark, sf_dir)
