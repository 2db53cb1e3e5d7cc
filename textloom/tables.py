"""Readers for the engine's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of ``folder``; columns are pruned by whoever selects from it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
