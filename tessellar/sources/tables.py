"""Readers of the project's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder, file or directory alike."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
