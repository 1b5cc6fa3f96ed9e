"""The driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; only Spark's reader touches the path, so any file system works."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")
