"""Reading the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` below `folder`, which may lie in any store that Spark reads."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
