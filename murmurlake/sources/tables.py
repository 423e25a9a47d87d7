"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``root/name.parquet``, whether one file or a folder of parts."""
    return spark.read.parquet(f"{root}/{name}.parquet")
