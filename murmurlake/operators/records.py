"""Records by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per value of ``key``; repeated rows count once, rows with a null key are all kept."""
    spread = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    return df.withColumn("__null_no", spread).dropDuplicates([key, "__null_no"]).drop("__null_no")
