"""Running values over a key's rows without putting a whole key into one task.

A plain window over a key sorts all its rows in one task, which fails where one key holds a third of the
table. Here each key is cut into blocks of its ordering: the blocks' totals are folded first (partial
aggregation before the shuffle), the few totals are scanned per key, and the result is carried into each
block, whose rows are then scanned block by block in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match each other; the right side's keys are dropped."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def scan_before(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], value: str, out: str, fold: str = "max") -> DataFrame:
    """Add ``out``: the max or sum of ``value`` over the rows of the same keys that come before each row.

    ``block`` must be a non-decreasing function of ``order`` within a key. Rows without predecessors get
    null. Null values are ignored, null keys form one key.
    """
    agg = {"max": F.max, "sum": F.sum}[fold]
    totals = df.groupBy(*keys, block).agg(agg(value).alias("__total"))
    across = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(*keys, block, agg("__total").over(across).alias("__carry"))
    joined = join_null_safe(df, carries, [*keys, block])
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = agg(value).over(inside)
    if fold == "max":
        both = F.greatest(F.col("__carry"), local)
    else:
        both = F.when(F.col("__carry").isNull() & local.isNull(), None).otherwise(F.coalesce("__carry", F.lit(0)) + F.coalesce(local, F.lit(0)))
    return joined.withColumn(out, both).drop("__carry")
