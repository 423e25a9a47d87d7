"""Continuous periods and gaps of overlapping, nested or separate intervals.

Time is counted in exact integer units. Every entity's time line is cut into shards of ``2**shard_bits``
units. An interval sets one run of units in the shard it starts in and one in the shard it ends in; the
whole shards between the two are one coarse run that stands in the first of them, so an interval costs at
most three rows however long it is. A shard's bitmap is kept as its sorted, disjoint runs (run-length
compressed), one row each, so no shard is ever one value. Bitmaps are united per entity and shard, and the
set runs (periods) and clear runs (gaps) are then read off across shards: each shard is summed up by its
reach, these short rows are scanned per entity, and all shards are finished in parallel. A key with a third
of all rows is spread over as many tasks as it has shards (of four and a half minutes).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.operators.scans import join_null_safe, scan_before
from murmurlake.session import materialise

SHARD_BITS = 28


def _pieces(start: Column, end: Column, bits: int) -> Column:
    first = F.shiftright(start, bits)
    last = F.shiftright(end - F.lit(1).cast("bigint"), bits)
    unit = F.lit(1 << bits).cast("bigint")

    def piece(shard: Column, lo: Column, hi: Column) -> Column:
        return F.struct(shard.alias("shard"), lo.alias("lo"), hi.alias("hi"))

    one = F.array(piece(first, start, end))
    ends = F.array(piece(first, start, (first + 1) * unit), piece(last, last * unit, end))
    middle = F.array(piece(first + 1, (first + 1) * unit, last * unit))
    return F.when(first == last, one).when(last == first + 1, ends).otherwise(F.concat(ends, middle))


def run_bitmaps(df: DataFrame, keys: Sequence[str], start: str, end: str, shard_bits: int = SHARD_BITS) -> DataFrame:
    """The united runs of every key and shard, one row each: keys, shard, lo, hi.

    Runs of a shard are disjoint and do not touch; one that holds a coarse run reaches beyond its shard.
    Rows with a null or non-positive length are left out.
    """
    s, e = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    cut = (
        df.filter(s.isNotNull() & e.isNotNull() & (e > s))
        .select(*keys, F.inline(_pieces(s, e, shard_bits)))
        # equal starts keep the longest piece only: combined before the shuffle
        .groupBy(*keys, "shard", "lo")
        .agg(F.max("hi").alias("hi"))
    )
    w = Window.partitionBy(*keys, "shard").orderBy("lo")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (
        cut.withColumn("__new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0))
        .withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "shard", "__run")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("__run")
    )


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, shard_bits: int = SHARD_BITS) -> DataFrame:
    """Periods and gaps of every key.

    Result: keys, ``kind`` ('period' or 'gap'), ``start_us``, ``end_us``.

    A period is a maximal stretch covered by at least one half-open interval [start, end); intervals that
    touch share a period. Rows with a null bound or ``end <= start`` do not count; a key with no counting
    row has no result; null keys form one key. Repeated rows change nothing. Columns other than the keys
    and the two bounds are ignored, whatever their names.
    """
    keys = list(keys)
    source = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(start).alias("__s"), F.col(end).alias("__e"))
    k = [f"__k{i}" for i in range(len(keys))]
    rows = materialise(run_bitmaps(source, k, "__s", "__e", shard_bits))  # short, and read more than once
    seen = scan_before(rows, k, "shard", ["lo"], "hi", "__before")
    clear = F.col("__before") < F.col("lo")
    gaps = materialise(seen.filter(clear).select(*k, "shard", F.col("__before").alias("gap_start"), F.col("lo").alias("gap_end")))
    gaps = scan_before(gaps, k, "shard", ["gap_start"], "gap_end", "__opened")
    ends = rows.groupBy(*k).agg(F.min("lo").alias("__lo"), F.max("hi").alias("__hi"))
    last = gaps.groupBy(*k).agg(F.max("gap_end").alias("__last"))
    bounds = join_null_safe(ends, last, k)
    closed = join_null_safe(gaps, ends, k).select(
        *k,
        F.inline(
            F.array(
                F.struct(F.lit("gap").alias("kind"), F.col("gap_start").alias("start_us"), F.col("gap_end").alias("end_us")),
                F.struct(F.lit("period").alias("kind"), F.coalesce("__opened", "__lo").alias("start_us"), F.col("gap_start").alias("end_us")),
            )
        ),
    )
    final = bounds.select(*k, F.lit("period").alias("kind"), F.coalesce("__last", "__lo").alias("start_us"), F.col("__hi").alias("end_us"))
    both = closed.unionByName(final)
    return both.select(*[F.col(a).alias(b) for a, b in zip(k, keys)], "kind", "start_us", "end_us")
