"""Rolling windows and usage counts over append-only logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_sum(df: DataFrame, key: str, at_us: str, value: str, span_us: int, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the key's rows in (at - span, at], ties included.

    Time is cut into buckets of one span; every row also serves the next bucket as context, so a window
    never looks outside its partition and a busy key is spread over as many tasks as it has spans. Null
    values count 0, null times have no row.
    """
    unit = F.lit(span_us).cast("bigint")
    own = F.floor(F.col(at_us) / unit).cast("bigint")
    both = df.filter(F.col(at_us).isNotNull()).withColumn("__bucket", F.explode(F.array(own, own + 1))).withColumn("__own", F.col("__bucket") == own)
    w = Window.partitionBy(key, "__bucket").orderBy(at_us).rangeBetween(-(span_us - 1), 0)
    return both.withColumn(out, F.sum(F.coalesce(F.col(value), F.lit(0))).over(w)).filter("__own").drop("__bucket", "__own")


def next_return(df: DataFrame, key: str, at_us: str, value: str, span_us: int, now_us: int) -> DataFrame:
    """Per key the oldest row with a positive value still within the span before ``now_us``: what it gives
    back (``gives``) and in how long (``wait_us``)."""
    recent = df.filter((F.col(at_us) > now_us - span_us) & (F.col(at_us) <= now_us) & (F.col(value) > 0))
    oldest = F.struct(at_us, value)
    return recent.groupBy(key).agg(F.min(oldest).alias("o")).select(key, F.col(f"o.{value}").alias("gives"), (F.col(f"o.{at_us}") + span_us - now_us).alias("wait_us"))


def wait_until_fits(df: DataFrame, key: str, at_us: str, value: str, span_us: int, now_us: int, free: float, need: float) -> DataFrame:
    """Per key how long until ``need`` fits into ``free`` less what its rows in the span hold, rows ageing
    out oldest first: 0 if it fits now, null if it never will. Keys without recent rows have no row."""
    recent = df.filter((F.col(at_us) > now_us - span_us) & (F.col(at_us) <= now_us))
    total = recent.groupBy(key).agg(F.sum(value).alias("__used"))
    gone = recent.groupBy(key, at_us).agg(F.sum(value).alias("__v")).withColumn("__gone", F.sum("__v").over(Window.partitionBy(key).orderBy(at_us)))
    fits = gone.join(total, key).filter(free - (F.col("__used") - F.col("__gone")) >= need).groupBy(key).agg((F.min(at_us) + span_us - now_us).alias("__later"))
    now_ok = free - F.col("__used") >= need
    return total.join(fits, key, "left").select(key, F.when(now_ok, F.lit(0)).otherwise(F.col("__later")).alias("wait_us"))


def day_events(df: DataFrame, at: str, event: str) -> DataFrame:
    """Rows per UTC day (as text) and event; rows without a time have no day."""
    return df.groupBy(F.to_date(at).cast("string").alias("day"), event).agg(F.count("*").alias("n"))


def daily_counts(df: DataFrame, at: str, event: str, events: Sequence[str] | None = None) -> DataFrame:
    """Rows per UTC day, one column for each event; name the events to save the pass that finds them."""
    return df.filter(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day")).pivot(event, list(events) if events else None).count().fillna(0)


def detail_counts(df: DataFrame, detail: str) -> DataFrame:
    """Rows by detail, null as '(none)'."""
    return df.groupBy(F.coalesce(F.col(detail).cast("string"), F.lit("(none)")).alias("detail")).agg(F.count("*").alias("n"))


def idle(df: DataFrame, key: str, last: str, keep_us: int, now: str) -> DataFrame:
    """Keys whose last activity is at least ``keep_us`` before ``now`` (a UTC time stamp), with that activity."""
    seen = df.groupBy(key).agg(F.max(last).alias("last"))
    return seen.filter(F.col("last").isNotNull() & (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last") >= keep_us))
