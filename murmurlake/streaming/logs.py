"""Structured Streaming over append-only logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

DAY_US = 86_400_000_000
#: A run may exceed what is left of an allowance by this share of it (fixed value).
GRACE = 0.2


def daily_counts(events: DataFrame, at: str = "at", event: str = "event", late: str = "1 day") -> DataFrame:
    """Events per UTC day; rows later than ``late`` behind the newest are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), event).count().select(F.to_date("w.start").alias("day"), event, "count")


def first_visits(events: DataFrame, session: str = "session", at: str = "at", late: str = "1 day") -> DataFrame:
    """The first row of every session within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([session])


def once_per_content(exports: DataFrame, key: list[str], at: str = "at", late: str = "1 day") -> DataFrame:
    """Rows whose key (say, transcript and content hash) was not seen within the watermark."""
    return exports.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


OUT = StructType([StructField("session", StringType()), StructField("at_us", LongType()), StructField("asked", LongType()), StructField("charged", LongType()), StructField("left", LongType())])
ENTRY = StructType([StructField("at_us", LongType()), StructField("words", LongType())])


class Allowance(StatefulProcessor):
    """Words each session may still use in a rolling span: runs that fit are charged, others refused.

    A run fits if it needs no more than what is left plus the grace; it is charged at most what is left, so
    the balance never falls below 0. Entries out of the span are forgotten when the session returns.
    """

    def __init__(self, allowance: int, span_us: int = DAY_US):
        self.allowance, self.span = allowance, span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", ENTRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["at_us", "words"])
        kept = [(int(e[0]), int(e[1])) for e in self.entries.get()]
        out = []
        for at, words in zip(asked["at_us"], asked["words"]):
            at, words = int(at), int(words)
            kept = [(t, w) for t, w in kept if t > at - self.span]
            left = max(0, self.allowance - sum(w for _, w in kept))
            charge = min(words, left) if words <= left + GRACE * self.allowance else None
            if charge is not None:
                kept.append((at, charge))
                left -= charge
            out.append((key[0], at, words, charge, left))
        self.entries.clear()
        self.entries.put(kept)
        yield pd.DataFrame(out, columns=[f.name for f in OUT.fields]).astype({"charged": "Int64"})

    def close(self) -> None:
        pass


def allowances(runs: DataFrame, allowance: int, span_us: int = DAY_US) -> DataFrame:
    """Per run (session, at_us, words) what it is charged (null: refused) and what is left; needs the
    RocksDB state store."""
    return runs.groupBy("session").transformWithStateInPandas(Allowance(allowance, span_us), OUT, "append", "none")
