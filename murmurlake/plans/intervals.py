"""Queries of the interval operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.operators.intervals import periods_and_gaps
from murmurlake.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    both = None
    for name, of in (("cues", "cue"), ("flags", "flag")):
        part = table(spark, root, name).select(F.lit(of).alias("interval_of"), "transcript_id", "start_us", "end_us")
        both = part if both is None else both.unionByName(part)
    out = periods_and_gaps(both, ["interval_of", "transcript_id"], "start_us", "end_us")
    return out.select("interval_of", "kind", "transcript_id", "start_us", "end_us")


P1_SQL = """
WITH i AS (
  SELECT 'cue' AS interval_of, transcript_id, start_us AS s, end_us AS e FROM cues WHERE end_us > start_us
  UNION ALL SELECT 'flag', transcript_id, start_us, end_us FROM flags WHERE end_us > start_us),
m AS (
  SELECT *, max(e) OVER (PARTITION BY interval_of, transcript_id ORDER BY s, e
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
n AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (
           PARTITION BY interval_of, transcript_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (
  SELECT interval_of, transcript_id, island, min(s) AS s, max(e) AS e FROM n GROUP BY ALL),
g AS (
  SELECT interval_of, transcript_id, e AS s,
         lead(s) OVER (PARTITION BY interval_of, transcript_id ORDER BY s) AS e FROM p)
SELECT interval_of, 'period' AS kind, transcript_id, s AS start_us, e AS end_us FROM p
UNION ALL SELECT interval_of, 'gap', transcript_id, s, e FROM g WHERE e IS NOT NULL
"""

QUERIES = {"p1_found": p1_found}
ORACLES = {"p1_found": P1_SQL}
