"""Queries: pieces of oversized chunk requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmurlake.llm.pieces import OVERLAP, cut_items, with_surroundings
from murmurlake.sources.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return cut_items(table(spark, root, "chunk_requests"), "request_id").select("request_id", "piece_no", "first_gi", "last_gi")


def p2_bisected(spark: SparkSession, root: str) -> DataFrame:
    return cut_items(table(spark, root, "chunk_requests"), "request_id", method="bisection").select("request_id", "piece_no", "first_gi", "last_gi")


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces with their text and fitting ``before`` and ``after``."""
    df = table(spark, root, "chunk_requests")
    return with_surroundings(cut_items(df, "request_id"), df, "request_id", OVERLAP).drop("first_at", "last_at")


P2_SQL = """
WITH RECURSIVE r AS (
  SELECT DISTINCT ON (request_id) request_id, words FROM chunk_requests WHERE len(words) > 200),
w AS (
  SELECT request_id, len(words) AS n, words,
         list_transform(words, lambda x: CASE
           WHEN right(rtrim(coalesce(x.word, ''), '"'')]}”’»'), 1) IN ('.', '?', '!', '…') THEN 2
           WHEN right(rtrim(coalesce(x.word, ''), '"'')]}”’»'), 1) IN (',', ';', ':') THEN 1 ELSE 0 END) AS c FROM r),
k AS (
  SELECT request_id, 0 AS piece_no, -19 AS s, 0 AS e, n, c FROM w
  UNION ALL
  SELECT request_id, piece_no + 1, b, CASE WHEN n - b + 1 <= 200 THEN n ELSE coalesce(
      list_max(list_filter(range(greatest(b + 20, e + 1), b + 200), lambda j: c[j] = 2)),
      list_max(list_filter(range(greatest(b + 20, e + 1), b + 200), lambda j: c[j] = 1)),
      b + 199) END, n, c
  FROM (SELECT *, CASE WHEN piece_no = 0 THEN 1 ELSE e - 19 END AS b FROM k) WHERE e < n)
SELECT k.request_id, k.piece_no, w.words[k.s].gi AS first_gi, w.words[k.e].gi AS last_gi
FROM k JOIN w USING (request_id) WHERE k.piece_no > 0
"""

_HEAD, _CHAIN = P2_SQL.split("k AS (", 1)
_CHAIN, _ = _CHAIN.rsplit("SELECT k.request_id", 1)
_JOINED = "array_to_string(list_transform(w.words[{0}:{1}], lambda x: coalesce(x.word, '')), ' ')"
P2_PIECES_SQL = (
    f"{_HEAD}k AS ({_CHAIN}"
    + f"""
SELECT k.request_id, k.piece_no, w.words[k.s].gi AS first_gi, w.words[k.e].gi AS last_gi, {_JOINED.format('k.s', 'k.e')} AS text,
  CASE WHEN k.s = 1 THEN q.before ELSE {_JOINED.format('greatest(k.s - 20, 1)', 'k.s - 1')} END AS before,
  CASE WHEN k.e = k.n THEN q.after ELSE {_JOINED.format('k.e + 1', 'k.e + 20')} END AS after
FROM k JOIN w USING (request_id) JOIN (SELECT DISTINCT ON (request_id) * FROM chunk_requests) q USING (request_id) WHERE k.piece_no > 0"""
)
P2_BISECTED_SQL = (
    _HEAD
    + """
k AS (
  SELECT request_id, 0 AS lo, n - 1 AS hi, n, c FROM w
  UNION ALL
  SELECT request_id, CASE WHEN side = 0 THEN lo ELSE cut + 1 END, CASE WHEN side = 0 THEN cut ELSE hi END, n, c
  FROM (SELECT *, unnest([0, 1]) AS side FROM (
    SELECT *, list_sort(list_transform(CASE WHEN top > 0 THEN list_filter(range(a, b + 1), lambda j: c[j + 1] = top) ELSE [m] END, lambda j: {'far': abs(j - m), 'at': j}))[1].at AS cut
    FROM (SELECT *, list_max(c[a + 1:b + 1]) AS top
      FROM (SELECT *, greatest(lo, m - q) AS a, least(hi - 1, m + q) AS b
        FROM (SELECT *, lo + (hi - lo + 1) // 2 - 1 AS m, greatest(1, (hi - lo + 1) // 4) AS q FROM k WHERE hi - lo + 1 > 180)))))),
p AS (SELECT request_id, lo, hi, row_number() OVER (PARTITION BY request_id ORDER BY lo) AS piece_no FROM k WHERE hi - lo + 1 <= 180)
SELECT p.request_id, piece_no::INT AS piece_no, w.words[greatest(lo - 20, 0) + 1].gi AS first_gi, w.words[hi + 1].gi AS last_gi FROM p JOIN w USING (request_id)"""
)

QUERIES = {"p2_found": p2_found, "p2_bisected": p2_bisected, "p2_pieces": p2_pieces}
ORACLES = {"p2_found": P2_SQL, "p2_pieces": P2_PIECES_SQL, "p2_bisected": P2_BISECTED_SQL}
