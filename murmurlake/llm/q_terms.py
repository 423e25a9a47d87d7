"""Queries: frequency of every term."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.llm.terms import EDGE, TermCounts, marked, whole_term, words_of
from murmurlake.operators.records import once
from murmurlake.session import scratch_table
from murmurlake.sources.tables import table


def cue_terms(cues: DataFrame) -> DataFrame:
    rows = once(cues.select("cue_id", "transcript_id", "text").filter(F.col("text").isNotNull()), "cue_id")
    return rows.select(F.lit("cue").alias("field"), F.col("transcript_id").alias("owner"), F.explode(words_of(F.col("text"))).alias("term"), F.lit(1).cast("bigint").alias("n"))


def flag_terms(flags: DataFrame) -> DataFrame:
    rows = once(flags.select("flag_id", "transcript_id", "span").filter(F.col("span").isNotNull()), "flag_id")
    return rows.select(F.lit("flag").alias("field"), F.col("transcript_id").alias("owner"), whole_term(F.col("span")).alias("term"), F.lit(1).cast("bigint").alias("n"))


def vocab_terms(vocab: DataFrame) -> DataFrame:
    rows = vocab.filter("is_canonical").select("transcript_id", "variant", "canonical", "display", "counts").distinct()
    return rows.select(F.lit("vocab").alias("field"), F.col("transcript_id").alias("owner"), F.col("canonical").alias("term"), F.col("counts").alias("n"))


def all_terms(spark: SparkSession, root: str) -> DataFrame:
    parts = [cue_terms(table(spark, root, "cues")), flag_terms(table(spark, root, "flags")), vocab_terms(table(spark, root, "doc_vocab"))]
    return reduce(DataFrame.unionByName, parts)


def counted(spark: SparkSession, root: str) -> TermCounts:
    return TermCounts(spark, scratch_table(spark, "term-counts")).apply(all_terms(spark, root).withColumn("sign", F.lit(1)))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    state = counted(spark, root)
    return marked(state.counts(), state.records()).select("field", "term", "mark")


def p5_counts(spark: SparkSession, root: str) -> DataFrame:
    """Every term with its occurrences and transcripts."""
    return counted(spark, root).counts().select("field", "term", "total", "owners")


def p5_updated(spark: SparkSession, root: str) -> DataFrame:
    """``p5_counts`` reached by changes: a first load of most rows, some of them in a wrong form, then a change
    set that deletes the wrong forms and adds their right ones and the rows that were missing."""
    rows = all_terms(spark, root)
    lot = F.pmod(F.xxhash64("field", "owner", "term"), F.lit(10))
    wrong = F.concat("term", F.lit("?"))
    early = rows.filter(lot > 0).withColumn("term", F.when(lot == 1, wrong).otherwise(F.col("term")))
    fixed = rows.filter(lot == 1)
    late = reduce(DataFrame.unionByName, [fixed.withColumns({"term": wrong, "sign": F.lit(-1)}), fixed.withColumn("sign", F.lit(1)), rows.filter(lot == 0).withColumn("sign", F.lit(1))])
    state = TermCounts(spark, scratch_table(spark, "term-counts")).apply(early.withColumn("sign", F.lit(1))).apply(late)
    return state.counts().select("field", "term", "total", "owners")


_EDGE_SQL = EDGE.replace("'", "''")
_BLANK_SQL = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TERMS_SQL = rf"""
WITH c AS (SELECT DISTINCT ON (cue_id) cue_id, transcript_id, text FROM cues WHERE text IS NOT NULL),
f AS (SELECT DISTINCT ON (flag_id) flag_id, transcript_id, span FROM flags WHERE span IS NOT NULL),
t AS (
  SELECT 'cue' AS field, transcript_id AS owner, lower(trim(w, '{_EDGE_SQL}')) AS term, 1 AS n
  FROM (SELECT transcript_id, unnest(regexp_split_to_array(text, '{_BLANK_SQL}')) AS w FROM c)
  UNION ALL
  SELECT 'flag', transcript_id,
         lower(trim(regexp_replace(span, '^{_BLANK_SQL}|{_BLANK_SQL}$', '', 'g'), '{_EDGE_SQL}')), 1 FROM f
  UNION ALL
  SELECT 'vocab', transcript_id, canonical, coalesce(counts, 0)
  FROM (SELECT DISTINCT transcript_id, variant, canonical, display, counts FROM doc_vocab WHERE is_canonical)),
k AS (
  SELECT field, term, sum(n)::BIGINT AS total, count(DISTINCT owner) AS owners FROM t
  WHERE term IS NOT NULL AND (field = 'vocab' OR term <> '') GROUP BY field, term),
r AS (SELECT field, count(DISTINCT owner) AS records FROM t WHERE term IS NOT NULL AND (field = 'vocab' OR term <> '') GROUP BY field)
"""
P5_COUNTS_SQL = _TERMS_SQL + "SELECT field, term, total, owners FROM k"
P5_SQL = (
    _TERMS_SQL
    + """
SELECT field, term, 'rare' AS mark FROM k WHERE total < 3
UNION ALL SELECT field, term, 'common' FROM k JOIN r USING (field) WHERE owners * 2 > records
"""
)

QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts, "p5_updated": p5_updated}
ORACLES = {"p5_found": P5_SQL, "p5_counts": P5_COUNTS_SQL, "p5_updated": P5_COUNTS_SQL}
