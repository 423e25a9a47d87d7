"""Queries over detectors and their merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.functions import phonetic as P
from murmurlake.functions import text as T
from murmurlake.operators import detect as D
from murmurlake.operators import tokens as O
from murmurlake.operators import vocab as V
from murmurlake.operators.records import once
from murmurlake.plans import tokens as q
from murmurlake.session import materialise
from murmurlake.sources.tables import table


def _inputs(spark: SparkSession, root: str) -> D.Inputs:
    w = materialise(O.words(table(spark, root, "cues")))
    freq = materialise(O.frequencies(O.with_clean(w)))
    terms = table(spark, root, "transcripts").select(F.explode(T.list_terms(F.col("priming_terms"))).alias("term"))
    return D.inputs(w, terms, freq)


def oov_flags(spark: SparkSession, root: str) -> DataFrame:
    out = D.out_of_vocabulary(_inputs(spark, root))
    return out.select("transcript_id", "lo", "span", "reason", F.array_join("candidates", "|").alias("candidates"), "confidence")


def sounds_like_term_flags(spark: SparkSession, root: str) -> DataFrame:
    return D.sounds_like_term(_inputs(spark, root))


def sounds_like_own_flags(spark: SparkSession, root: str) -> DataFrame:
    return D.sounds_like_own(_inputs(spark, root))


def split_word_flags(spark: SparkSession, root: str) -> DataFrame:
    return D.split_word(_inputs(spark, root))


def detected_flags(spark: SparkSession, root: str) -> DataFrame:
    """The whole pipeline: words, vocabularies, four detectors, merge, context."""
    return D.detect(_inputs(spark, root))


def learned_terms(spark: SparkSession, root: str) -> DataFrame:
    return _inputs(spark, root).variants


def learned_candidates(spark: SparkSession, root: str) -> DataFrame:
    w = O.with_clean(O.words(table(spark, root, "cues")))
    terms = table(spark, root, "transcripts").select(F.explode(T.list_terms(F.col("priming_terms"))).alias("term"))
    rows = V.learnable(w, V.vocabulary(terms)[0], O.frequencies(w))
    return rows.filter(F.col("n") >= V.LEARN_COUNT).select("transcript_id", "cleaned", "n", "first_gi", "display")


def merged_flags(spark: SparkSession, root: str) -> DataFrame:
    """The stored flags with overlapping ones merged."""
    flags = q.flag_spans(table(spark, root, "flags")).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    flags = flags.withColumns({c: F.coalesce(c, F.lit("")) for c in ("detector", "reason")}).withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    out = D.merge(flags.select(*D.COLUMNS), O.words(table(spark, root, "cues")))
    return out.select("transcript_id", "lo", "hi", "cue_index", "start_us", "end_us", "detector", F.round("confidence", 3).alias("confidence"))


def split_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Windows of neighbouring words that could be fragments of one word."""
    return D.split_windows(_inputs(spark, root)).select("transcript_id", "lo", "hi", "joined", "ordinary", "uncommon")


def spelling_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Similarity of every learned variant and its canonical spelling."""
    d = table(spark, root, "doc_vocab").filter("variant IS NOT NULL AND canonical IS NOT NULL").select("variant", "canonical").distinct()
    return d.select("variant", "canonical", F.round(P.similarity(F.col("variant"), F.col("canonical")), 6).alias("score"))


def term_codes(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "doc_vocab").filter("canonical IS NOT NULL").select("canonical").distinct()
    return P.with_codes(d, "canonical")


_TERMS = rf"""
p AS (SELECT DISTINCT trim(x, '{q._EDGE}' || ' ' || chr(9) || chr(10)) AS display FROM (
  SELECT unnest(regexp_split_to_array(priming_terms, '[,\n]')) AS x FROM transcripts)),
terms AS (SELECT {q.CLEAN.replace('word', 'display')} AS cleaned, min(display) AS display FROM p
  WHERE display <> '' AND NOT regexp_matches(display, '\s') GROUP BY 1),
cw AS (SELECT *, {q.CLEAN} AS cleaned, {q.WORDLIKE} AS wordlike FROM w),
k AS (SELECT cleaned, count(*) AS n, count(DISTINCT transcript_id) AS records FROM cw WHERE cleaned <> '' GROUP BY cleaned),
freq AS (SELECT cleaned, log10(n / (SELECT sum(n) FROM k) * 1e9) AS zipf FROM k WHERE records >= 3),
stop AS (SELECT unnest([{", ".join("'" + s.replace("'", "''") + "'" for s in T.STOPWORDS)}]) AS cleaned)
"""
_LEARN_SQL = (
    q.WORDS_SQL
    + ","
    + _TERMS
    + rf""", learnable AS (
  SELECT transcript_id, cleaned, count(*) AS n, min(global_index) AS first_gi,
         arg_min(coalesce(nullif(trim(word, '{q._EDGE}'), ''), word), global_index) AS display
  FROM cw WHERE wordlike AND length(cleaned) >= 3 AND cleaned NOT IN (SELECT cleaned FROM stop)
    AND cleaned NOT IN (SELECT cleaned FROM terms) AND cleaned NOT IN (SELECT cleaned FROM freq WHERE zipf >= 3.0)
  GROUP BY transcript_id, cleaned)
"""
)

QUERIES = {
    "oov_flags": oov_flags,
    "sounds_like_term_flags": sounds_like_term_flags,
    "sounds_like_own_flags": sounds_like_own_flags,
    "split_word_flags": split_word_flags,
    "detected_flags": detected_flags,
    "learned_terms": learned_terms,
    "learned_candidates": learned_candidates,
    "merged_flags": merged_flags,
    "split_candidates": split_candidates,
    "spelling_pairs": spelling_pairs,
    "term_codes": term_codes,
}
ORACLES = {
    "spelling_pairs": f"""WITH d AS (SELECT DISTINCT variant, canonical FROM doc_vocab WHERE variant IS NOT NULL AND canonical IS NOT NULL)
    SELECT variant, canonical, round({q.jw_sql('variant', 'canonical')}, 6) AS score FROM d""",
    "learned_candidates": _LEARN_SQL + "SELECT * FROM learnable WHERE n >= 3",
    "split_candidates": q.WORDS_SQL
    + ","
    + _TERMS
    + """, f AS (SELECT cw.*, coalesce(zipf, 0) AS zipf, wordlike AND cleaned <> '' AND cleaned NOT IN (SELECT cleaned FROM stop)
            AND (length(cleaned) <= 5 OR coalesce(zipf, 0) < 3.0) AS ok FROM cw LEFT JOIN freq USING (cleaned)),
    two AS (SELECT transcript_id, a.global_index AS lo, b.global_index AS hi, a.cleaned || b.cleaned AS joined,
              least(a.zipf, b.zipf) AS z FROM f a JOIN f b USING (transcript_id, cue_id)
            WHERE b.global_index = a.global_index + 1 AND a.ok AND b.ok),
    three AS (SELECT transcript_id, a.global_index AS lo, c.global_index AS hi, a.cleaned || b.cleaned || c.cleaned AS joined,
              least(a.zipf, b.zipf, c.zipf) AS z FROM f a JOIN f b USING (transcript_id, cue_id) JOIN f c USING (transcript_id, cue_id)
            WHERE b.global_index = a.global_index + 1 AND c.global_index = a.global_index + 2 AND a.ok AND b.ok AND c.ok)
    SELECT transcript_id, lo, hi, joined, z >= 4.5 AS ordinary, z < 3.0 AS uncommon
    FROM (SELECT * FROM two UNION ALL SELECT * FROM three) WHERE length(joined) > 3""",
    "merged_flags": """
    WITH f AS (SELECT DISTINCT ON (flag_id) *, list_min(global_indices) AS lo, list_max(global_indices) AS hi FROM flags WHERE len(global_indices) > 0),
    m AS (SELECT *, max(hi) OVER (PARTITION BY transcript_id ORDER BY lo, hi, flag_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY transcript_id ORDER BY lo, hi, flag_id ROWS UNBOUNDED PRECEDING) AS island FROM m),
    d AS (SELECT *, unnest(string_split(coalesce(detector, ''), '+')) AS one FROM i)
    SELECT transcript_id, min(lo)::BIGINT AS lo, max(hi)::BIGINT AS hi, min(cue_index) AS cue_index, min(start_us) AS start_us, max(end_us) AS end_us,
      CASE WHEN count(DISTINCT flag_id) = 1 THEN any_value(coalesce(detector, '')) ELSE string_agg(DISTINCT one, '+' ORDER BY one) END AS detector,
      round(CASE WHEN count(DISTINCT flag_id) = 1 THEN any_value(coalesce(confidence, 0))
                 ELSE least(0.98, max(coalesce(confidence, 0)) + 0.05 * (count(DISTINCT one) - 1)) END, 3) AS confidence
    FROM d GROUP BY transcript_id, island""",
}
