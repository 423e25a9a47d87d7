"""Queries over words, frequencies, sentences and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.functions import text as T
from murmurlake.operators import tokens as O
from murmurlake.operators.records import once
from murmurlake.sources.tables import table


def _words(spark: SparkSession, root: str) -> DataFrame:
    return O.words(table(spark, root, "cues"))


def word_positions(spark: SparkSession, root: str) -> DataFrame:
    return _words(spark, root).select("transcript_id", "cue_id", "char_offset", "global_index", "word")


def word_forms(spark: SparkSession, root: str) -> DataFrame:
    """Distinct surfaces with their clean form, fitness for detectors and possessive base."""
    d = O.with_clean(_words(spark, root).select("word").distinct())
    return d.select("word", T.trim_edges(F.col("word")).alias("trimmed"), "cleaned", "wordlike", T.possessive_base(F.col("cleaned")).alias("base"), T.letters(F.col("word")).alias("letters"))


def zipf_table(spark: SparkSession, root: str) -> DataFrame:
    return O.frequencies(O.with_clean(_words(spark, root))).select("cleaned", "n", F.round("zipf", 6).alias("zipf"))


def sentence_spans(spark: SparkSession, root: str) -> DataFrame:
    s = O.sentences(_words(spark, root))
    return s.select("transcript_id", "sentence_no", "first_gi", "last_gi", F.array_join("words", " ").alias("sentence"))


def flag_contexts(spark: SparkSession, root: str) -> DataFrame:
    spans = flag_spans(table(spark, root, "flags"))
    return O.contexts(_words(spark, root), spans, "flag_id")


def flag_spans(flags: DataFrame) -> DataFrame:
    """Flags with their extent lo..hi; flags without indices are left out, each flag counts once."""
    rows = once(flags, "flag_id").filter(F.size("global_indices") > 0)
    return rows.withColumns({"lo": F.array_min("global_indices").cast("bigint"), "hi": F.array_max("global_indices").cast("bigint")})


def capitalised_names(spark: SparkSession, root: str) -> DataFrame:
    return O.name_like(_words(spark, root)).filter("name_like").select("transcript_id", "global_index", "word")


def caption_lines(spark: SparkSession, root: str) -> DataFrame:
    """The time line of every cue in both caption formats and as a player shows it."""
    c = once(table(spark, root, "cues"), "cue_id").filter("start_us IS NOT NULL AND end_us IS NOT NULL")
    s, e = F.col("start_us"), F.col("end_us")
    return c.select("cue_id", F.concat(T.caption_time(s), F.lit(" --> "), T.caption_time(e)).alias("srt"), F.concat(T.caption_time(s, "."), F.lit(" --> "), T.caption_time(e, ".")).alias("vtt"), T.player_time(s).alias("player"), T.wait_text(s).alias("wait"), T.parse_time(T.caption_time(s)).alias("parsed_us"))


def marked_contexts(spark: SparkSession, root: str) -> DataFrame:
    f = once(table(spark, root, "flags"), "flag_id").filter("context IS NOT NULL AND span IS NOT NULL")
    return f.select("flag_id", T.highlight(F.col("context"), F.col("span")).alias("html"))


def priming_lists(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "transcripts").select("transcript_id", "priming_terms").distinct()
    return t.select("transcript_id", F.explode(T.list_terms(F.col("priming_terms"))).alias("term")).distinct()


def align_forms(spark: SparkSession, root: str) -> DataFrame:
    t = once(table(spark, root, "nlp_tokens").select("token_id", "token"), "token_id").filter("token IS NOT NULL")
    return t.select("token_id", F.array_join(T.align_words(F.col("token")), " ").alias("forms"))


def token_seconds(spark: SparkSession, root: str) -> DataFrame:
    t = once(table(spark, root, "nlp_tokens").select("token_id", "ts", "endts"), "token_id")
    return t.select("token_id", T.lenient_seconds(F.col("ts")).alias("start_s"), T.lenient_seconds(F.col("endts")).alias("end_s"))


_BL = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_EDGE = T.EDGE.replace("'", "''")
WORDS_SQL = rf"""
WITH c AS (SELECT DISTINCT ON (cue_id) * FROM cues WHERE text IS NOT NULL),
g AS (
  SELECT transcript_id, cue_id, cue_order, cue_index, start_us, end_us,
         unnest(regexp_extract_all(text, '([{_BL}]*)([^{_BL}]+)', 1)) AS gap,
         unnest(regexp_extract_all(text, '([{_BL}]*)([^{_BL}]+)', 2)) AS word,
         generate_subscripts(regexp_extract_all(text, '([{_BL}]*)([^{_BL}]+)', 2), 1) AS pos FROM c),
w AS (
  SELECT transcript_id, cue_id, cue_order, cue_index, start_us, end_us, word,
         (sum(length(gap) + length(word)) OVER (PARTITION BY cue_id ORDER BY pos) - length(word))::INT AS char_offset,
         row_number() OVER (PARTITION BY transcript_id ORDER BY cue_order, cue_id, pos) - 1 AS global_index FROM g)
"""
CLEAN = f"replace(lower(trim(word, '{_EDGE}')), 'ß', 'ss')"
_CORE = f"trim(word, '{_EDGE}')"


def jw_sql(x: str, y: str) -> str:
    """The similarity of two texts; the engine's own works on bytes, so every character beyond ASCII is first
    written as a control character, the same in both texts."""
    odd = f"list_distinct(regexp_extract_all({x} || {y}, '[^\\x00-\\x7F]'))"
    plain = [f"array_to_string(list_transform(regexp_extract_all({t}, '(?s).'), lambda c: CASE WHEN list_position({odd}, c) > 0 THEN chr((13 + list_position({odd}, c))::INT) ELSE c END), '')" for t in (x, y)]
    return f"jaro_winkler_similarity({plain[0]}, {plain[1]})"


def _caps(x: str) -> str:
    return f"(upper({x}) = {x} AND lower({x}) <> {x})"


_SINGLE = f"(CASE WHEN {_CORE} LIKE '%s' THEN left({_CORE}, length({_CORE}) - 1) ELSE {_CORE} END)"
WORDLIKE = rf"""(length({_CORE}) >= 2 AND NOT regexp_matches({_CORE}, '\p{{Nd}}') AND regexp_matches({_CORE}, '\p{{L}}')
  AND NOT ({_caps(_CORE)} AND length({_CORE}) <= 4) AND NOT ({_caps(_SINGLE)} AND length({_SINGLE}) BETWEEN 2 AND 4))"""
SENTENCES_SQL = (
    WORDS_SQL
    + r""",
s AS (
  SELECT *, coalesce(sum(CASE WHEN regexp_matches(word, '[.!?]$') THEN 1 ELSE 0 END) OVER (
      PARTITION BY transcript_id ORDER BY global_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence_no FROM w)
"""
)


def _hms(us: str, sep: str) -> str:
    ms = f"(({us} + 500) // 1000)"
    return f"printf('%02d:%02d:%02d{sep}%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;')"

QUERIES = {
    "word_positions": word_positions,
    "word_forms": word_forms,
    "zipf_table": zipf_table,
    "sentence_spans": sentence_spans,
    "flag_contexts": flag_contexts,
    "capitalised_names": capitalised_names,
    "caption_lines": caption_lines,
    "marked_contexts": marked_contexts,
    "priming_lists": priming_lists,
    "align_forms": align_forms,
    "token_seconds": token_seconds,
}
ORACLES = {
    "word_positions": WORDS_SQL + "SELECT transcript_id, cue_id, char_offset, global_index, word FROM w",
    "word_forms": WORDS_SQL
    + rf"""SELECT DISTINCT word, {_CORE} AS trimmed, {CLEAN} AS cleaned, {WORDLIKE} AS wordlike,
      CASE WHEN regexp_matches({CLEAN}, '[''’]s$') THEN left({CLEAN}, length({CLEAN}) - 2) END AS base,
      lower(regexp_replace(word, '[^\p{{L}}\p{{Nd}}]', '', 'g')) AS letters FROM w""",
    "zipf_table": WORDS_SQL
    + f""", t AS (SELECT {CLEAN} AS cleaned, transcript_id FROM w),
    k AS (SELECT cleaned, count(*) AS n, count(DISTINCT transcript_id) AS records FROM t WHERE cleaned <> '' GROUP BY cleaned)
    SELECT cleaned, n, round(log10(n / (SELECT sum(n) FROM k) * 1e9), 6) AS zipf FROM k WHERE records >= 3""",
    "sentence_spans": SENTENCES_SQL
    + """SELECT transcript_id, sentence_no, min(global_index) AS first_gi, max(global_index) AS last_gi,
      string_agg(word, ' ' ORDER BY global_index) AS sentence FROM s GROUP BY transcript_id, sentence_no""",
    "flag_contexts": SENTENCES_SQL
    + """, f AS (SELECT DISTINCT ON (flag_id) flag_id, transcript_id, list_min(global_indices) AS lo, list_max(global_indices) AS hi
            FROM flags WHERE len(global_indices) > 0),
    e AS (SELECT f.*, a.sentence_no AS sa, b.sentence_no AS sb FROM f
          JOIN s a ON a.transcript_id = f.transcript_id AND a.global_index = f.lo
          JOIN s b ON b.transcript_id = f.transcript_id AND b.global_index = f.hi),
    n AS (SELECT e.flag_id, e.lo, e.hi, s.global_index, s.word, count(*) OVER (PARTITION BY e.flag_id) AS k
          FROM e JOIN s ON s.transcript_id = e.transcript_id AND s.sentence_no BETWEEN e.sa AND e.sb)
    SELECT flag_id, string_agg(word, ' ' ORDER BY global_index) AS context FROM n
    WHERE k <= 40 OR global_index BETWEEN lo - 15 AND hi + 15 GROUP BY flag_id""",
    "capitalised_names": WORDS_SQL
    + rf""", p AS (SELECT *, regexp_replace(lag(word) OVER (PARTITION BY transcript_id ORDER BY global_index), '["'')\]”’]+$', '') AS former FROM w)
    SELECT transcript_id, global_index, word FROM p
    WHERE {_CORE} <> '' AND {_caps(f"left({_CORE}, 1)")} AND NOT {_caps(_CORE)} AND former IS NOT NULL AND NOT regexp_matches(former, '[.!?]$')""",
    "caption_lines": f"""
    WITH c AS (SELECT DISTINCT ON (cue_id) * FROM cues)
    SELECT cue_id, {_hms('start_us', ',')} || ' --> ' || {_hms('end_us', ',')} AS srt, {_hms('start_us', '.')} || ' --> ' || {_hms('end_us', '.')} AS vtt,
      CASE WHEN start_us >= 3600000000 THEN printf('%d:%02d:%02d', start_us // 3600000000, (start_us // 60000000) % 60, (start_us // 1000000) % 60)
           ELSE printf('%d:%02d', start_us // 60000000, (start_us // 1000000) % 60) END AS player,
      CASE WHEN m < 60 THEN printf('%d min', m) WHEN m % 60 = 0 THEN printf('%d h', m // 60) ELSE printf('%d h %d min', m // 60, m % 60) END AS wait,
      ((start_us + 500) // 1000) * 1000 AS parsed_us
    FROM (SELECT *, (start_us + 59999999) // 60000000 AS m FROM c WHERE start_us IS NOT NULL AND end_us IS NOT NULL)""",
    "marked_contexts": f"""
    WITH f AS (SELECT DISTINCT ON (flag_id) flag_id, {_ESC.format('context')} AS t, {_ESC.format('span')} AS m FROM flags WHERE context IS NOT NULL AND span IS NOT NULL)
    SELECT flag_id, CASE WHEN m <> '' AND instr(t, m) > 0 THEN left(t, instr(t, m) - 1) || '<mark>' || m || '</mark>' || substr(t, instr(t, m) + length(m)) ELSE t END AS html FROM f""",
    "priming_lists": r"""
    SELECT DISTINCT transcript_id, term FROM (SELECT transcript_id, trim(unnest(regexp_split_to_array(priming_terms, '[,\n]')), ' ' || chr(9) || chr(10) || chr(13)) AS term FROM transcripts) WHERE term <> ''""",
    "align_forms": r"""
    WITH t AS (SELECT DISTINCT ON (token_id) token_id, token FROM nlp_tokens WHERE token IS NOT NULL)
    SELECT token_id, array_to_string(list_filter(list_transform(
      regexp_split_to_array(regexp_replace(replace(lower(token), '-', ' '), '[^\p{L}\p{Nd}_ ''.]', '', 'g'), '\s+'), lambda x: trim(x, '''.')), lambda x: x <> ''), ' ') AS forms FROM t""",
    "token_seconds": """
    WITH t AS (SELECT DISTINCT ON (token_id) * FROM nlp_tokens) SELECT token_id, try_cast(ts AS DOUBLE) AS start_s, try_cast(endts AS DOUBLE) AS end_s FROM t""",
}
