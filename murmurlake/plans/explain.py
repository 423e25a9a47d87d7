"""Queries over what is shown with flags, and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.functions import text as T
from murmurlake.operators import explain as X
from murmurlake.operators import tokens as O
from murmurlake.operators.records import once
from murmurlake.operators.score import is_cold
from murmurlake.plans import repair as r
from murmurlake.plans import tokens as q
from murmurlake.session import materialise
from murmurlake.sources.tables import table


def _flags(spark: SparkSession, root: str) -> DataFrame:
    f = once(table(spark, root, "flags"), "flag_id")
    return f.withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))


def flag_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return X.around(_flags(spark, root), table(spark, root, "cues"))


def related_words(spark: SparkSession, root: str) -> DataFrame:
    return X.related(_flags(spark, root), O.with_clean(O.words(table(spark, root, "cues"))))


def flag_batches(spark: SparkSession, root: str) -> DataFrame:
    return X.batches(q.flag_spans(table(spark, root, "flags"))).select("flag_id", "transcript_id", "batch_no")


def sure_flags(spark: SparkSession, root: str) -> DataFrame:
    return X.is_sure(_flags(spark, root)).select("flag_id", "sure")


def report_lines(spark: SparkSession, root: str) -> DataFrame:
    # the rows that its SQL defines; the operator has a line for every flag
    f = _flags(spark, root).filter("context IS NOT NULL AND span IS NOT NULL AND span <> '' AND start_us IS NOT NULL")
    return X.report_lines(f)


def markdown_rows(spark: SparkSession, root: str) -> DataFrame:
    return X.markdown_rows(_flags(spark, root))


def request_estimates(spark: SparkSession, root: str) -> DataFrame:
    c = once(table(spark, root, "chunk_requests"), "request_id")
    texts = F.array_compact(F.array("before", "after", F.array_join(F.transform("words", lambda w: w["word"]), " ")))
    return c.select("request_id", X.request_tokens(texts).alias("tokens"))


def transcript_lengths(spark: SparkSession, root: str) -> DataFrame:
    return X.lengths(table(spark, root, "cues"))


def call_split(spark: SparkSession, root: str) -> DataFrame:
    return X.seeded_split(table(spark, root, "nlp_tokens").select("call_id").filter("call_id IS NOT NULL"), "call_id", 5, 10, 28)


def call_cases(spark: SparkSession, root: str) -> DataFrame:
    regions = materialise(r.aligned_regions(spark, root))
    return X.cases_from_regions(regions, once(table(spark, root, "nlp_tokens"), "token_id"))


def flag_json(spark: SparkSession, root: str) -> DataFrame:
    from murmurlake.sources.records import flag_json as as_json

    return as_json(_flags(spark, root)).select("flag_id", "json")


def cold_flags(spark: SparkSession, root: str) -> DataFrame:
    """Flags nobody has a candidate for, per transcript."""
    f = _flags(spark, root)
    return f.groupBy("transcript_id").agg(F.count("*").alias("flags"), F.count_if(is_cold(f)).alias("cold"))


def title_parts(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "transcripts").select("filename").filter("filename IS NOT NULL").distinct()
    return t.select("filename", F.array_join(T.title_phrases(F.regexp_replace("filename", r"[_.]", " - ")), "|").alias("phrases"))


_F = "WITH f AS (SELECT DISTINCT ON (flag_id) * FROM flags)"
QUERIES = {
    "flag_neighbours": flag_neighbours,
    "related_words": related_words,
    "flag_batches": flag_batches,
    "sure_flags": sure_flags,
    "report_lines": report_lines,
    "markdown_rows": markdown_rows,
    "request_estimates": request_estimates,
    "transcript_lengths": transcript_lengths,
    "call_split": call_split,
    "call_cases": call_cases,
    "flag_json": flag_json,
    "cold_flags": cold_flags,
    "title_parts": title_parts,
}
_EDGED = f"trim(span, '{q._EDGE}' || ' ' || chr(9) || chr(10))"
_SPAN = f"lower(coalesce(nullif({_EDGED}, ''), span))"
_JSON = [
    f"CASE WHEN {c} IS NOT NULL THEN '\"{n}\":' || to_json({c}) END"
    for n, c in (("span", "span"), ("global_indices", "global_indices"), ("cue_index", "cue_index"), ("start", "start_us / 1e6"), ("end", "end_us / 1e6"), ("detector", "detector"),
                 ("reason", "reason"), ("candidates", "candidates"), ("confidence", "confidence"), ("context", "context"))
]
_CELL = "replace(replace(coalesce({0}, ''), '|', '\\|'), chr(10), ' ')"
ORACLES = {
    "sure_flags": _F
    + f""", g AS (SELECT flag_id, detector, coalesce(candidates, []) AS cs, {_SPAN} AS s, lower(candidates[1]) AS a, lower(candidates[2]) AS b FROM f)
    SELECT flag_id, (detector = 'phonetic_internal' AND len(cs) > 0) AND (len(cs) = 1 OR {q.jw_sql('s', 'a')} - {q.jw_sql('s', 'b')} >= 0.15) AS sure FROM g""",
    "markdown_rows": _F
    + f""" SELECT flag_id, '| ' || concat_ws(' | ', {_CELL.format('span')}, {_CELL.format('candidates[1]')}, coalesce(round(confidence::DECIMAL(18, 9), 2)::DECIMAL(18, 2)::VARCHAR, ''),
      {_CELL.format('detector')}, {_CELL.format('context')}, '') || ' |' AS row FROM f""",
    "flag_json": "WITH f AS (SELECT DISTINCT ON (flag_id) * REPLACE (coalesce(candidates, []) AS candidates) FROM flags)"
    + f" SELECT flag_id, '{{' || array_to_string(list_filter([{', '.join(_JSON)}], lambda x: x IS NOT NULL), ',') || '}}' AS json FROM f",
    "call_split": """
    WITH c AS (SELECT DISTINCT call_id FROM nlp_tokens WHERE call_id IS NOT NULL),
    a AS (SELECT *, row_number() OVER (ORDER BY call_id) AS i, md5('28:' || call_id) AS lot FROM c),
    b AS (SELECT *, row_number() OVER (PARTITION BY i <= 5 ORDER BY lot, call_id) AS k FROM a)
    SELECT call_id, CASE WHEN i <= 5 THEN 'first' WHEN k <= 10 THEN 'sample' ELSE 'rest' END AS part FROM b""",
    "title_parts": r"""
    WITH t AS (SELECT DISTINCT filename FROM transcripts WHERE filename IS NOT NULL),
    p AS (SELECT filename, list_filter(list_transform(regexp_split_to_array(regexp_replace(filename, '[_.]', ' - ', 'g'), '\||\s[-–—]\s|:|,'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM t)
    SELECT filename, array_to_string(list_filter(ps, lambda x, i: list_position(list_transform(ps, lambda y: lower(y)), lower(x)) = i), '|') AS phrases FROM p""",
    "flag_neighbours": _F
    + """, c AS (SELECT DISTINCT ON (cue_id) * FROM cues),
    n AS (SELECT *, lag(text) OVER w AS before, lead(text) OVER w AS after, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY transcript_id ORDER BY cue_order, cue_id)),
    m AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY transcript_id, cue_index ORDER BY k) = 1)
    SELECT flag_id, before, m.text AS cue_text, after FROM f JOIN m USING (transcript_id, cue_index)""",
    "flag_batches": """
    WITH f AS (SELECT DISTINCT ON (flag_id) flag_id, transcript_id, list_min(global_indices) AS lo, list_max(global_indices) AS hi FROM flags WHERE len(global_indices) > 0)
    SELECT flag_id, transcript_id, ((row_number() OVER (PARTITION BY transcript_id ORDER BY lo, hi, flag_id) - 1) // 25)::INT AS batch_no FROM f""",
    "report_lines": _F
    + f""" SELECT flag_id, '[' || {q._hms('start_us', ',')} || '] ' ||
      CASE WHEN instr(context, span) > 0 THEN left(context, instr(context, span) - 1) || '»' || span || '«' || substr(context, instr(context, span) + length(span)) ELSE context END ||
      CASE WHEN len(candidates) > 0 THEN ' -> ' || candidates[1] || CASE WHEN len(candidates) > 1 THEN printf(' (+%d more)', len(candidates) - 1) ELSE '' END ELSE '' END AS line
    FROM (SELECT * REPLACE (coalesce(candidates, []) AS candidates) FROM f) WHERE context IS NOT NULL AND span IS NOT NULL AND span <> '' AND start_us IS NOT NULL""",
    "request_estimates": """
    WITH c AS (SELECT DISTINCT ON (request_id) * FROM chunk_requests)
    SELECT request_id, (coalesce(length(before), 0) // 4 + coalesce(length(after), 0) // 4 + coalesce(length(array_to_string(list_transform(words, lambda w: w.word), ' ')), 0) // 4)::INT AS tokens FROM c""",
    "transcript_lengths": rf"""
    WITH c AS (SELECT DISTINCT ON (cue_id) * FROM cues)
    SELECT transcript_id, count(*) AS cues, sum(coalesce(len(regexp_extract_all(text, '[^{q._BL}]+')), 0))::BIGINT AS words, max(end_us) AS last_us FROM c GROUP BY transcript_id""",
    "cold_flags": _F
    + """ SELECT transcript_id, count(*) AS flags, count_if(coalesce(list_contains(string_split(detector, '+'), 'oov') AND len(coalesce(candidates, [])) = 0, false)) AS cold FROM f GROUP BY transcript_id""",
}
