"""Queries: texts that look the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.llm.canon import HYPHENS, LOOKALIKES, lookalike_classes, lookalike_pairs, records_of, with_canonical
from murmurlake.sources.tables import table


def _texts(spark: SparkSession, root: str) -> DataFrame:
    cues = records_of(table(spark, root, "cues"), "cue_id", ["transcript_id", "text"])
    flags = records_of(table(spark, root, "flags"), "flag_id", ["transcript_id", "span"])
    return cues.select(F.lit("cue").alias("pair_of"), "transcript_id", F.col("cue_id").alias("id"), "text").unionByName(
        flags.select(F.lit("flag").alias("pair_of"), "transcript_id", F.col("flag_id").alias("id"), F.col("span").alias("text"))
    )


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return lookalike_pairs(_texts(spark, root), ["pair_of", "transcript_id"], "id", "text").select("pair_of", "id_a", "id_b")


def p3_classes(spark: SparkSession, root: str) -> DataFrame:
    """The same as classes: every cue and flag that has a look-alike, its class, and how many it has."""
    return lookalike_classes(_texts(spark, root), ["pair_of", "transcript_id"], "id", "text").select(F.col("pair_of").alias("text_of"), "id", "class_id", "links")


def p3_forms(spark: SparkSession, root: str) -> DataFrame:
    """Every cue and flag with the consistent form of its text."""
    return with_canonical(_texts(spark, root), "text", "form").select(F.col("pair_of").alias("text_of"), "id", "form")


def _form_sql(x: str) -> str:
    """The canonical form in SQL, by tables alone: enough for texts whose look-alikes are not composed."""
    wide = {chr(n): chr(n - 0xFEE0) for n in range(0xFF01, 0xFF5F)}
    blanks = {c: " " for c in "\t\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"}
    table_ = {**wide, **LOOKALIKES, **{h: "-" for h in HYPHENS}, **blanks}
    for joined, apart in (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl")):
        x = f"replace({x}, '{joined}', '{apart}')"
    x = f"regexp_replace({x}, '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g')"
    quoted = ["".join(side).replace("'", "''") for side in (table_.keys(), table_.values())]
    return f"trim(nfc_normalize(translate({x}, '{quoted[0]}', '{quoted[1]}')), ' ' || chr(10))"


_TEXTS_SQL = f"""
WITH t AS (
  SELECT 'cue' AS of, transcript_id, cue_id AS id, text FROM (SELECT DISTINCT ON (cue_id) * FROM cues)
  UNION ALL SELECT 'flag', transcript_id, flag_id, span FROM (SELECT DISTINCT ON (flag_id) * FROM flags)),
f AS (SELECT *, {_form_sql('text')} AS form FROM t)
"""
QUERIES = {"p3_found": p3_found, "p3_forms": p3_forms, "p3_classes": p3_classes}
ORACLES = {
    "p3_found": _TEXTS_SQL
    + """SELECT a.of AS pair_of, a.id AS id_a, b.id AS id_b FROM f a
    JOIN f b ON a.of = b.of AND a.transcript_id = b.transcript_id AND a.form = b.form AND a.id < b.id
    WHERE a.text <> b.text AND a.text <> '' AND b.text <> ''""",
    "p3_classes": _TEXTS_SQL
    + """, g AS (SELECT *, min(id) OVER w AS class_id, count(*) OVER w - count(*) OVER (PARTITION BY of, transcript_id, form, text) AS links FROM f
      WHERE text <> '' WINDOW w AS (PARTITION BY of, transcript_id, form))
    SELECT of AS text_of, id, class_id, links FROM g WHERE links > 0""",
    "p3_forms": _TEXTS_SQL + "SELECT of AS text_of, id, form FROM f",
}
