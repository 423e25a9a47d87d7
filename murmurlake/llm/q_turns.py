"""Queries: speaker turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.llm.boundaries import adjacent, decided, decided_turns, fit_on, labelled
from murmurlake.llm.turns import aliases, cue_features, cue_marks, spoken_words, token_marks, turns
from murmurlake.session import materialise
from murmurlake.sources.tables import table

#: The most plain hesitation forms that are taken into the workers' pattern.
MAX_FORMS = 10_000


def _forms(spark: SparkSession, root: str) -> list[str]:
    rows = table(spark, root, "fillers").select("form").filter(F.col("form").isNotNull()).distinct().limit(MAX_FORMS + 1).collect()
    if len(rows) > MAX_FORMS:
        raise ValueError(f"more than {MAX_FORMS} hesitation forms")
    return sorted(r["form"] for r in rows)


def _cues(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "cues").select(F.col("transcript_id").alias("owner"), F.col("start_us").alias("o1"), F.col("cue_order").cast("bigint").alias("o2"), F.col("cue_id").alias("id"), F.col("end_us").alias("ends"), "text")


def _tokens(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "nlp_tokens").filter(F.col("side") == "hypothesis")
    return rows.select(F.col("call_id").alias("owner"), F.col("pos").cast("bigint").alias("o1"), F.lit(0).cast("bigint").alias("o2"), F.col("token_id").alias("id"), "token", "speaker")


def _roster(spark: SparkSession, root: str) -> DataFrame:
    return materialise(aliases(table(spark, root, "speakers")))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    forms, roster = _forms(spark, root), _roster(spark, root)
    return turns(materialise(cue_marks(_cues(spark, root), roster, forms).unionByName(token_marks(_tokens(spark, root), roster, forms))))


def labelled_pairs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(all steps between neighbouring cues, those whose change of speaker the labels tell)."""
    forms, roster = _forms(spark, root), _roster(spark, root)
    pairs = materialise(adjacent(materialise(cue_features(_cues(spark, root), forms))))
    return pairs, labelled(pairs, spoken_words(materialise(cue_marks(_cues(spark, root), roster, forms))))


def _decisions(spark: SparkSession, root: str) -> DataFrame:
    pairs, known = labelled_pairs(spark, root)
    unlabelled = pairs.join(_roster(spark, root).select("owner").distinct(), "owner", "left_anti")
    return decided(unlabelled, fit_on(known))


def p4_boundaries(spark: SparkSession, root: str) -> DataFrame:
    """Boosted decisions for the cues of transcripts without a roster, fitted on those with one."""
    return _decisions(spark, root).filter("former_id IS NOT NULL").select(F.col("owner").alias("transcript_id"), F.col("id").alias("cue_id"), F.round("probability", 6).alias("probability"), "changes")


def p4_turns(spark: SparkSession, root: str) -> DataFrame:
    """Turns of the transcripts without a roster, between the boosted decisions."""
    return decided_turns(_decisions(spark, root)).withColumn("probability", F.round("probability", 6))


QUERIES = {"p4_found": p4_found, "p4_boundaries": p4_boundaries, "p4_turns": p4_turns}
ORACLES: dict = {}
