"""Queries: encoding of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmurlake.llm.encode import encode_texts
from murmurlake.sources.tables import table


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode_texts(table(spark, root, "documents"), "text", ["doc_id"])


QUERIES = {"p6_ids": p6_ids}
ORACLES: dict = {}
