"""Queries: spam pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmurlake.llm.spam import find_spam, scan_pages, scored
from murmurlake.sources.tables import table


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return find_spam(table(spark, root, "documents"))


def p8_curves(spark: SparkSession, root: str) -> DataFrame:
    """Slope, residual and divergence of every page's rank-frequency curve, and the score they make."""
    return scored(scan_pages(table(spark, root, "documents"), "doc_id", "text", "lang")).select("doc_id", "lang", "slope", "residual", "divergence", "foreign", "share", "is_extreme")


QUERIES = {"p8_found": p8_found, "p8_curves": p8_curves}
ORACLES: dict = {}
