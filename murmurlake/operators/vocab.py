"""Vocabularies: curated terms with their sound codes, and the terms each transcript teaches by repeating them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.functions import phonetic as P
from murmurlake.functions import text as T
from murmurlake.session import materialise

#: Thresholds that define the results (fixed values).
KNOWN_ZIPF = 3.0
OOV_ZIPF = 0.0
MIN_LENGTH = 3
LEARN_COUNT = 3
CLUSTER_SIMILARITY = 0.82
TRUST_COUNT = 6
NEIGHBOUR_SIMILARITY = 0.9
NEIGHBOUR_ZIPF = 1.5
NEIGHBOURS = 3


def vocabulary(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms: cleaned, display), (codes: code, term, joined, parts) from a table with column ``term``.

    One-word terms are members and sound like themselves; terms of several words only sound like their
    words run together. The alphabetically first spelling of equal terms is shown.
    """
    rows = terms.select(F.btrim("term", F.lit(T.SPAN_EDGE)).alias("display")).filter(F.col("display") != "").distinct()
    parts = F.transform(F.split("display", r"\s+"), T.clean)
    rows = rows.withColumn("parts", F.filter(parts, lambda p: p != "")).withColumn("joined", F.array_join("parts", "")).filter(F.col("joined") != "")
    single = rows.filter(F.size("parts") == 1).groupBy(F.col("joined").alias("cleaned")).agg(F.min("display").alias("display"))
    shown = rows.filter(F.size("parts") == 1).join(single.select(F.col("cleaned").alias("joined"), F.col("display")), ["joined", "display"], "left_semi")
    sounding = shown.unionByName(rows.filter(F.size("parts") > 1)).select(F.col("display").alias("term"), "joined", "parts")
    return single, P.with_codes(sounding, "joined").select("code", "term", "joined", "parts")


def stopwords(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(w,) for w in T.STOPWORDS], "cleaned string")


def learnable(w: DataFrame, terms: DataFrame, freq: DataFrame, min_length: int = MIN_LENGTH, known: float = KNOWN_ZIPF) -> DataFrame:
    """transcript_id, cleaned, n, first_gi, display: words a transcript uses that nobody knows."""
    rows = w.filter(F.col("wordlike") & (F.length("cleaned") >= min_length))
    # fixed list of 82 words
    rows = rows.join(F.broadcast(stopwords(w)), "cleaned", "left_anti")
    per = rows.groupBy("transcript_id", "cleaned").agg(
        F.count("*").alias("n"), F.min("global_index").alias("first_gi"), F.min_by(F.coalesce(F.nullif(T.trim_edges(F.col("word")), F.lit("")), F.col("word")), "global_index").alias("display")
    )
    per = per.join(terms.select("cleaned"), "cleaned", "left_anti")
    return per.join(freq.filter(F.col("zipf") >= known).select("cleaned"), "cleaned", "left_anti")


def _cluster(pdf: pd.DataFrame) -> pd.DataFrame:
    owner: dict[str, str] = {}
    for term in pdf.sort_values(["n", "first_gi"], ascending=[False, True])["cleaned"]:
        owner[term] = next((owner[seen] for seen in owner if P.jaro_winkler(term, seen) >= CLUSTER_SIMILARITY), term)
    out = pdf.copy()
    out["canonical"] = out["cleaned"].map(owner)
    return out[["transcript_id", "cleaned", "n", "first_gi", "display", "canonical"]]


def clusters(candidates: DataFrame) -> DataFrame:
    """Candidates with ``canonical``: the most frequent spelling of the cluster each belongs to.

    A spelling joins the cluster of the first more frequent spelling it resembles, so chains count. The
    order decides, so a transcript's learned spellings (not its words) are one group.
    """
    return candidates.groupBy("transcript_id").applyInPandas(_cluster, "transcript_id string, cleaned string, n bigint, first_gi bigint, display string, canonical string")


def neighbours(terms: DataFrame, freq: DataFrame, limit: int = NEIGHBOURS) -> DataFrame:
    """term, neighbours: the known words each term could be a mishearing of, most similar first, then by name."""
    known = P.with_codes(freq.filter(F.col("zipf") >= NEIGHBOUR_ZIPF).select(F.col("cleaned").alias("word")), "word")
    pairs = P.with_codes(terms.select("term").distinct(), "term").join(known, "code").filter(F.col("term") != F.col("word")).select("term", "word").distinct()
    close = pairs.withColumn("score", P.similarity(F.col("term"), F.col("word"))).filter(F.col("score") >= NEIGHBOUR_SIMILARITY)
    best = Window.partitionBy("term").orderBy(F.desc("score"), "word")
    top = close.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= limit)
    return top.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias("neighbours"))


def learned(w: DataFrame, terms: DataFrame, freq: DataFrame, min_count: int = LEARN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(variants: transcript_id, variant, canonical, display, counts, is_canonical), (suspects: transcript_id,
    variant, neighbours).

    A cluster seen fewer than ``TRUST_COUNT`` times whose canonical spelling nobody knows but which sounds
    and looks like a known word is suspected of being that word; it is not learned.
    """
    grouped = materialise(clusters(learnable(w, terms, freq).filter(F.col("n") >= min_count)))
    totals = grouped.groupBy("transcript_id", "canonical").agg(F.sum("n").alias("counts"), F.max(F.when(F.col("cleaned") == F.col("canonical"), F.col("display"))).alias("shown"))
    doubted = totals.filter(F.col("counts") < TRUST_COUNT).join(freq.filter(F.col("zipf") > OOV_ZIPF).select(F.col("cleaned").alias("canonical")), "canonical", "left_anti")
    near = neighbours(doubted.select(F.col("canonical").alias("term")), freq)
    doubted = doubted.join(near, F.col("canonical") == F.col("term"))
    capital = T.is_all_caps(F.left("shown", F.lit(1)))
    offered = F.when(capital, F.transform("neighbours", lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 20)))).otherwise(F.col("neighbours"))
    doubted = materialise(doubted.select("transcript_id", "canonical", offered.alias("neighbours")))
    suspects = grouped.join(doubted, ["transcript_id", "canonical"]).select("transcript_id", F.col("cleaned").alias("variant"), "neighbours")
    kept = grouped.join(totals, ["transcript_id", "canonical"]).join(doubted.select("transcript_id", "canonical"), ["transcript_id", "canonical"], "left_anti")
    own = F.col("cleaned") == F.col("canonical")
    variants = kept.select("transcript_id", F.col("cleaned").alias("variant"), "canonical", F.col("display"), F.when(own, F.col("counts")).otherwise(F.col("n")).alias("counts"), own.alias("is_canonical"))
    return variants, suspects
