"""Caption files: SubRip and WebVTT, read and written as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.functions import text as T

_TIMING = r"(\d+:\d{1,2}(?::\d{1,2})?[.,]\d{1,3})\s*-->\s*(\d+:\d{1,2}(?::\d{1,2})?[.,]\d{1,3})"
FORMATS = ("srt", "vtt")


def caption_format(path):
    """The format that a path's ending names, lower-cased; null for any other ending."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ending.isin(*FORMATS), ending)


def parse_captions(files: DataFrame, path: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(cues, rejected) from whole caption files.

    cues: transcript_id (the file's name without its ending), cue_order (from 0), cue_index, start_us,
    end_us, text. SubRip keeps the file's own numbers; WebVTT cues are numbered 1..n. Multi-line texts keep
    their line breaks. rejected: path and reason of files with another ending or without any cue.
    """
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(content, "^﻿", ""), r"\r\n?", "\n"), r"[ \t]+(?=\n)", "")
    rows = files.select(F.col(path).alias("path"), caption_format(F.col(path)).alias("format"), F.regexp_extract(F.col(path), r"([^/]*?)(?:\.[^./]+)?$", 1).alias("transcript_id"), F.split(text, r"\n{2,}").alias("blocks"))
    shaped = F.transform(
        "blocks",
        lambda b: F.struct(
            F.regexp_extract(b, r"(?:^|\n)\s*(\d+)\s*\n[^\n]*-->", 1).try_cast("int").alias("number"),
            T.parse_time(F.regexp_extract(b, _TIMING, 1)).alias("start_us"),
            T.parse_time(F.regexp_extract(b, _TIMING, 2)).alias("end_us"),
            F.rtrim(F.regexp_replace(b, r"(?s)^.*?-->[^\n]*(?:\n|$)", ""), F.lit("\n ")).alias("text"),
        ),
    )
    timed = rows.withColumn("cues", F.filter(shaped, lambda c: c["start_us"].isNotNull() & c["end_us"].isNotNull()))
    good = timed.filter(F.col("format").isNotNull() & (F.size("cues") > 0))
    flat = good.select("transcript_id", "format", F.posexplode("cues").alias("cue_order", "c"))
    number = F.when(F.col("format") == "srt", F.coalesce("c.number", F.col("cue_order") + 1)).otherwise(F.col("cue_order") + 1)
    cues = flat.select("transcript_id", "cue_order", number.cast("int").alias("cue_index"), "c.start_us", "c.end_us", "c.text")
    bad = timed.filter(F.col("format").isNull() | (F.size("cues") == 0)).select("path", F.when(F.col("format").isNull(), "unsupported ending").otherwise("no cues").alias("reason"))
    return cues, bad


def read_captions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``parse_captions`` over every file below ``path``; each file is one row of its reader."""
    files = spark.read.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return parse_captions(files)


def compose_captions(cues: DataFrame, kind: str = "srt") -> DataFrame:
    """transcript_id and content: one file's text for each transcript.

    SubRip is sorted by start and numbered anew, and cues without duration, times or text are left out, as
    they would not read back; WebVTT keeps file order. A file is one value, so a transcript's cues meet in
    one task by nature.
    """
    if kind not in FORMATS:
        raise ValueError(f"unsupported caption format {kind!r}")
    rows = cues.filter(F.col("start_us").isNotNull() & F.col("end_us").isNotNull() & F.col("text").isNotNull())
    if kind == "srt":
        rows = rows.filter((F.col("end_us") > F.col("start_us")) & (F.trim("text") != ""))
        order = F.struct("start_us", "end_us", "cue_order", "text")
    else:
        order = F.struct("cue_order", "start_us", "end_us", "text")
    per = rows.groupBy("transcript_id").agg(F.array_sort(F.collect_list(order)).alias("cs"))
    sep = "," if kind == "srt" else "."

    def block(c, i):
        line = F.concat(T.caption_time(c["start_us"], sep), F.lit(" --> "), T.caption_time(c["end_us"], sep), F.lit("\n"), c["text"])
        return F.concat((i + 1).cast("string"), F.lit("\n"), line) if kind == "srt" else line

    body = F.array_join(F.transform("cs", block), "\n\n")
    content = F.concat(body, F.lit("\n")) if kind == "srt" else F.concat(F.lit("WEBVTT\n\n"), body, F.lit("\n"))
    return per.select("transcript_id", content.alias("content"))


def write_captions(cues: DataFrame, path: str, kind: str = "srt") -> None:
    """Write one text file for each transcript, in folders named by it."""
    files = compose_captions(cues, kind).withColumn("content", F.rtrim("content", F.lit("\n")))
    files.write.mode("overwrite").partitionBy("transcript_id").text(path)
