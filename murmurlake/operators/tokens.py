"""Words with their place in cue and transcript, word frequencies, sentences and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.functions import text as T
from murmurlake.operators.records import once
from murmurlake.operators.scans import scan_before
from murmurlake.session import materialise

#: Cues of one transcript that are scanned together.
CUE_BLOCK_BITS = 10
#: A context is the touched sentences up to this many words, else a window around the span (fixed values).
MAX_CONTEXT_WORDS = 40
CONTEXT_WINDOW_WORDS = 15


def words(cues: DataFrame) -> DataFrame:
    """Every word of every cue: transcript_id, cue_id, cue_order, cue_index, start_us, end_us, char_offset,
    global_index, word.

    Positions run over the transcript in file order (cue_order). Each cue counts once; null texts have no
    words. Only cues are shuffled, with their word counts; words are made where their cue lies.
    """
    rows = once(cues.select("cue_id", "transcript_id", "cue_order", "cue_index", "start_us", "end_us", "text"), "cue_id")
    rows = rows.filter(F.col("text").isNotNull()).withColumn("__words", T.positioned(F.col("text"))).drop("text")
    rows = rows.withColumn("__n", F.size("__words").cast("bigint")).withColumn("__block", F.shiftright("cue_order", CUE_BLOCK_BITS))
    placed = scan_before(rows, ["transcript_id"], "__block", ["cue_order", "cue_id"], "__n", "__first", fold="sum")
    flat = placed.select("transcript_id", "cue_id", "cue_order", "cue_index", "start_us", "end_us", F.coalesce("__first", F.lit(0)).alias("__first"), F.posexplode("__words").alias("__pos", "w"))
    return flat.select(
        "transcript_id", "cue_id", "cue_order", "cue_index", "start_us", "end_us", F.col("w.char_offset").alias("char_offset"), (F.col("__first") + F.col("__pos")).alias("global_index"), F.col("w.word").alias("word")
    )


def with_clean(w: DataFrame) -> DataFrame:
    return w.withColumns({"cleaned": T.clean(F.col("word")), "wordlike": T.is_wordlike(F.col("word"))})


def frequencies(w: DataFrame, min_records: int = 3) -> DataFrame:
    """cleaned, n, zipf: the published Zipf scale (log10 of occurrences per billion words) of every term
    that at least ``min_records`` transcripts use."""
    per = w.filter(F.col("cleaned") != "").groupBy("cleaned", "transcript_id").agg(F.count("*").alias("n"))
    term = per.groupBy("cleaned").agg(F.sum("n").alias("n"), F.count("*").alias("records"))
    total = term.agg(F.sum("n")).scalar()
    return term.filter(F.col("records") >= min_records).select("cleaned", "n", F.log10(F.col("n") / total * 1e9).alias("zipf"))


def with_sentence(w: DataFrame) -> DataFrame:
    """Add ``sentence_no`` (from 0 per transcript): a word opens a sentence if the word before ends one."""
    block = w.withColumn("__block", F.shiftright("global_index", 14)).withColumn("__ends", F.when(T.ends_sentence(F.col("word")), 1).otherwise(0).cast("bigint"))
    out = scan_before(block, ["transcript_id"], "__block", ["global_index"], "__ends", "__before", fold="sum")
    return out.withColumn("sentence_no", F.coalesce("__before", F.lit(0))).drop("__block", "__ends", "__before")


def sentences(w: DataFrame) -> DataFrame:
    """transcript_id, sentence_no, first_gi, last_gi, words (array)."""
    s = with_sentence(w)
    return s.groupBy("transcript_id", "sentence_no").agg(
        F.min("global_index").alias("first_gi"),
        F.max("global_index").alias("last_gi"),
        F.transform(F.array_sort(F.collect_list(F.struct("global_index", "word"))), lambda x: x["word"]).alias("words"),
    )


def contexts(w: DataFrame, spans: DataFrame, key: str, max_words: int = MAX_CONTEXT_WORDS, window: int = CONTEXT_WINDOW_WORDS) -> DataFrame:
    """key, context: the sentences a span (transcript_id, lo, hi) touches, joined by blanks, or, where they
    have more than ``max_words`` words, the span and up to ``window`` words either side within them.

    Spans that touch no word have no row. Sentences are only known by their ends here, so one that runs
    over a whole transcript without punctuation is never gathered; the words shown are fetched by position.
    """
    # read five times below
    numbered = materialise(with_sentence(w).select("transcript_id", "global_index", "sentence_no", "word"))
    ends = numbered.groupBy("transcript_id", "sentence_no").agg(F.min("global_index").alias("first_gi"), F.max("global_index").alias("last_gi"))
    at = numbered.select("transcript_id", "global_index", "sentence_no")
    lo = spans.select(key, "transcript_id", "lo", "hi")
    for place, bound, known in (("lo", "first_gi", "a"), ("hi", "last_gi", "b")):
        lo = lo.join(at.withColumnRenamed("global_index", place), ["transcript_id", place]).join(ends.select("transcript_id", "sentence_no", F.col(bound).alias(known)), ["transcript_id", "sentence_no"]).drop("sentence_no")
    known = lo
    whole = F.col("b") - F.col("a") + 1 <= max_words
    first = F.when(whole, F.col("a")).otherwise(F.greatest(F.col("lo") - window, F.col("a")))
    last = F.when(whole, F.col("b")).otherwise(F.least(F.col("hi") + window, F.col("b")))
    shown = known.select(key, "transcript_id", F.explode(F.sequence(first, last)).alias("global_index"))
    met = shown.join(numbered.select("transcript_id", "global_index", "word"), ["transcript_id", "global_index"])
    return met.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("global_index", "word"))), lambda x: x["word"]), " ").alias("context"))


def name_like(w: DataFrame) -> DataFrame:
    """Add ``name_like``: capitalised, not all capitals, and not the first word of a sentence or transcript."""
    core = T.trim_edges(F.col("word"))
    initial = F.left(core, F.lit(1))
    said = w.withColumn("__block", F.shiftright("global_index", 14)).withColumn("__said", F.struct("global_index", "word"))
    w = scan_before(said, ["transcript_id"], "__block", ["global_index"], "__said", "__former").withColumn("__former", F.col("__former.word"))
    former = F.regexp_replace("__former", "[\"')\\]”’]+$", "")
    capital = (initial != "") & T.is_all_caps(initial) & ~T.is_all_caps(core)
    return w.withColumn("name_like", F.coalesce(capital & former.isNotNull() & ~T.ends_sentence(former), F.lit(False))).drop("__block", "__said", "__former")
