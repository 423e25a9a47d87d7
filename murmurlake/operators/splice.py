"""Accepted replacements written into cue texts by character offset; every other character stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.functions import text as T
from murmurlake.operators.records import once


def span_edits(accepted: DataFrame, words: DataFrame, cues: DataFrame) -> DataFrame:
    """The character ranges each accepted span writes: cue_id, start, end, written, lo, hi, cut.

    ``accepted`` has transcript_id, lo, hi, replacement. A span within one cue is replaced where its words
    stand, outer punctuation left alone (unless there is nothing else). A span over several cues writes the
    whole replacement into the first and cuts its words, and blanks before them, from the later ones.
    """
    each = accepted.select("transcript_id", "lo", "hi", "replacement", F.explode(F.sequence("lo", "hi")).alias("global_index"))
    placed = each.join(words.select("transcript_id", "global_index", "cue_id", "cue_order", "char_offset", "word"), ["transcript_id", "global_index"])
    key = ["transcript_id", "lo", "hi", "replacement"]
    per = placed.groupBy(*key, "cue_id", "cue_order").agg(F.min("char_offset").alias("first"), F.max(F.col("char_offset") + F.length("word")).alias("last"))
    span = per.groupBy(*key).agg(F.min("cue_order").alias("from_cue"), F.max("cue_order").alias("to_cue"))
    per = per.join(span, key).join(once(cues.select("cue_id", "text"), "cue_id"), "cue_id")
    edge = F.lit(T.SPAN_EDGE)
    raw = F.substring("text", F.col("first") + 1, F.col("last") - F.col("first"))
    lead, trail = F.length(raw) - F.length(F.ltrim(raw, edge)), F.length(raw) - F.length(F.rtrim(raw, edge))
    bare = lead + trail >= F.length(raw)
    one, opens, closes = F.col("from_cue") == F.col("to_cue"), F.col("cue_order") == F.col("from_cue"), F.col("cue_order") == F.col("to_cue")
    upto = F.left("text", F.col("last"))
    start = F.when(one, F.when(bare, F.col("first")).otherwise(F.col("first") + lead)).when(opens, F.col("first") + lead).otherwise(0)
    end = F.when(one, F.when(bare, F.col("last")).otherwise(F.col("last") - trail)).when(~opens & closes, F.length(F.rtrim(upto, edge))).otherwise(F.col("last"))
    return per.select("cue_id", start.cast("int").alias("start"), end.cast("int").alias("end"), F.when(opens, F.col("replacement")).otherwise("").alias("written"), "lo", "hi", (~opens).alias("cut"))


def splice(cues: DataFrame, words: DataFrame, accepted: DataFrame) -> DataFrame:
    """transcript_id, cue_id, cue_order, cue_index, start_us, end_us, text of every surviving cue.

    Edits of a cue apply in order of their start; one that overlaps (half-open) an earlier kept one is
    skipped. A cue that lost its leading words to an earlier cue is stripped on the left and dropped if
    nothing is left. Null texts and cues without edits stay as they are.
    """
    edits = span_edits(accepted, words, cues)
    listed = edits.groupBy("cue_id").agg(F.array_sort(F.collect_list(F.struct("start", "lo", "hi", "end", "written"))).alias("edits"), F.bool_or("cut").alias("cut"))
    rows = once(cues.select("transcript_id", "cue_id", "cue_order", "cue_index", "start_us", "end_us", "text"), "cue_id").join(listed, "cue_id", "left")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(acc, e):
        kept = F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, e["start"] - acc["at"]), e["written"])
        return F.when(e["start"] < acc["at"], acc).otherwise(F.struct(e["end"].alias("at"), kept.alias("done")))

    done = F.aggregate("edits", begin, step, lambda acc: F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    text = F.when(F.col("edits").isNull(), F.col("text")).when(F.col("cut"), F.regexp_replace(done, r"(?U)^\s+", "")).otherwise(done)
    out = rows.withColumn("text", text)
    return out.filter(~(F.coalesce("cut", F.lit(False)) & (F.col("text") == ""))).drop("edits", "cut")


PIECE = "struct<text:string,original:string,lo:bigint,hi:bigint>"


def spliced_pieces(cues: DataFrame, words: DataFrame, accepted: DataFrame) -> DataFrame:
    """How every cue reads after its edits, for a review: transcript_id, cue_id, pieces, gone, merged_into.

    ``pieces`` are the parts of the spliced text in order: what is written (with the ``original`` it replaces
    and the span lo..hi it belongs to) and what was left as it stood (``original`` and span null); joined they
    give the text of ``splice``. A cue whose words all went into an earlier one is ``gone``, and
    ``merged_into`` is the cue_id that has them; it is also set where a cue only lost its leading words.
    """
    edits = span_edits(accepted, words, cues)
    listed = edits.groupBy("cue_id").agg(F.array_sort(F.collect_list(F.struct("start", "lo", "hi", "end", "written"))).alias("edits"), F.bool_or("cut").alias("cut"))
    opens = edits.filter("NOT cut").select("lo", "hi", F.col("cue_id").alias("merged_into"))
    held = once(cues.select("cue_id", "transcript_id"), "cue_id")
    first = opens.join(held.withColumnRenamed("cue_id", "merged_into"), "merged_into")
    later = edits.filter("cut").select("cue_id", "lo", "hi").join(held, "cue_id")
    into = later.join(first, ["transcript_id", "lo", "hi"]).groupBy("cue_id").agg(F.min("merged_into").alias("merged_into"))
    rows = once(cues.select("transcript_id", "cue_id", "text"), "cue_id").join(listed, "cue_id", "left").join(into, "cue_id", "left")

    def kept(at, upto):
        return F.struct(F.substring("text", at + 1, upto - at).alias("text"), F.lit(None).cast("string").alias("original"), F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"))

    def step(acc, e):
        written = F.struct(e["written"].alias("text"), F.substring("text", e["start"] + 1, e["end"] - e["start"]).alias("original"), e["lo"].alias("lo"), e["hi"].alias("hi"))
        return F.when(e["start"] < acc["at"], acc).otherwise(F.struct(e["end"].alias("at"), F.concat(acc["done"], F.array(kept(acc["at"], e["start"]), written)).alias("done")))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{PIECE}>").alias("done"))
    some = F.coalesce("edits", F.array().cast(listed.schema["edits"].dataType))
    done = F.aggregate(some, begin, step, lambda acc: F.concat(acc["done"], F.array(kept(acc["at"], F.length("text")))))
    rows = rows.withColumn("pieces", F.filter(done, lambda p: (p["text"] != "") | p["original"].isNotNull()))
    # blanks that a lost beginning leaves are stripped from the first text that is left
    firm = F.coalesce(F.array_min(F.filter(F.transform("pieces", lambda p, i: F.when(p["text"].rlike(r"(?U)\S"), i)), lambda i: i.isNotNull())), F.size("pieces"))
    cut = F.coalesce("cut", F.lit(False))
    rows = rows.withColumn("firm", firm)
    tidy = F.transform("pieces", lambda p, i: F.struct(F.when(cut, F.when(i < F.col("firm"), "").when(i == F.col("firm"), F.regexp_replace(p["text"], r"(?U)^\s+", "")).otherwise(p["text"])).otherwise(p["text"]).alias("text"), p["original"], p["lo"], p["hi"]))
    out = rows.withColumn("pieces", tidy)
    gone = cut & (F.array_join(F.transform("pieces", lambda p: p["text"]), "") == "")
    return out.select("transcript_id", "cue_id", "pieces", gone.alias("gone"), "merged_into")
