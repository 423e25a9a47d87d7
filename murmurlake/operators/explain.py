"""What a judge or a reader gets to see about a flag, and totals over runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.functions import phonetic as P
from murmurlake.functions import text as T
from murmurlake.operators.align import shortest_unique, unique_lengths
from murmurlake.operators.records import once
from murmurlake.operators.scans import scan_before

#: Related words shown with a flag, flags judged in one request, margin of a sure candidate (fixed values).
RELATED = 3
BATCH = 25
SURE_MARGIN = 0.15
#: The time of a flag that has none.
NO_TIME = "--:--:--,---"


def around(flags: DataFrame, cues: DataFrame) -> DataFrame:
    """flag_id with the text of the flag's cue and of the cues before and after it in the file.

    The cue is found by transcript and the number that the flag carries (the first cue of that number); the
    neighbours by place, so numbers need not be dense.
    """
    rows = once(cues.select("cue_id", "transcript_id", "cue_order", "cue_index", "text"), "cue_id")
    place = scan_before(rows.withColumn("b", F.shiftright("cue_order", 10)).withColumn("one", F.lit(1).cast("bigint")), ["transcript_id"], "b", ["cue_order", "cue_id"], "one", "n", fold="sum")
    place = place.select("transcript_id", "cue_index", F.coalesce("n", F.lit(0)).alias("n"), "text")
    first = place.groupBy("transcript_id", "cue_index").agg(F.min(F.struct("n", "text")).alias("c"))
    at = flags.select("flag_id", "transcript_id", "cue_index").join(first, ["transcript_id", "cue_index"]).select("flag_id", "transcript_id", F.col("c.n").alias("n"), F.col("c.text").alias("cue_text"))
    before = place.select("transcript_id", (F.col("n") + 1).alias("n"), F.col("text").alias("before"))
    after = place.select("transcript_id", (F.col("n") - 1).alias("n"), F.col("text").alias("after"))
    return at.join(before, ["transcript_id", "n"], "left").join(after, ["transcript_id", "n"], "left").select("flag_id", "before", "cue_text", "after")


def related(flags: DataFrame, words: DataFrame, limit: int = RELATED) -> DataFrame:
    """flag_id, related: other words of the transcript that sound like the flagged span, the first by name."""
    spans = flags.filter(F.col("span").isNotNull()).select("flag_id", "transcript_id", T.letters(F.col("span")).alias("own")).filter(F.col("own") != "")
    coded = spans.join(P.with_codes(spans.select("own").distinct(), "own"), "own")
    surfaces = words.filter("wordlike").select("transcript_id", "cleaned").distinct()
    sounding = surfaces.join(P.with_codes(surfaces.select("cleaned").distinct(), "cleaned"), "cleaned")
    met = coded.join(sounding, ["transcript_id", "code"]).filter(F.col("own") != F.col("cleaned")).select("flag_id", "cleaned").distinct()
    ranked = met.withColumn("r", F.row_number().over(Window.partitionBy("flag_id").orderBy("cleaned"))).filter(F.col("r") <= limit)
    return ranked.groupBy("flag_id").agg(F.array_sort(F.collect_list("cleaned")).alias("related"))


def batches(flags: DataFrame, size: int = BATCH) -> DataFrame:
    """Add ``batch_no``: flags of a transcript in reading order, ``size`` to a request."""
    rows = flags.withColumn("__b", F.shiftright("lo", 12)).withColumn("__one", F.lit(1).cast("bigint"))
    placed = scan_before(rows, ["transcript_id"], "__b", ["lo", "hi", "flag_id"], "__one", "__n", fold="sum")
    return placed.withColumn("batch_no", F.floor(F.coalesce("__n", F.lit(0)) / size).cast("int")).drop("__b", "__one", "__n")


def is_sure(flags: DataFrame, margin: float = SURE_MARGIN) -> DataFrame:
    """Add ``sure``: found by the transcript's own sounds alone, with one candidate or one well ahead."""
    span = F.lower(T.span_text(F.array("span")))
    two = F.slice("candidates", 1, 2)
    a, b = F.get(two, F.lit(0)), F.get(two, F.lit(1))
    lead = P.similarity(span, F.lower(a)) - P.similarity(span, F.lower(b))
    scored = flags.withColumn("__lead", lead)
    own = (F.col("detector") == "phonetic_internal") & (F.size("candidates") > 0)
    return scored.withColumn("sure", own & ((F.size("candidates") == 1) | (F.col("__lead") >= margin))).drop("__lead")


def report_lines(flags: DataFrame) -> DataFrame:
    """One line a flag for readers: the span marked in its context, the best candidate and how many more.

    Every flag has a line: without a start the time is ``NO_TIME``, without a span the context is shown
    unmarked, without a context the marked span alone.
    """
    first = F.get("candidates", F.lit(0))
    span = F.coalesce("span", F.lit(""))
    context = F.coalesce(F.col("context"), span)
    at = F.when(span != "", F.instr(context, span)).otherwise(0)
    marked = F.when(at > 0, F.concat(F.substring(context, F.lit(1), at - 1), F.lit("»"), span, F.lit("«"), F.substring(context, at + F.length(span), F.length(context)))).otherwise(context)
    more = F.when(F.size("candidates") > 1, F.format_string(" (+%d more)", F.size("candidates") - 1)).otherwise("")
    offer = F.when(F.size("candidates") > 0, F.concat(F.lit(" -> "), first, more)).otherwise("")
    start = F.when(F.col("start_us").isNotNull(), T.caption_time(F.col("start_us"))).otherwise(NO_TIME)
    return flags.select("flag_id", F.concat(F.lit("["), start, F.lit("] "), marked, offer).alias("line"))


def markdown_rows(flags: DataFrame) -> DataFrame:
    """Rows of a six-column table for a reviewer, the last column left blank; what is null is left blank too."""

    def cell(c: Column) -> Column:
        return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))

    confidence = F.when(F.col("confidence").isNotNull(), F.format_string("%.2f", "confidence"))
    cells = [cell(F.col("span")), cell(F.get("candidates", F.lit(0))), cell(confidence), cell(F.col("detector")), cell(F.col("context")), F.lit("")]
    return flags.select("flag_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row"))


def request_tokens(texts: Column, extra: int = 0) -> Column:
    """Estimated tokens of a request: a quarter of every message's characters, rounded down, plus ``extra``."""
    return F.aggregate(texts, F.lit(extra), lambda acc, t: acc + F.floor(F.length(t) / 4).cast("int"))


def spend(replies: DataFrame, keys: Sequence[str], cost: str = "cost_usd") -> DataFrame:
    """Calls and total cost; the total is unknown (null) as soon as one reply's cost is."""
    return replies.groupBy(*keys).agg(F.count("*").alias("calls"), F.when(F.bool_and(F.col(cost).isNotNull()), F.sum(cost)).alias("total"))


def lengths(cues: DataFrame) -> DataFrame:
    """Per transcript its cues, words and the end of its last cue."""
    rows = once(cues.select("cue_id", "transcript_id", "end_us", "text"), "cue_id")
    n = F.coalesce(F.size(F.regexp_extract_all(F.col("text"), F.lit(r"(?U)\S+"), F.lit(0))), F.lit(0))
    return rows.groupBy("transcript_id").agg(F.count("*").alias("cues"), F.sum(F.when(F.col("text").isNotNull(), n).otherwise(0)).alias("words"), F.max("end_us").alias("last_us"))


def seeded_split(ids: DataFrame, key: str, first: int, sample: int, seed: int) -> DataFrame:
    """key, part: the ``first`` ids by name, a seeded sample of ``sample`` of the others, and the rest.

    The sample is the first of the others in the order of a seeded hash, so the same ids give the same split;
    both draws are top-k in the engine, and null ids take no part.
    """
    names = ids.select(F.col(key).cast("string").alias(key)).filter(F.col(key).isNotNull()).distinct()
    head = names.orderBy(key).limit(first).withColumn("part", F.lit("first"))
    lot = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary"))
    drawn = names.join(head, key, "left_anti").orderBy(lot, key).limit(sample).withColumn("part", F.lit("sample"))
    return names.join(head.unionByName(drawn), key, "left").withColumn("part", F.coalesce("part", F.lit("rest")))


CASES = "call_id string, region_no int, span string, candidate string, context string, kind string, entity boolean"


def cases_from_regions(regions: DataFrame, tokens: DataFrame, keep: Sequence[str] = ("format", "function-word", "non-word", "real-word")) -> DataFrame:
    """Labelled cases: the words as captioned, the reference's words, the shortest context that occurs once.

    A call is one group, as contexts are unique within it.
    """
    rows = tokens.filter(F.col("token").isNotNull() & ~F.col("token").rlike(r"^(<[^>]*>|\*+)?$"))
    entry = F.struct("pos", F.concat("token", F.coalesce("punctuation", F.lit(""))).alias("text"), T.clean(F.col("token")).alias("cleaned"), "token")
    sides = rows.groupBy("call_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, entry))).alias(s) for s in ("hypothesis", "reference")])
    wanted = regions.filter(F.col("kind").isin(*keep)).groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("region_no", "h_from", "h_to", "r_from", "r_to", "kind", "entity"))).alias("rs"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                texts, cleaned, ref = [t["text"] for t in r.hypothesis], [t["cleaned"] for t in r.hypothesis], [t["token"] for t in r.reference]
                lengths = unique_lengths(cleaned)
                for g in r.rs:
                    lo, hi = shortest_unique(lengths, cleaned, g["h_from"], g["h_to"])
                    candidate = " ".join(ref[g["r_from"] : g["r_to"]]) if g["r_to"] > g["r_from"] else None
                    out.append((r.call_id, g["region_no"], " ".join(texts[g["h_from"] : g["h_to"]]), candidate, " ".join(texts[lo:hi]), g["kind"], g["entity"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CASES.split(", ")])

    return sides.join(wanted, "call_id").mapInPandas(run, CASES)
