"""Detectors of suspicious words, and the merge of overlapping findings.

All detectors judge distinct (transcript, word) surfaces and join the verdicts back to the occurrences.
A flag is: transcript_id, lo, hi (global indices), span, cue_index, start_us, end_us, detector, reason,
candidates, confidence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from murmurlake.functions import phonetic as P
from murmurlake.functions import text as T
from murmurlake.operators import vocab as V
from murmurlake.operators.scans import scan_before
from murmurlake.operators.tokens import contexts, name_like
from murmurlake.session import materialise

#: Thresholds of the split-word detector (fixed values).
FRAGMENT_LENGTH = 5
COMMON_ZIPF = 3.0
ORDINARY_ZIPF = 4.5
COLUMNS = ["transcript_id", "lo", "hi", "span", "cue_index", "start_us", "end_us", "detector", "reason", "candidates", "confidence"]


@dataclass
class Inputs:
    """What detectors read: words with ``cleaned``, ``wordlike``, ``name_like``, ``zipf``; vocabularies."""

    words: DataFrame
    terms: DataFrame
    codes: DataFrame
    variants: DataFrame
    suspects: DataFrame
    freq: DataFrame
    oov_zipf: float = V.OOV_ZIPF


def inputs(words: DataFrame, terms: DataFrame, freq: DataFrame, oov_zipf: float = V.OOV_ZIPF) -> Inputs:
    """Prepare and write once what all detectors share; runs jobs. Words up to ``oov_zipf`` count as unknown."""
    w = words.withColumns({"cleaned": T.clean(F.col("word")), "wordlike": T.is_wordlike(F.col("word"))})
    w = name_like(w).join(freq.select("cleaned", "zipf"), "cleaned", "left").withColumn("zipf", F.coalesce("zipf", F.lit(0.0)))
    w = w.join(F.broadcast(V.stopwords(w).withColumn("stop", F.lit(True))), "cleaned", "left").withColumn("stop", F.coalesce("stop", F.lit(False)))
    w = materialise(w)
    single, codes = V.vocabulary(terms)
    single, codes = materialise(single), materialise(codes)
    variants, suspects = V.learned(w, single, freq)
    return Inputs(w, single, codes, materialise(variants), materialise(suspects), freq, oov_zipf)


def _say(pattern: str, *values: Column) -> Column:
    """A sentence with each value in quotes in the place of a pair of braces."""
    texts = pattern.split("{}")
    quoted = [x for text, v in zip(texts, values) for x in (F.lit(text), F.lit('"'), v, F.lit('"'))]
    return F.concat(*quoted, F.lit(texts[len(values)]))


def _flag(rows: DataFrame, detector: str, reason: Column, candidates: Column, confidence: Column) -> DataFrame:
    """A one-word flag for every row of words."""
    return rows.select(
        "transcript_id", F.col("global_index").alias("lo"), F.col("global_index").alias("hi"), T.span_text(F.array("word")).alias("span"), "cue_index", "start_us", "end_us",
        F.lit(detector).alias("detector"), reason.alias("reason"), candidates.cast("array<string>").alias("candidates"), F.round(confidence, 3).alias("confidence"),
    )


def out_of_vocabulary(i: Inputs) -> DataFrame:
    """Words nobody knows: not in the vocabulary, not learned, without a trace in the frequencies."""
    w = i.words.filter(F.col("wordlike") & ~F.col("stop") & (F.length("cleaned") >= V.MIN_LENGTH) & (F.col("zipf") <= i.oov_zipf))
    w = w.withColumn("base", T.possessive_base(F.col("cleaned")))
    known, taught = i.terms.select("cleaned"), i.variants.filter("is_canonical").select("transcript_id", F.col("variant").alias("cleaned"))
    w = w.join(known, "cleaned", "left_anti").join(taught, ["transcript_id", "cleaned"], "left_anti")
    w = w.join(known.withColumnRenamed("cleaned", "base"), "base", "left_anti").join(taught.withColumnRenamed("cleaned", "base"), ["transcript_id", "base"], "left_anti")
    w = w.join(i.suspects.withColumnRenamed("variant", "cleaned"), ["transcript_id", "cleaned"], "left")
    lost = i.terms.select(F.concat("cleaned", F.lit("s")).alias("cleaned"), F.concat("display", F.lit("'s")).alias("owned"))
    w = w.join(lost, "cleaned", "left")
    found = F.coalesce("neighbours", F.when(F.col("owned").isNotNull(), F.array("owned")), F.array().cast("array<string>"))
    rarity = F.when(F.col("zipf") != 0, F.format_string(", seldom seen (%.1f on the Zipf scale)", "zipf")).otherwise(", never seen")
    near = F.when(F.size(found) > 0, _say(", near {}", F.get(found, F.lit(0)))).otherwise("")
    reason = F.concat(_say("unknown word {}", F.col("word")), rarity, near)
    return _flag(w, "oov", reason, found, T.oov_confidence(F.col("zipf")))


def sounds_like_term(i: Inputs) -> DataFrame:
    """Words that sound like a vocabulary term, and terms written in the wrong case."""
    w = i.words.filter("wordlike").join(i.terms.select("cleaned", "display"), "cleaned", "left")
    cased = w.filter(F.col("display").isNotNull() & T.is_miscased(T.trim_edges(F.col("word")), F.col("display")))
    why = _say("{} is written {} in the vocabulary", F.col("word"), F.col("display"))
    cased = _flag(cased, "phonetic_vocab", why, F.array("display"), F.lit(0.6))
    open_ = w.filter(F.col("display").isNull() & ~F.col("stop") & (F.col("zipf") < V.KNOWN_ZIPF)).drop("display")
    single = i.codes.filter(F.size("parts") == 1).select("code", "term", "joined")
    pairs = P.with_codes(open_.select("cleaned").distinct(), "cleaned").join(single, "code").select("cleaned", "term", "joined").distinct()
    scored = pairs.withColumn("score", P.similarity(F.col("cleaned"), F.col("joined")))
    ranked = scored.groupBy("cleaned").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "term"))).alias("r"))
    hit = open_.join(ranked, "cleaned")
    names = F.transform("r", lambda x: x["term"])
    top = -F.col("r")[0]["s"]
    why = _say("{} has the sound of the term {}", F.col("word"), names[0])
    return cased.unionByName(_flag(hit, "phonetic_vocab", why, names, F.least(F.lit(0.95), 0.6 + 0.35 * top)))


def _best(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for surfaces, variants in batches:
        out = []
        for surface, known in zip(surfaces, variants):
            score, _, at = max(((P.jaro_winkler(surface, v), -k, k) for k, v in enumerate(known)), default=(0.0, 0, -1))
            out.append(at if score >= V.CLUSTER_SIMILARITY else -1)
        yield pd.Series(out, dtype="int32")


def sounds_like_own(i: Inputs) -> DataFrame:
    """Words that are close to a term the transcript teaches, or sound like a known word it uses."""
    w = i.words.filter(F.col("wordlike") & ~F.col("stop") & (F.length("cleaned") >= V.MIN_LENGTH))
    taught = i.variants.filter("is_canonical").select("transcript_id", F.col("variant").alias("cleaned"), F.lit(True).alias("taught"))
    named = i.terms.select("cleaned", F.lit(True).alias("term"))
    s = w.groupBy("transcript_id", "cleaned").agg(F.first("zipf").alias("zipf")).join(named, "cleaned", "left").join(taught, ["transcript_id", "cleaned"], "left")
    s = s.withColumn("named", F.coalesce("term", "taught", F.lit(False))).withColumn("good", F.col("named") | (F.col("zipf") >= V.KNOWN_ZIPF))
    s = materialise(s.select("transcript_id", "cleaned", "named", "good"))
    # pass 1: the learned spellings of a transcript are few; its unknown surfaces look for the nearest
    canon = i.variants.filter("is_canonical").select("transcript_id", F.col("variant").alias("canonical"), F.col("display").alias("shown"), F.col("counts").alias("times"))
    lists = i.variants.join(canon, ["transcript_id", "canonical"]).groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("counts")).alias("k"), "variant", "shown", "times"))).alias("known"))
    best = F.pandas_udf(_best, ty.IntegerType(), F.PandasUDFType.SCALAR_ITER)
    near = s.filter(~F.col("good")).join(lists, "transcript_id").withColumn("at", best(F.col("cleaned"), F.transform("known", lambda x: x["variant"])))
    near = near.filter(F.col("at") >= 0).select("transcript_id", "cleaned", F.col("known")[F.col("at")]["shown"].alias("shown"), F.col("known")[F.col("at")]["times"].alias("times"))
    first = w.join(near, ["transcript_id", "cleaned"])
    why = F.concat(_say("{} is close to {}", F.col("word"), F.col("shown")), F.format_string(", heard %d times here", "times"))
    flags = _flag(first, "phonetic_internal", why, F.array("shown"), F.lit(0.7))
    # pass 2: the same code within the transcript; of several codes the smallest that has a candidate decides
    coded = s.join(P.with_codes(s.select("cleaned").distinct(), "cleaned"), "cleaned")
    bad = coded.filter(~F.col("good")).join(near.select("transcript_id", "cleaned"), ["transcript_id", "cleaned"], "left_anti").select("transcript_id", "code", "cleaned")
    good = coded.filter("good").select("transcript_id", "code", F.col("cleaned").alias("sibling"), "named")
    pairs = bad.join(good, ["transcript_id", "code"]).withColumn("score", P.similarity(F.col("cleaned"), F.col("sibling")))
    entry = F.struct((-F.col("score")).alias("s"), "sibling", "named")
    ranked = pairs.groupBy("transcript_id", "cleaned", "code").agg(F.array_sort(F.collect_list(entry)).alias("r"))
    per = ranked.groupBy("transcript_id", "cleaned").agg(F.array_sort(F.collect_list(F.struct("code", "r"))).alias("by_code"))
    rest = w.join(per, ["transcript_id", "cleaned"])
    usable = F.transform("by_code", lambda c: F.transform(F.filter(c["r"], lambda x: x["named"] | ~F.col("name_like")), lambda x: x["sibling"]))
    rest = rest.withColumn("names", F.get(F.filter(usable, lambda a: F.size(a) > 0), F.lit(0))).filter(F.col("names").isNotNull())
    why = _say("{} has the sound of {}, a word used here", F.col("word"), F.col("names")[0])
    return flags.unionByName(_flag(rest, "phonetic_internal", why, F.col("names"), F.lit(0.7)))


def split_windows(i: Inputs) -> DataFrame:
    """Windows of two and three neighbouring words of one cue that could be fragments of one word."""
    ok = F.col("wordlike") & ~F.col("stop") & (F.col("cleaned") != "") & ((F.length("cleaned") <= FRAGMENT_LENGTH) | (F.col("zipf") < COMMON_ZIPF))
    w = i.words.select("transcript_id", "cue_id", "cue_index", "start_us", "end_us", F.struct("global_index", "word", "cleaned", "zipf", ok.alias("ok")).alias("x"))
    cues = w.groupBy("transcript_id", "cue_id", "cue_index", "start_us", "end_us").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    each = cues.select("transcript_id", "cue_id", "cue_index", "start_us", "end_us", F.explode(F.array(F.lit(2), F.lit(3))).alias("size"), "xs")
    each = each.filter(F.size("xs") >= F.col("size")).withColumn("p", F.explode(F.sequence(F.lit(1), F.size("xs") - F.col("size") + 1)))
    each = each.withColumn("win", F.slice("xs", F.col("p"), F.col("size"))).filter(F.forall("win", lambda x: x["ok"]))
    parts = F.transform("win", lambda x: x["cleaned"])
    out = each.withColumns({"parts": parts, "joined": F.array_join(parts, ""), "lo": F.col("win")[0]["global_index"], "hi": F.element_at("win", -1)["global_index"]})
    return out.filter(F.length("joined") > V.MIN_LENGTH).select(
        "transcript_id", "cue_id", "cue_index", "start_us", "end_us", "size", "lo", "hi", "parts", "joined", T.span_text(F.transform("win", lambda x: x["word"])).alias("span"),
        F.forall("win", lambda x: x["zipf"] >= ORDINARY_ZIPF).alias("ordinary"), F.exists("win", lambda x: x["zipf"] < V.KNOWN_ZIPF).alias("uncommon"),
    )


def split_word(i: Inputs) -> DataFrame:
    """Neighbouring fragments that together sound like a term, or are one common word."""
    win = materialise(split_windows(i).filter(~F.col("ordinary")))
    hits = P.with_codes(win.select("joined").distinct(), "joined").join(i.codes.select("code", "term", F.col("joined").alias("run"), F.col("parts").alias("term_parts")), "code").select("joined", "term", "run", "term_parts").distinct()
    hits = hits.filter(F.col("joined") != F.col("run")).withColumn("score", P.similarity(F.col("joined"), F.col("run")))
    by_part = win.select("transcript_id", "lo", "hi", F.explode("parts").alias("cleaned")).join(i.terms.select("cleaned"), "cleaned", "left_semi")
    known = by_part.groupBy("transcript_id", "lo", "hi").agg(F.collect_set("cleaned").alias("known"))
    w = win.join(known, ["transcript_id", "lo", "hi"], "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    fit = w.join(hits, "joined").filter(~F.array_contains("parts", F.array_join("term_parts", " ")) & (F.size(F.array_except("known", "term_parts")) == 0))
    heard = fit.groupBy("transcript_id", "lo", "hi").agg(F.transform(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "term"))), lambda x: x["term"]).alias("heard"))
    w = w.join(heard, ["transcript_id", "lo", "hi"], "left").join(i.freq.filter(F.col("zipf") >= COMMON_ZIPF).select(F.col("cleaned").alias("joined"), F.lit(True).alias("common")), "joined", "left")
    w = w.filter(F.col("heard").isNotNull() | (F.coalesce("common", F.lit(False)) & F.col("uncommon")))
    # greedy, shorter windows first, left to right; windows of different cues never meet
    entry = F.struct("size", "lo", "hi", "span", "joined", "heard")
    per = w.groupBy("transcript_id", "cue_id", "cue_index", "start_us", "end_us").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    kind = per.schema["all"].dataType.simpleString()
    keep = F.aggregate("all", F.array().cast(kind), lambda kept, e: F.when(F.exists(kept, lambda k: (k["lo"] <= e["hi"]) & (e["lo"] <= k["hi"])), kept).otherwise(F.concat(kept, F.array(e))))
    chosen = per.select("transcript_id", "cue_index", "start_us", "end_us", F.inline(keep))
    sound = F.col("heard").isNotNull()
    why = F.when(sound, _say("{} run together has the sound of {}", F.col("span"), F.get("heard", F.lit(0)))).otherwise(_say("{} run together is the word {}", F.col("span"), F.col("joined")))
    return chosen.select(
        "transcript_id", "lo", "hi", "span", "cue_index", "start_us", "end_us", F.lit("split_word").alias("detector"), why.alias("reason"),
        F.coalesce("heard", F.array("joined")).alias("candidates"), F.when(sound, F.lit(0.82)).otherwise(F.lit(0.75)).alias("confidence"),
    )


#: Detectors by name; add your own function from Inputs to flags.
DETECTORS: dict[str, Callable[[Inputs], DataFrame]] = {
    "oov": out_of_vocabulary,
    "phonetic_vocab": sounds_like_term,
    "phonetic_internal": sounds_like_own,
    "split_word": split_word,
}


def islands(flags: DataFrame) -> DataFrame:
    """Add ``island``: flags of one transcript whose word ranges (closed) overlap share a number."""
    rows = flags.withColumn("__block", F.shiftright("lo", 12))
    reach = scan_before(rows, ["transcript_id"], "__block", ["lo", "hi"], "hi", "__reach")
    new = reach.withColumn("__new", F.when(F.col("__reach").isNull() | (F.col("lo") > F.col("__reach")), 1).otherwise(0).cast("bigint"))
    # equal ranges need one order in both scans
    new = materialise(new.withColumn("__no", F.monotonically_increasing_id()))
    out = scan_before(new, ["transcript_id"], "__block", ["lo", "hi", "__no"], "__new", "__before", fold="sum")
    return out.withColumn("island", F.coalesce("__before", F.lit(0)) + F.col("__new")).drop("__block", "__reach", "__new", "__no", "__before")


def merge(flags: DataFrame, words: DataFrame) -> DataFrame:
    """One flag for every island of overlapping flags; a flag that overlaps no other stays as it is.

    The merged flag covers the whole extent; its detectors are the distinct ones, sorted and joined by
    '+', its reasons the distinct ones in order, its confidence the highest plus 0.05 for every further
    detector up to 0.98. Its candidates, the most confident flags' first, replace the whole extent: words
    and punctuation around a narrower flag are put around its candidates.
    """
    key = ["transcript_id", "island"]
    rows = materialise(islands(flags))
    sizes = rows.groupBy(*key).agg(F.count("*").alias("k"), F.min("lo").alias("a"), F.max("hi").alias("b"))
    alone = rows.join(sizes.filter("k = 1").select(*key), key, "left_semi").select(*COLUMNS)
    many = materialise(sizes.filter("k > 1"))
    each = many.select(*key, "a", "b", F.explode(F.sequence("a", "b")).alias("global_index"))
    ws = each.join(words.select("transcript_id", "global_index", "word"), ["transcript_id", "global_index"]).groupBy(*key, "a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("global_index", "word"))), lambda x: x["word"]).alias("ws"))
    parts = rows.join(ws, key)
    edge = F.lit(T.SPAN_EDGE)
    at, n = (F.col("lo") - F.col("a") + 1).cast("int"), (F.col("hi") - F.col("lo") + 1).cast("int")
    own = F.array_join(F.slice("ws", at, n), " ")
    core = F.btrim(own, edge)
    lead = F.when(core != "", F.left(own, F.length(own) - F.length(F.ltrim(own, edge)))).otherwise("")
    trail = F.when(core != "", F.right(own, F.length(own) - F.length(F.rtrim(own, edge)))).otherwise("")
    before = F.array_join(F.slice("ws", F.lit(1), at - 1), " ")
    after = F.array_join(F.slice("ws", at + n, F.greatest(F.size("ws") - at - n + 1, F.lit(0))), " ")
    left = F.when(before != "", F.ltrim(F.concat(before, F.lit(" "), lead), edge)).otherwise("")
    right = F.when(after != "", F.rtrim(F.concat(trail, F.lit(" "), after), edge)).otherwise("")
    wide = parts.withColumns({"__l": left, "__r": right}).withColumn("wide", F.transform("candidates", lambda c: F.concat(F.col("__l"), c, F.col("__r"))))
    agg = wide.groupBy(*key).agg(
        F.min("a").alias("lo"), F.max("b").alias("hi"), F.first("ws").alias("ws"), F.min("cue_index").alias("cue_index"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("detector", r"\+"))))).alias("ds"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("lo", "hi", "detector", "reason"))), lambda x: x["reason"])).alias("rs"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "lo", "hi", "detector", "wide"))), lambda x: x["wide"]))).alias("candidates"),
        F.max("confidence").alias("top"),
    )
    merged = agg.select(
        "transcript_id", "lo", "hi", T.span_text(F.col("ws")).alias("span"), "cue_index", "start_us", "end_us", F.array_join("ds", "+").alias("detector"), F.array_join("rs", "; ").alias("reason"), "candidates",
        F.round(F.least(F.lit(0.98), F.col("top") + 0.05 * (F.size("ds") - 1)), 3).alias("confidence"),
    )
    return alone.unionByName(merged)


def detect(i: Inputs, detectors: dict[str, Callable[[Inputs], DataFrame]] | None = None) -> DataFrame:
    """All detectors, merged, each flag with its context."""
    raw = materialise(reduce(DataFrame.unionByName, [f(i) for f in (detectors or DETECTORS).values()]))
    merged = materialise(merge(raw, i.words).withColumn("flag_no", F.monotonically_increasing_id()))
    ctx = contexts(i.words, merged, "flag_no")
    return merged.join(ctx, "flag_no", "left").drop("flag_no")
