"""Replies of a judge read into verdicts, verdicts resolved to one a word, and the flags they make.

Replies are parsed by the engine: a reply becomes a variant value, its items become rows, and each item is
placed on the words of its chunk by array expressions. Which verdict takes over which is a question of
touching ranges within one chunk, answered by folds over its few verdicts and hints. Python runs the judge
alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.functions import text as T
from murmurlake.session import materialise

#: New finds below this confidence are left out (fixed value).
MIN_CONFIDENCE = 0.9
#: Field orders of compact verdicts, in lists and under the id of a hint (fixed values).
FIELDS = ("start", "end", "span", "replacement", "cause", "confidence", "hint", "rationale")
KEYED_FIELDS = ("start", "end", "span", "replacement", "cause", "confidence", "rationale")
#: The cause of a correction, and the detector's name of what a judge finds (fixed values).
CAUSE = "misheard"
DETECTOR = "read_through"
CHUNK = ["transcript_id", "chunk_no"]


def _kind(v: Column) -> Column:
    """'ARRAY', 'OBJECT', 'BIGINT', ... of a variant; null for no value."""
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def reply_items(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items: chunk, place, hint, keyed, item), (failed: chunk, failure) of replies: chunk, reply.

    A reply is a JSON list of verdicts, an object with the list under ``verdicts``, or the keyed form
    ``{"hints": {id: verdict}, "errors": [verdict]}``, with or without a code fence. ``hint`` is set for
    items under an id, whose place is -1. Any other reply fails.
    """
    v = replies.select(*CHUNK, F.try_parse_json(T.without_fence(F.col("reply"))).alias("v"))
    parts = {name: F.try_variant_get("v", f"$.{name}", "variant") for name in ("hints", "errors", "verdicts")}
    v = v.withColumns(parts).withColumn("keyed", F.col("hints").isNotNull() | F.col("errors").isNotNull())
    off = lambda name, kind: F.col(name).isNotNull() & (_kind(F.col(name)) != kind)
    listed = F.when(_kind(F.col("v")) == "ARRAY", F.col("v")).when(F.col("keyed"), F.col("errors")).otherwise(F.col("verdicts"))
    failure = (
        F.when(F.col("v").isNull(), "no JSON")
        .when(F.col("keyed") & (off("hints", "OBJECT") | off("errors", "ARRAY")), "hints are not keyed by id, or errors are no list")
        .when(~F.col("keyed") & F.coalesce(_kind(listed) != "ARRAY", F.lit(True)), "no list of verdicts")
    )
    read = v.withColumns({"failure": failure, "listed": listed})
    good = read.filter("failure IS NULL")
    under = good.select(*CHUNK, "keyed", F.explode(_as(F.col("hints"), "map<string,variant>")).alias("hint", "item")).withColumn("place", F.lit(-1))
    rest = good.select(*CHUNK, "keyed", F.posexplode(_as(F.col("listed"), "array<variant>")).alias("place", "item")).withColumn("hint", F.lit(None).cast("string"))
    return under.unionByName(rest), read.filter("failure IS NOT NULL").select(*CHUNK, "failure")


def _fields(items: DataFrame) -> DataFrame:
    """Items with their fields as columns; items of a wrong shape are left out."""
    item, keyed = F.col("item"), F.col("keyed")
    listed = _as(item, "array<variant>")
    is_list, is_object = _kind(item) == "ARRAY", _kind(item) == "OBJECT"
    rows = items.withColumn("cells", F.when(is_list, listed)).filter(is_object | (is_list & (~keyed | (F.size("cells") == len(KEYED_FIELDS)))))

    def field(name: str) -> Column:
        at = F.get("cells", F.lit(FIELDS.index(name)))
        if name in KEYED_FIELDS:
            at = F.when(keyed, F.get("cells", F.lit(KEYED_FIELDS.index(name)))).otherwise(at)
        return F.when(F.col("cells").isNull(), F.try_variant_get(item, f"$.{name}", "variant")).otherwise(at)

    whole = lambda c: F.when(_kind(c) == "BIGINT", _as(c, "bigint"))
    said = lambda c: _as(c, "string")
    hint = F.when(keyed, F.col("hint")).otherwise(said(field("hint")))
    cause = field("cause")
    return rows.select(
        *CHUNK, "place", hint.alias("hint_id"), whole(field("start")).alias("start"), whole(field("end")).alias("end"), F.coalesce(said(field("span")), F.lit("")).alias("span"),
        said(field("replacement")).alias("written"), (cause.isNull() | F.coalesce(said(cause) == CAUSE, F.lit(False))).alias("heard"),
        F.coalesce(T.clamp_confidence(said(field("confidence"))), F.lit(0.0)).alias("confidence"), F.coalesce(said(field("rationale")), F.lit("")).alias("rationale"),
    )


def _spoken(text: Column) -> Column:
    """The words of a text as a reader sees them: letters and digits, case and marks aside."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def read_replies(replies: DataFrame, requests: DataFrame) -> DataFrame:
    """Verdicts of replies: chunk, start, end, replacement, confidence, rationale, hint, failure.

    A verdict stands at its own range if that is part of the chunk and has the words of its ``span`` (or the
    span is empty), else at the nearest place where those words stand, else, on a hint, at the hint's own
    range; one without a place is left out. It is a correction only if its cause is 'misheard' and it
    changes what is heard; on a hint a changed word boundary counts too. A hint's verdict that corrects
    nothing says it is no error; another such verdict is left out. Of several verdicts on one hint the first
    counts. A reply of a wrong form, or without a verdict on every hint, has one row with ``failure``.
    """
    items, failed = reply_items(replies)
    asked = requests.select(*CHUNK, "words", "hints")
    r = _fields(items).join(asked, CHUNK)
    own_hint = F.get(F.filter("hints", lambda h: h["id"] == F.col("hint_id")), F.lit(0))
    r = r.withColumns(
        {
            "own": own_hint,
            "gis": F.transform("words", lambda w: w["gi"].cast("bigint")),
            "tokens": F.transform("words", lambda w: T.clean(w["word"])),
            "wanted": F.transform(F.filter(F.split(F.btrim("span", F.lit(" \t\n")), r"(?U)\s+"), lambda t: t != ""), T.clean),
        }
    )
    # a verdict under an id that is no hint of the chunk answers nothing
    r = r.filter((F.col("place") >= 0) | F.col("own").isNotNull())
    a, b, n = F.array_position("gis", F.col("start")), F.array_position("gis", F.col("end")), F.size("wanted")
    r = r.withColumns({"a": F.coalesce(F.when(F.col("start") <= F.col("end"), a), F.lit(0)).cast("int"), "b": F.coalesce(b, F.lit(0)).cast("int")})
    inside = (F.col("a") > 0) & (F.col("b") > 0)
    near = F.when(inside, F.col("a")).otherwise(1)
    agrees = inside & ((n == 0) | (F.slice("tokens", F.greatest("a", F.lit(1)), F.greatest(F.col("b") - F.col("a") + 1, F.lit(0))) == F.col("wanted")))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size("tokens") - n + 1, F.lit(1))), lambda i: F.slice("tokens", i, n) == F.col("wanted"))
    r = r.withColumns({"agrees": agrees, "best": F.when(n > 0, F.array_min(F.transform(places, lambda i: F.struct(F.abs(i - near).alias("far"), i.alias("i")))))})
    span = lambda x, y: F.struct(x.cast("bigint").alias("start"), y.cast("bigint").alias("end"))
    at = F.col("best.i")
    found = F.when(F.col("agrees"), span(F.col("start"), F.col("end"))).when(at.isNotNull(), span(F.get("gis", at - 1), F.get("gis", at + n - 2))).when(F.col("own").isNotNull(), span(F.col("own.start"), F.col("own.end")))
    r = r.withColumn("found", found).filter(F.col("found").isNotNull())
    first = Window.partitionBy(*CHUNK, F.coalesce("own.id", F.concat(F.lit("#"), F.col("place").cast("string")))).orderBy("place")
    r = r.withColumn("__r", F.row_number().over(first)).filter("__r = 1")
    stands = F.array_join(F.transform(F.filter("words", lambda w: w["gi"].between(F.col("found.start"), F.col("found.end"))), lambda w: w["word"]), " ")
    on_hint, text = F.col("own").isNotNull(), F.col("written")
    same = F.when(on_hint, _spoken(text) == _spoken(stands)).otherwise(T.letters(text) == T.letters(stands))
    void = text.isNotNull() & (~F.col("heard") | same)
    r = r.withColumn("void", void).filter(on_hint | ~F.col("void"))
    verdicts = r.select(*CHUNK, "found.start", "found.end", F.when(~F.col("void"), text).alias("replacement"), "confidence", "rationale", F.col("own.id").alias("hint"))
    answered = verdicts.filter("hint IS NOT NULL").groupBy(*CHUNK).agg(F.collect_set("hint").alias("answered"))
    open_ = F.array_except(F.transform("hints", lambda h: h["id"]), F.coalesce("answered", F.array().cast("array<string>")))
    read = replies.select(*CHUNK).join(failed, CHUNK, "left_anti").join(asked.select(*CHUNK, "hints"), CHUNK).join(answered, CHUNK, "left").withColumn("open", F.array_sort(open_))
    silent = read.filter(F.size("open") > 0).select(*CHUNK, F.concat(F.lit("no verdict on "), F.array_join("open", ", ")).alias("failure"))
    failed = failed.unionByName(silent)
    return verdicts.join(failed.select(*CHUNK), CHUNK, "left_anti").unionByName(failed, allowMissingColumns=True)


class RequestError(RuntimeError):
    """A judge raises it when a request cannot be answered at all."""


#: A judge takes a chunk's words and hints and gives back its reply.
Judge = Callable[[list[tuple[int, str]], list[dict]], str]


def stub_judge(words: list[tuple[int, str]], hints: list[dict]) -> str:
    """A judge that needs no service: every hint's first candidate at 0.9, no error where there is none."""
    import json

    return json.dumps([[h["start"], h["end"], "", (h["candidates"] or [None])[0], CAUSE, 0.9, h["id"], "first candidate"] for h in hints])


def ask(requests: DataFrame, judge: Judge) -> DataFrame:
    """Replies of a judge: chunk, reply, failure (of a request that failed). Calls are spread with the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                words = [(int(w["gi"]), w["word"]) for w in r.words]
                hints = [{**{k: h[k] for k in ("id", "span")}, "start": int(h["start"]), "end": int(h["end"]), "candidates": [] if h["candidates"] is None else list(h["candidates"])} for h in r.hints]
                try:
                    out.append((r.transcript_id, r.chunk_no, judge(words, hints), None))
                except RequestError as e:
                    out.append((r.transcript_id, r.chunk_no, None, f"request failed: {e}"))
            yield pd.DataFrame(out, columns=[*CHUNK, "reply", "failure"])

    return requests.select(*CHUNK, "words", "hints").mapInPandas(run, "transcript_id string, chunk_no int, reply string, failure string")


@dataclass
class Judged:
    """``verdicts`` as ``read_replies`` gives them, and ``status``: chunk, calls, failure (null if it was read)."""

    verdicts: DataFrame
    status: DataFrame


def judge_chunks(requests: DataFrame, judge: Judge = stub_judge, retries: int = 1, max_calls: int | None = None) -> Judged:
    """Ask for every chunk, and again for those whose request or reply failed, up to ``retries`` times.

    ``max_calls`` caps the calls, retries included: chunks beyond it, in the order of their names, are not
    asked (again). New finds below ``MIN_CONFIDENCE`` are left out, verdicts on hints are kept. Runs a job
    for each round; what a round gives is written, so that no call is made twice.
    """
    pending = requests
    verdicts, status, calls = [], [], 0
    for attempt in range(retries + 1):
        if max_calls is not None:
            due = pending.count()
            if calls + due > max_calls:
                allowed = materialise(pending.orderBy(*CHUNK).limit(max(0, max_calls - calls)))
                left = pending.join(allowed.select(*CHUNK), CHUNK, "left_anti")
                status.append(left.select(*CHUNK, F.lit(attempt).alias("calls"), F.lit("no calls left").alias("failure")))
                pending, due = allowed, max(0, max_calls - calls)
            calls += due
        replies = materialise(ask(pending, judge))
        answered = replies.filter("failure IS NULL").select(*CHUNK, "reply")
        read = materialise(read_replies(answered, pending))
        failed = materialise(replies.filter("failure IS NOT NULL").select(*CHUNK, "failure").unionByName(read.filter("failure IS NOT NULL").select(*CHUNK, "failure")))
        verdicts.append(read.filter("failure IS NULL"))
        status.append(replies.select(*CHUNK).join(failed, CHUNK, "left_anti").select(*CHUNK, F.lit(attempt + 1).alias("calls"), F.lit(None).cast("string").alias("failure")))
        if attempt == retries or failed.isEmpty():
            status.append(failed.select(*CHUNK, F.lit(attempt + 1).alias("calls"), "failure"))
            break
        pending = materialise(pending.join(failed.select(*CHUNK), CHUNK, "left_semi"))
    found, ends = verdicts[0], status[0]
    for v in verdicts[1:]:
        found = found.unionByName(v)
    for s in status[1:]:
        ends = ends.unionByName(s)
    return Judged(found.filter(F.col("hint").isNotNull() | (F.col("confidence") >= MIN_CONFIDENCE)), ends)


def tallies(status: DataFrame) -> DataFrame:
    """One row: chunks, calls, failed, request_failed (of the failed), recovered (read after a retry)."""
    bad = F.col("failure").isNotNull()
    return status.agg(
        F.count("*").alias("chunks"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.count_if(bad).alias("failed"),
        F.count_if(F.startswith("failure", F.lit("request failed"))).alias("request_failed"), F.count_if(~bad & (F.col("calls") > 1)).alias("recovered"),
    )


def _touch(x: Column, y: Column) -> Column:
    return (x["start"] <= y["end"]) & (y["start"] <= x["end"])


def _covers(x: Column, y: Column) -> Column:
    return (x["start"] <= y["start"]) & (y["end"] <= x["end"])


def resolve_verdicts(verdicts: DataFrame, requests: DataFrame) -> DataFrame:
    """At most one verdict for each word of a chunk: chunk, start, end, replacement, confidence, rationale,
    hint, judged, absorbed.

    A hint's verdict that was widened over whole other hints, and touches nobody else's verdict, takes them
    over (``absorbed``); a hint is taken over once, and what takes over is not taken over. Another widened
    verdict that touches a hint or a verdict before it goes back to its own range, unjudged. New finds fill
    what is left, the most confident first. Verdicts count in the order of their ranges.
    """
    v = F.struct("start", "end", "hint", "replacement", "confidence", "rationale")
    per = verdicts.groupBy(*CHUNK).agg(F.array_sort(F.collect_list(v)).alias("vs"))
    per = per.join(requests.select(*CHUNK, F.transform("hints", lambda h: F.struct(h["id"].alias("hint"), h["start"].alias("start"), h["end"].alias("end"))).alias("hs")), CHUNK)
    own = lambda x: F.get(F.filter("hs", lambda h: h["hint"] == x["hint"]), F.lit(0))
    fields = ("start", "end", "hint", "replacement", "confidence", "rationale")
    answered = F.transform(F.filter("vs", lambda x: x["hint"].isNotNull()), lambda x: F.struct(*[x[f].alias(f) for f in fields], own(x)["start"].alias("from"), own(x)["end"].alias("upto")))
    per = per.withColumn("answered", answered).withColumn("finds", F.filter("vs", lambda x: x["hint"].isNull()))
    # who is widened, and over whom
    met = lambda x: F.filter("hs", lambda h: (h["hint"] != x["hint"]) & _touch(x, h))
    widened = lambda x: (x["start"] != x["from"]) | (x["end"] != x["upto"])
    per = per.withColumn("answered", F.transform("answered", lambda x: F.struct(*[x[f].alias(f) for f in (*fields, "from", "upto")], widened(x).alias("widened"), met(x).alias("met"))))

    def alone(x: Column) -> Column:
        strangers = F.filter("answered", lambda w: (w["hint"] != x["hint"]) & _touch(w, x))
        return F.forall(strangers, lambda w: F.exists(x["met"], lambda h: h["hint"] == w["hint"]))

    able = F.filter("answered", lambda x: x["widened"] & (F.size(x["met"]) > 0) & F.forall(x["met"], lambda h: _covers(x, h)) & alone(x))
    teams = F.transform(able, lambda x: F.struct(x["hint"].alias("hint"), F.transform(x["met"], lambda h: h["hint"]).alias("others")))
    none = F.array().cast("array<struct<hint:string,others:array<string>>>")
    free = lambda done, t: F.forall(done, lambda d: (d["hint"] != t["hint"]) & ~F.array_contains(t["others"], d["hint"]) & ~F.array_contains(d["others"], t["hint"]) & ~F.arrays_overlap(d["others"], t["others"]))
    per = per.withColumn("teams", teams).withColumn("teams", F.aggregate("teams", none, lambda done, t: F.when(free(done, t), F.concat(done, F.array(t))).otherwise(done)))
    gone = F.flatten(F.transform("teams", lambda t: t["others"]))
    per = per.withColumn("gone", gone)
    kind = "array<struct<start:bigint,end:bigint,hint:string,replacement:string,confidence:double,rationale:string,judged:boolean,absorbed:array<string>>>"

    def entry(x: Column, start: Column, end: Column, text: Column, judged: Column, absorbed: Column) -> Column:
        return F.array(F.struct(start.alias("start"), end.alias("end"), x["hint"].alias("hint"), text.alias("replacement"), x["confidence"].alias("confidence"), x["rationale"].alias("rationale"), judged.alias("judged"), absorbed.alias("absorbed")))

    nobody = F.array().cast("array<string>")

    def settle(kept: Column, x: Column) -> Column:
        team = F.get(F.filter("teams", lambda t: t["hint"] == x["hint"]), F.lit(0))
        back = x["widened"] & team.isNull() & ((F.size(x["met"]) > 0) | F.exists(kept, lambda k: _touch(k, x)))
        taken = entry(x, F.when(back, x["from"]).otherwise(x["start"]), F.when(back, x["upto"]).otherwise(x["end"]), F.when(~back, x["replacement"]), ~back, F.coalesce(team["others"], nobody))
        return F.concat(kept, taken)

    per = per.withColumn("kept", F.aggregate(F.filter("answered", lambda x: ~F.array_contains("gone", x["hint"])), F.array().cast(kind), settle))
    ordered = F.array_sort(F.transform("finds", lambda x: F.struct((-x["confidence"]).alias("c"), x.alias("x"))))
    fill = lambda kept, s: F.when(F.exists(kept, lambda k: _touch(k, s["x"])), kept).otherwise(F.concat(kept, entry(s["x"], s["x"]["start"], s["x"]["end"], s["x"]["replacement"], F.lit(True), nobody)))
    return per.withColumn("all", F.aggregate(ordered, F.col("kept"), fill)).select(*CHUNK, F.inline("all"))


def verdict_flags(resolved: DataFrame, requests: DataFrame, flags: DataFrame, words: DataFrame) -> DataFrame:
    """A flag for every resolved verdict, with the columns of ``flags`` (see ``detect``).

    A verdict that keeps its hint's range keeps the hint's flag. A widened one, or a new find, has a flag of
    its own over its words: its detector is the hint's with ``DETECTOR`` added, or ``DETECTOR`` alone, its
    candidate what it writes.
    """
    hints = requests.select(*CHUNK, F.inline("hints")).select(*CHUNK, F.col("id").alias("hint"), F.col("start").alias("h_lo"), F.col("end").alias("h_hi"))
    base = flags.select("transcript_id", F.col("lo").alias("h_lo"), F.col("hi").alias("h_hi"), F.col("detector").alias("h_detector"), F.col("reason").alias("h_reason"))
    v = resolved.join(hints, [*CHUNK, "hint"], "left").join(base, ["transcript_id", "h_lo", "h_hi"], "left").withColumnsRenamed({"start": "lo", "end": "hi"})
    same = F.coalesce((F.col("lo") == F.col("h_lo")) & (F.col("hi") == F.col("h_hi")), F.lit(False))
    kept = flags.join(v.filter(same).select("transcript_id", "lo", "hi").distinct(), ["transcript_id", "lo", "hi"], "left_semi")
    fresh = v.filter(~same).select("transcript_id", "lo", "hi", "hint", "replacement", "confidence", "rationale", "h_detector", "h_reason")
    each = fresh.withColumn("global_index", F.explode(F.sequence("lo", "hi"))).join(words.select("transcript_id", "global_index", "word", "cue_index", "start_us", "end_us"), ["transcript_id", "global_index"])
    key = [c for c in fresh.columns]
    per = each.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("global_index", "word"))), lambda x: x["word"]).alias("ws"),
        F.min_by("cue_index", "global_index").alias("cue_index"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
    )
    made = per.select(
        "transcript_id", "lo", "hi", T.span_text(F.col("ws")).alias("span"), "cue_index", "start_us", "end_us",
        F.concat_ws("+", "h_detector", F.lit(DETECTOR)).alias("detector"), F.concat_ws("; ", "h_reason", F.nullif("rationale", F.lit(""))).alias("reason"),
        F.array_compact(F.array("replacement")).alias("candidates"), "confidence",
    )
    return kept.select(*made.columns).unionByName(made)
