"""Scores of findings against labelled cases."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.functions import text as T
from murmurlake.session import materialise


def locate(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Every occurrence of a phrase in its transcript: all columns of ``phrases`` with lo and hi.

    ``phrases`` has transcript_id and phrase; texts are compared by their clean words. With a column
    ``context``, a phrase that has one is found only within it: its first place in each occurrence of the
    context. What is looked for meets the places of its first word by equi-join, then each following word
    by position, one step per word of the longest text; nothing is compared all against all.
    """
    cut = lambda c: F.transform(F.split(F.btrim(c, F.lit(" \t\n")), r"\s+"), T.clean)
    rows = phrases.withColumn("__ws", F.filter(cut("phrase"), lambda w: w != "")).filter(F.size("__ws") > 0)
    w = words.select("transcript_id", "global_index", F.coalesce("cleaned", F.lit("")).alias("cleaned"))
    if "context" in phrases.columns:
        # within a context marks that stand alone keep their places, as in the transcript
        bound = F.col("context").isNotNull()
        rows = rows.withColumns({"__ws": F.when(bound, cut("phrase")).otherwise(F.col("__ws")), "__in": F.when(bound, cut("context")).otherwise(F.col("__ws"))})
        n = F.size("__ws")
        fits = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("__in") - n)), lambda i: F.slice("__in", i + 1, n) == F.col("__ws"))
        rows = rows.withColumn("__at", F.get(fits, F.lit(0))).filter(F.col("__at").isNotNull())
    else:
        w = w.filter(F.col("cleaned") != "")
        rows = rows.withColumns({"__in": F.col("__ws"), "__at": F.lit(0)})
    firsts = w.select("transcript_id", F.col("global_index").alias("lo"), F.col("cleaned").alias("__first"))
    starts = rows.withColumn("__first", F.col("__in")[0]).join(firsts, ["transcript_id", "__first"])
    # the words at lo, lo + 1, ... that agree are counted; all must
    # written, so that both uses see the same numbers
    needed = materialise(starts.withColumn("__id", F.monotonically_increasing_id()))
    each = needed.select("__id", "transcript_id", "lo", F.posexplode("__in").alias("p", "cleaned")).withColumn("global_index", F.col("lo") + F.col("p"))
    agree = each.join(w, ["transcript_id", "global_index", "cleaned"], "left_semi").groupBy("transcript_id", "__id").agg(F.count("*").alias("__n"))
    found = needed.join(agree.drop("transcript_id"), "__id").filter(F.col("__n") == F.size("__in")).withColumn("lo", F.col("lo") + F.col("__at"))
    return found.withColumn("hi", F.col("lo") + F.size("__ws") - 1).drop("__id", "__n", "__ws", "__in", "__at", "__first")


def require_found(cases: DataFrame, occurrences: DataFrame, name: int = 5) -> None:
    """Raise ``ValueError`` if a case has no occurrence; the first ``name`` such cases are named."""
    lost = cases.select("case_id").join(occurrences.select("case_id"), "case_id", "left_anti").distinct()
    first = [r["case_id"] for r in lost.orderBy("case_id").limit(name).collect()]
    if first:
        raise ValueError(f"cases not found in their transcripts, the first of them: {first}")


def case_hits(cases: DataFrame, occurrences: DataFrame, flags: DataFrame) -> DataFrame:
    """Per case whether a flag touches one of its occurrences (``touched``) and one that does proposes its
    candidate (``proposed``; a case without candidate asks for none).

    Flags and occurrences meet on (transcript, word position).
    """
    spots = occurrences.select("case_id", "transcript_id", F.explode(F.sequence("lo", "hi")).alias("gi"))
    found = flags.select("transcript_id", F.explode(F.sequence("lo", "hi")).alias("gi"), "candidates")
    met = spots.join(found, ["transcript_id", "gi"]).select("case_id", "candidates").join(cases.select("case_id", "candidate"), "case_id")
    match = F.col("candidate").isNull() | F.exists("candidates", lambda c: F.contains(F.lower(c), F.lower("candidate")))
    hits = met.groupBy("case_id").agg(F.bool_or(F.coalesce(match, F.lit(False))).alias("proposed"))
    out = cases.join(hits.withColumn("touched", F.lit(True)), "case_id", "left")
    return out.withColumns({"touched": F.coalesce("touched", F.lit(False)), "proposed": F.coalesce("proposed", F.lit(False))})


def sources_of(cases: DataFrame, exhaustive: DataFrame) -> DataFrame:
    """source, place: every source once, those of cases in the order of ``case_id`` first, then the exhaustive
    ones by name."""
    first = cases.groupBy("source").agg(F.min("case_id").alias("at")).withColumn("rank", F.lit(0))
    more = exhaustive.select("source").distinct().join(first, "source", "left_anti").withColumns({"at": F.col("source"), "rank": F.lit(1)})
    both = first.unionByName(more)
    return both.select("source", F.row_number().over(Window.orderBy("rank", "at")).alias("place"))


def evaluate(cases: DataFrame, words: DataFrame, system: Callable[[], DataFrame], match_candidates: bool = False) -> DataFrame:
    """The report of a system over labelled cases.

    ``cases`` has case_id, transcript_id, phrase, verdict, candidate, kind, perhaps context and entity. All
    cases are located before ``system`` is called, and ``ValueError`` is raised if one is not found, so a
    costly run is not wasted on a wrong corpus. ``system`` gives flags with flag_id, lo, hi, detector, candidates.
    """
    found = materialise(locate(cases, words))
    require_found(cases, found)
    flags = materialise(system())
    errors = found.filter("verdict = 'should-flag'").select("transcript_id", F.explode(F.sequence("lo", "hi")).alias("gi"))
    return report(case_hits(cases, found, flags), flags, errors, match_candidates)


def report(hits: DataFrame, flags: DataFrame, errors: DataFrame, match_candidates: bool = True) -> DataFrame:
    """One row: recall, specificity, cold rate, flag precision and their counts.

    No cases of a class count as 1.0, no flags as a cold rate of 0.0 and a flag precision of null. A flag
    is cold if its detectors include 'oov' and it has no candidates. ``errors`` are the words (transcript_id,
    gi) of should-flag cases, for the precision of single flags. With a column ``entity`` in ``hits``, the
    should-flag cases of entities are tallied too: entity_caught of entity_cases, null if there are none.
    """
    hit = F.col("proposed") if match_candidates else F.col("touched")
    should, shouldnt = F.col("verdict") == "should-flag", F.col("verdict") == "should-not-flag"
    entity = should & F.col("entity") if "entity" in hits.columns else None
    tally = {} if entity is None else {"entity_caught": F.count_if(entity & hit), "entity_cases": F.count_if(entity)}
    per_case = hits.agg(F.count_if(should & hit).alias("tp"), F.count_if(should & ~hit).alias("fn"), F.count_if(shouldnt & ~F.col("touched")).alias("tn"), F.count_if(shouldnt & F.col("touched")).alias("fp"), *[c.alias(n) for n, c in tally.items()])
    cold = is_cold(flags)
    wrong = flags.select("flag_id", "transcript_id", F.explode(F.sequence("lo", "hi")).alias("gi")).join(errors.distinct(), ["transcript_id", "gi"], "left_semi").select("flag_id").distinct()
    per_flag = flags.join(wrong.withColumn("wrong", F.lit(True)), "flag_id", "left").agg(F.count("*").alias("flags"), F.count_if(cold).alias("cold"), F.count_if(F.col("wrong").isNotNull()).alias("touching"))
    # two tables of one row each, put side by side by a constant key
    both = per_case.withColumn("k", F.lit(1)).join(per_flag.withColumn("k", F.lit(1)), "k").drop("k")

    def share(num: str, other: str):
        return F.when(F.col(num) + F.col(other) == 0, F.lit(1.0)).otherwise(F.col(num) / (F.col(num) + F.col(other)))

    return both.select(
        share("tp", "fn").alias("recall"), share("tn", "fp").alias("specificity"), F.coalesce(F.try_divide("cold", "flags"), F.lit(0.0)).alias("cold_rate"),
        F.try_divide("touching", "flags").alias("flag_precision"), "tp", "fn", "tn", "fp", "flags", "cold", "touching",
        *[F.when(F.col("entity_cases") > 0, F.col(n)).alias(n) for n in tally],
    )


def is_cold(flags: DataFrame) -> Column:
    """Whether a flag is an unknown word nobody has a candidate for; false where the detector is null."""
    return F.coalesce(F.array_contains(F.split("detector", r"\+"), "oov") & (F.size("candidates") == 0), F.lit(False))


def headline(hits: DataFrame, kinds: Sequence[str], kind: str = "kind") -> DataFrame:
    """One row: caught of cases over the chosen kinds, and the share (null without cases)."""
    rows = by_kind(hits, kind).filter(F.col(kind).isin(*kinds))
    sums = rows.agg(F.coalesce(F.sum("touched"), F.lit(0)).alias("caught"), F.coalesce(F.sum("cases"), F.lit(0)).alias("cases"))
    return sums.withColumn("recall", F.try_divide("caught", "cases"))


def by_kind(hits: DataFrame, kind: str = "kind") -> DataFrame:
    """Caught and all should-flag cases of every kind, by touch and with the right candidate."""
    rows = hits.filter((F.col("verdict") == "should-flag") & F.col(kind).isNotNull())
    return rows.groupBy(kind).agg(F.count_if("touched").alias("touched"), F.count_if("proposed").alias("proposed"), F.count("*").alias("cases"))
