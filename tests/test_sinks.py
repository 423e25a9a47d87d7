import json

import pytest
from pyspark.sql import functions as F

from murmurlake.functions import text as T
from murmurlake.operators import detect as D
from murmurlake.operators import score as S
from murmurlake.operators.tokens import words
from murmurlake.sources import records as R


def test_metadata_and_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text('file,name\na,"B, C"\nb,"two\nlines"\n')
    assert [tuple(r) for r in R.read_metadata(spark, str(tmp_path / "m.csv")).collect()] == [("a", "B, C"), ("b", "two\nlines")]
    (tmp_path / "m.json").write_text(json.dumps({"sources": {"x.srt": {"priming_terms": ["K", "L"]}, "y.srt": {}}}, indent=1))
    assert sorted(map(tuple, R.read_manifest(spark, str(tmp_path / "m.json")).collect())) == [("x.srt", ["K", "L"], True), ("y.srt", [], True)]


def test_decisions_are_remembered(spark, tmp_path):
    rows = [("kafka", "m", "Kafka", 0.9, "r"), ("kafka", "n", None, 0.1, ""), ('a "b"', "m", None, 0.0, "")]
    d = spark.createDataFrame(rows, R.DECISION)
    path = tmp_path / "cache.json"
    path.write_text(R.compose_decisions(d).first().content)
    again = R.read_decisions(spark, str(path))
    assert sorted(map(str, again.collect())) == sorted(map(str, d.collect()))
    flags = spark.createDataFrame([(1, "Kafka,"), (2, "other"), (3, None)], "flag_id int, span string")
    got = {r.flag_id: r.decision and r.decision.replacement for r in R.with_decision(flags, again, "m").collect()}
    assert got == {1: "Kafka", 2: None, 3: None}
    path.write_text("no json")
    assert R.read_decisions(spark, str(path)).count() == R.read_decisions(spark, str(tmp_path / "none")).count() == 0


def test_upsert_takes_the_newest(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    c = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "y", 1), (3, "x", 1)], "k int, v string, at int")
    assert sorted(map(tuple, R.upsert(t, c, ["k"], "at").collect())) == [(1, "a"), (2, "new"), (3, "y")]
    assert sorted(map(tuple, R.upsert(t, c, ["k"]).collect())) == [(1, "a"), (2, "old"), (3, "y")]
    assert [r.k for r in R.without(t, "k", c).collect()] == [1] and R.find_record(t, "v", "b").first().k == 2


def test_ledger_and_usage(spark, tmp_path):
    ledger, short = str(tmp_path / "ledger"), str(tmp_path / "short")
    for at, n in (("2024-01-01 00:00:00", 5), ("2024-01-02 00:00:00", 7), ("2024-01-02 00:00:01", 8)):
        R.append_ledger(spark.sql(f"SELECT TIMESTAMP '{at}' AS at, 's' AS session, {n}L AS words, 0.5D AS cost_usd, {n}L AS transcript_words"), ledger)
    day = 86_400_000_000
    assert sorted(r.words for r in R.compact_ledger(spark, ledger, short, day, "2024-01-03 00:00:00").collect()) == [8]
    assert R.parse_ledger(spark.read.text(ledger)).count() == 3
    usage = str(tmp_path / "usage")
    R.append_usage(spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' AS at, 'visit' AS event, CAST(NULL AS STRING) AS detail UNION ALL SELECT TIMESTAMP '2024-01-02 00:00:00', 'export', 'srt'"), usage, ["visit", "export"])
    assert sorted((r.event, r.detail) for r in R.parse_usage(spark.read.text(usage), ["visit", "export"]).collect()) == [("export", "srt"), ("visit", None)]
    for event, detail in (("other", None), ("visit", "a b")):
        with pytest.raises(ValueError, match="unsafe detail"):
            R.append_usage(spark.createDataFrame([(event, detail)], "event string, detail string").withColumn("at", F.current_timestamp()), usage, ["visit"])
    assert spark.read.text(usage).count() == 2


def test_sidecar(spark, tmp_path):
    row = [("a", [0], 1, 1_000_000, 2_000_000, "oov", "r", ["b"], 0.5, "c", "dismissed")]
    df = spark.createDataFrame(row, "span string, global_indices array<int>, cue_index int, start_us bigint, end_us bigint, detector string, reason string, candidates array<string>, confidence double, context string, outcome string")
    R.write_sidecar(df, str(tmp_path / "side"))
    got = json.loads(spark.read.text(str(tmp_path / "side")).first().value)
    assert got["outcome"] == "dismissed" and got["flag"]["start"] == 1.0 and list(got["flag"]) == ["span", "global_indices", "cue_index", "start", "end", "detector", "reason", "candidates", "confidence", "context"]


def test_upload_date(spark):
    assert spark.sql("SELECT TIMESTAMP '2026-10-04 09:05:07' AS t").select(T.upload_date(F.col("t")).alias("d")).first().d == "4 Oct 2026, 09:05 UTC"


def test_unknown_words_up_to_a_frequency(spark):
    cues = spark.createDataFrame([(1, "t", 0, 1, 0, 9, "the zorvex hums")], "cue_id bigint, transcript_id string, cue_order int, cue_index int, start_us bigint, end_us bigint, text string")
    freq = spark.createDataFrame([("hums", 1.5), ("the", 7.0)], "cleaned string, zipf double")
    terms = spark.createDataFrame([], "term string")
    spans = lambda **kw: {r.span: r.confidence for r in D.out_of_vocabulary(D.inputs(words(cues), terms, freq, **kw)).collect()}
    assert spans() == {"zorvex": 0.9} and spans(oov_zipf=2.0) == {"zorvex": 0.9, "hums": 0.4}


def test_runs_over_a_corpus(spark):
    w = spark.createDataFrame([("t", i, c) for i, c in enumerate("we use cough ka now".split())], "transcript_id string, global_index bigint, cleaned string")
    cases = spark.createDataFrame([("1", "t", "t", "cough ka", "should-flag", "Kafka", "phrase"), ("2", "t", "t", "now", "should-not-flag", None, "word")], "case_id string, source string, transcript_id string, phrase string, verdict string, candidate string, kind string")
    flags = spark.createDataFrame([(1, "t", 2, 2, "oov", [])], "flag_id bigint, transcript_id string, lo bigint, hi bigint, detector string, candidates array<string>")
    r = S.evaluate(cases, w, lambda: flags).first()
    assert (r.tp, r.fn, r.tn, r.fp, r.cold) == (1, 0, 1, 0, 1)
    called = []
    with pytest.raises(ValueError, match="not found"):
        S.evaluate(cases.unionByName(cases.limit(1).withColumns({"case_id": F.lit("3"), "phrase": F.lit("nowhere")})), w, lambda: called.append(1))
    assert not called
    hits = S.case_hits(cases, S.locate(cases, w), flags)
    assert S.headline(hits, ["phrase"]).first().asDict() == {"caught": 1, "cases": 1, "recall": 1.0} and S.headline(hits, ["none"]).first().recall is None
    more = spark.createDataFrame([("z",), ("t",), ("a",)], "source string")
    assert [r.source for r in S.sources_of(cases, more).orderBy("place").collect()] == ["t", "a", "z"]
