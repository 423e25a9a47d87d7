import json

import pytest
from pyspark.sql import functions as F

from murmurlake.operators.tokens import words
from murmurlake.sources import captions as C
from murmurlake.sources import records as R

SRT = "﻿5\r\n00:00:01,000 --> 00:00:02,500\r\n- Zwei\r\nZeilen\r\n\r\n9\r\n00:00:03,000 --> 00:00:04,000\r\nEnde.\r\n"
VTT = "WEBVTT\n\nintro\n00:01.000 --> 00:02.500 align:left\n- Zwei\nZeilen\n\n00:00:03.000 --> 00:00:04.000\nEnde.\n"


def test_both_formats_read_alike(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.srt", SRT), ("b.VTT", VTT), ("c.txt", "x"), ("d.srt", "no cue here")):
        (tmp_path / "in" / name).write_text(text, newline="")
    cues, bad = C.read_captions(spark, str(tmp_path / "in"))
    rows = {(r.transcript_id, r.cue_order): (r.cue_index, r.start_us, r.end_us, r.text) for r in cues.collect()}
    assert rows[("a", 0)] == (5, 1000000, 2500000, "- Zwei\nZeilen")
    assert rows[("a", 1)][0] == 9
    assert rows[("b", 0)] == (1, 1000000, 2500000, "- Zwei\nZeilen")
    assert rows[("b", 1)] == (2, 3000000, 4000000, "Ende.")
    assert sorted(r.reason for r in bad.collect()) == ["no cues", "unsupported ending"]


@pytest.mark.parametrize("kind", ["srt", "vtt"])
def test_round_trip(spark, tmp_path, kind):
    data = [("t", 0, 1, 2000000, 3000000, "zwei"), ("t", 1, 2, 0, 1000000, "eins\nund"), ("t", 2, 3, 4000000, 5000000, "drei.")]
    cues = spark.createDataFrame(data, "transcript_id string, cue_order int, cue_index int, start_us bigint, end_us bigint, text string")
    C.write_captions(cues, str(tmp_path / "out"), kind)
    files = spark.read.format("text").option("wholetext", True).load(str(tmp_path / "out")).select(F.concat("transcript_id", F.lit("." + kind)).alias("path"), F.col("value").alias("content"))
    back = sorted((r.start_us, r.end_us, r.text) for r in C.parse_captions(files)[0].collect())
    assert back == sorted((s, e, t) for _, _, _, s, e, t in data)
    again = C.parse_captions(files)[0].withColumn("cue_id", F.monotonically_increasing_id())
    said = [r.word for r in words(again).orderBy("global_index").collect()]
    assert sorted(said) == ["drei.", "eins", "und", "zwei"]


def test_srt_is_sorted_and_leaves_out_what_would_not_read_back(spark):
    data = [("t", 0, 1, 5, 5, "x"), ("t", 1, 2, 2000, 9000, "b"), ("t", 2, 3, 1000, 2000, "a"), ("t", 3, 4, 1, 2, None)]
    cues = spark.createDataFrame(data, "transcript_id string, cue_order int, cue_index int, start_us bigint, end_us bigint, text string")
    text = C.compose_captions(cues).first().content
    assert text == "1\n00:00:00,001 --> 00:00:00,002\na\n\n2\n00:00:00,002 --> 00:00:00,009\nb\n"
    with pytest.raises(ValueError):
        C.compose_captions(cues, "ass")


def test_token_files(spark, tmp_path):
    head = "token|speaker|ts|endTs|punctuation|case|tags|wer_tags\n"
    (tmp_path / "c1.nlp").write_text(head + "Hello|1|0.5|0.9|,|UC||['3']\n<crosstalk>|1|||||\n*|1|||||\n|1|||||\n.||bad|.|.|CA||[]\n")
    (tmp_path / "tags").mkdir()
    (tmp_path / "tags" / "c1.json").write_text(json.dumps({"3": {"entity_type": "ORG"}}))
    tags = R.read_tag_map(spark, str(tmp_path / "tags" / "c1.json"))
    rows = R.read_tokens(spark, str(tmp_path / "c1.nlp"), tags).orderBy("pos").collect()
    assert [(r.token, r.speaker, r.start_s, r.end_s, r.punctuation, r.entity_types) for r in rows] == [("Hello", "1", 0.5, 0.9, ",", ["ORG"]), (".", None, None, None, ".", [])]


def test_terms_cases_state_and_logs(spark, tmp_path):
    (tmp_path / "terms.txt").write_text("Alpha # first\n\n# only a note\n beta gamma \n")
    assert [r.term for r in R.read_terms(spark, str(tmp_path / "terms.txt")).collect()] == ["Alpha", "beta gamma"]
    (tmp_path / "cases.json").write_text(json.dumps([{"source": "a", "span": "x", "verdict": "should-flag"}]))
    case = R.read_cases(spark, str(tmp_path / "cases.json")).first()
    assert case.entity is False and case.candidate is None
    state = {"id": "t", "session_id": "s", "created_at": "2024-01-01T00:00:00Z", "flags": [{"span": "x", "start": 1.5}, {"span": "y"}], "corrections": [None, {"replacement": "z"}]}
    (tmp_path / "state.json").write_text(json.dumps(state))
    rows = R.read_state(spark, str(tmp_path / "state.json")).orderBy("flag_no").collect()
    assert [(r.flag_no, r.span, r.correction and r.correction.replacement) for r in rows] == [(0, "x", None), (1, "y", "z")]
    assert rows[0].last_activity == rows[0].created_at
    lines = spark.createDataFrame([('{"at":"2024-01-01T00:00:00Z","session":"s","words":5}',), ("broken",), ('{"session":"s"}',)], "value string")
    assert [r.transcript_words for r in R.parse_ledger(lines).collect()] == [5]
    usage = spark.createDataFrame([("2024-01-01T10:00:00+00:00 visit ref",), ("2024-01-01T10:00:00+00:00 other",), ("nonsense",), ("2024-01-02T00:00:00+00:00 visit",)], "value string")
    assert [(r.event, r.detail) for r in R.parse_usage(usage, ["visit"]).orderBy("at").collect()] == [("visit", "ref"), ("visit", None)]


def test_upsert_and_flag_json(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    c = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, R.upsert(t, c, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    f = spark.createDataFrame([("x", [1], 0, 1500000, 2000000, "oov", "r", ["y"], 0.5, "c")], "span string, global_indices array<int>, cue_index int, start_us bigint, end_us bigint, detector string, reason string, candidates array<string>, confidence double, context string")
    out = json.loads(R.flag_json(f).first().json)
    assert out["start"] == 1.5 and len(out) == 10
