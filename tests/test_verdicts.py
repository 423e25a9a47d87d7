import json

import pytest

from murmurlake.operators import chunks as C
from murmurlake.operators import verdicts as V

REQUEST = "transcript_id string, chunk_no int, words array<struct<gi:int,word:string>>, hints array<struct<id:string,start:bigint,end:bigint,span:string,candidates:array<string>>>"
WORDS = [(10, "the"), (11, "cough"), (12, "ka"), (13, "raft."), (14, "cough")]
HINT = ("h1", 11, 12, "cough ka", ["Kafka"])


def read(spark, *replies, hints=(HINT,)):
    """Verdicts of replies to one chunk each: lists of (start, end, replacement, confidence, hint), or the failure."""
    texts = [r if isinstance(r, str) else json.dumps(r) for r in replies]
    requests = spark.createDataFrame([("t", i, WORDS, list(hints)) for i in range(len(texts))], REQUEST)
    rows = V.read_replies(spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "transcript_id string, chunk_no int, reply string"), requests).collect()
    out = [[] for _ in texts]
    for r in rows:
        if r.failure:
            assert out[r.chunk_no] == []
            out[r.chunk_no] = r.failure
        else:
            out[r.chunk_no].append((r.start, r.end, r.replacement, r.confidence, r.hint))
    return [x if isinstance(x, str) else sorted(x, key=str) for x in out]


def test_forms_of_replies(spark):
    verdict = [11, 12, "cough ka", "Kafka", "misheard", 2, "h1", "r"]
    named = dict(zip(V.FIELDS, verdict))
    fenced = "```json\n" + json.dumps([verdict]) + "\n```"
    keyed = {"hints": {"h1": [1, 2, "", None, "misheard", 0.5, ""], "h9": [11, 11, "", "x", "misheard", 1, ""]}, "errors": [[99, 99, "raft", "graph", "misheard", 0.95, ""], [13, 13, "raft.", "Raft", "misheard", 1, ""], [13, 13, "raft", "x", "grammar", 1, ""], [1, 2, "nowhere", "x", "misheard", 1, ""], [13, 13, "raft"], 7]}
    got = read(spark, [verdict], [named], {"verdicts": [named]}, fenced, keyed)
    assert got[:4] == [[(11, 12, "Kafka", 1.0, "h1")]] * 4
    assert got[4] == [(11, 12, None, 0.5, "h1"), (13, 13, "graph", 0.95, None)]


def test_replies_that_fail(spark):
    got = read(spark, "nope", {}, [], {"hints": []}, {"hints": {}, "errors": {}}, "", "3")
    assert got[0] == got[5] == "no JSON" and got[1] == got[6] == "no list of verdicts" and got[2] == "no verdict on h1"
    assert got[3].startswith("hints are not keyed") and got[4].startswith("hints are not keyed")
    assert read(spark, [], hints=()) == [[]]


def test_places_and_causes(spark):
    v = lambda *x: [[*x]]
    got = read(
        spark,
        v(11, 12, "", "coughka", "misheard", 0.9, "h1"),  # a changed word boundary counts on a hint
        v(11, 12, "", "Cough, ka!", "misheard", 0.9, "h1"),  # marks and case do not
        v(13, 13, "cough", "x", "misheard", "0.4", "h1"),  # moved to the nearest place, the later one is as near
        v(5, 6, "zzz", "x", "misheard", None, "h1"),  # nowhere: the hint's own range
        v("11", "12", "cough ka", "x", "style", 1, "h1"),  # a range in strings is none; another cause corrects nothing
        [[11, 12, "", "a", "misheard", 1, "h1"], [11, 12, "", "b", "misheard", 1, "h1"]],
    )
    assert got == [[(11, 12, "coughka", 0.9, "h1")], [(11, 12, None, 0.9, "h1")], [(14, 14, "x", 0.4, "h1")], [(11, 12, "x", 0.0, "h1")], [(11, 12, None, 1.0, "h1")], [(11, 12, "a", 1.0, "h1")]]
    assert read(spark, [[11, 12, "", "coughka", "misheard", 1]], hints=()) == [[]]


def resolved(spark, hints, verdicts):
    """(start, end, hint, judged, absorbed) after resolution; hints and verdicts as (id, start, end)."""
    requests = spark.createDataFrame([("t", 0, [], [(h, a, b, "", []) for h, a, b in hints])], REQUEST)
    rows = [("t", 0, a, b, "x", c, "", h) for h, a, b, c in [(*v, 0.9)[:4] for v in verdicts]]
    df = spark.createDataFrame(rows, "transcript_id string, chunk_no int, start bigint, end bigint, replacement string, confidence double, rationale string, hint string")
    return sorted((r.start, r.end, r.hint, r.judged, r.absorbed) for r in V.resolve_verdicts(df, requests).collect())


def test_resolution_gives_every_word_one_verdict(spark):
    hints = [("h1", 1, 1), ("h2", 2, 2), ("h3", 5, 5)]
    got = resolved(spark, hints, [("h1", 1, 2), ("h2", 2, 2), ("h3", 5, 5), (None, 2, 3), (None, 7, 8, 0.91), (None, 8, 9, 0.95)])
    assert got == [(1, 2, "h1", True, ["h2"]), (5, 5, "h3", True, []), (8, 9, None, True, [])]
    got = resolved(spark, [("h1", 1, 1), ("h2", 2, 2), ("h3", 5, 6)], [("h1", 1, 1), ("h2", 2, 5), ("h3", 5, 6)])
    assert got == [(1, 1, "h1", True, []), (2, 2, "h2", False, []), (5, 6, "h3", True, [])]
    # both would take the other over: the first in order does; widened over nobody, a verdict stays wide
    assert resolved(spark, hints[:2], [("h1", 1, 2), ("h2", 1, 2)]) == [(1, 2, "h1", True, ["h2"])]
    assert resolved(spark, hints[:1], [("h1", 1, 4)]) == [(1, 4, "h1", True, [])]
    # what it is widened over has a verdict that reaches beyond
    assert resolved(spark, hints, [("h1", 1, 2), ("h2", 2, 3), ("h3", 5, 5)])[0] == (1, 2, "h1", True, ["h2"])
    assert resolved(spark, hints, [("h1", 1, 2), ("h2", 2, 2), ("h3", 2, 5)])[0] == (1, 1, "h1", False, [])


def test_rounds_caps_and_tallies(spark):
    hints = [("h0", 1, 1, "a", ["b"])]
    requests = spark.createDataFrame([("t", i, [(1, "a")], hints) for i in range(4)], REQUEST)
    assert V.tallies(V.judge_chunks(requests, lambda w, h: "garbage").status).first().asDict() == {"chunks": 4, "calls": 8, "failed": 4, "request_failed": 0, "recovered": 0}
    good = V.judge_chunks(requests)
    assert {r.replacement for r in good.verdicts.collect()} == {"b"} and V.tallies(good.status).first().asDict() == {"chunks": 4, "calls": 4, "failed": 0, "request_failed": 0, "recovered": 0}

    def down(words, hints):
        raise V.RequestError("out of reach")

    capped = V.judge_chunks(requests, down, max_calls=6).status
    assert V.tallies(capped).first().asDict() == {"chunks": 4, "calls": 6, "failed": 4, "request_failed": 2, "recovered": 0}
    assert sorted(r.failure for r in capped.collect())[:2] == ["no calls left"] * 2
    assert V.tallies(V.judge_chunks(requests.limit(0)).status).first().calls == 0


def test_chunks_recover(spark, tmp_path):
    requests = spark.createDataFrame([("t", 0, [(1, "a")], [("h0", 1, 1, "a", ["b"])])], REQUEST)
    marker = str(tmp_path / "asked")

    def second_time(words, hints):
        import os

        if os.path.exists(marker):
            return V.stub_judge(words, hints)
        open(marker, "w").close()
        return "garbage"

    got = V.judge_chunks(requests, second_time)
    assert V.tallies(got.status).first().asDict() == {"chunks": 1, "calls": 2, "failed": 0, "request_failed": 0, "recovered": 1}


def test_verdicts_become_flags(spark):
    requests = spark.createDataFrame([("t", 0, [], [("h0", 1, 1, "a", ["b"]), ("h1", 3, 3, "c", [])])], REQUEST)
    flags = spark.createDataFrame([("t", 1, 1, "a", 1, 0, 9, "oov", "odd", ["b"], 0.5), ("t", 3, 3, "c", 1, 0, 9, "oov", "odd", [], 0.4)], "transcript_id string, lo bigint, hi bigint, span string, cue_index int, start_us bigint, end_us bigint, detector string, reason string, candidates array<string>, confidence double")
    words = spark.createDataFrame([("t", i, w, 1, i, i + 1) for i, w in enumerate("z a y c, d e".split())], "transcript_id string, global_index bigint, word string, cue_index int, start_us bigint, end_us bigint")
    out = spark.createDataFrame([("t", 0, 1, 1, "h0", "b", 0.9, "r"), ("t", 0, 3, 4, "h1", "x", 0.8, "wide"), ("t", 0, 5, 5, None, None, 0.95, "")], "transcript_id string, chunk_no int, start bigint, end bigint, hint string, replacement string, confidence double, rationale string")
    got = [(r.lo, r.hi, r.span, r.detector, r.reason, r.candidates, r.confidence) for r in V.verdict_flags(out, requests, flags, words).orderBy("lo").collect()]
    assert got == [(1, 1, "a", "oov", "odd", ["b"], 0.5), (3, 4, "c, d", "oov+read_through", "odd; wide", ["x"], 0.8), (5, 5, "e", "read_through", "", [], 0.95)]


def test_messages(spark):
    requests = spark.createDataFrame([("t", 0, [(4, "a"), (5, "b")], [("h0", 4, 4, "a", ["x"])], "before", "", ["K", "L"])], REQUEST + ", before string, after string, priming_terms array<string>")
    r = C.messages(requests, "be kind").first()
    assert r.system == "be kind"
    assert r.user.split("\n") == ["Terms: K, L", "Before: before", "Words: [4]a [5]b", 'Hints: [{"id":"h0","start":4,"end":4,"span":"a","candidates":["x"]}]']
