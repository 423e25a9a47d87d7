import random

import numpy as np
import pytest

from murmurlake.operators import align as A
from murmurlake.operators import chunks as C
from murmurlake.operators import detect as D
from murmurlake.operators import score as S
from murmurlake.operators import windows as W
from murmurlake.operators.splice import splice, spliced_pieces
from murmurlake.operators.tokens import words

CUES = "cue_id bigint, transcript_id string, cue_order int, cue_index int, start_us bigint, end_us bigint, text string"
FLAGS = "transcript_id string, lo bigint, hi bigint, span string, cue_index int, start_us bigint, end_us bigint, detector string, reason string, candidates array<string>, confidence double"


def cues_of(spark, *texts):
    return spark.createDataFrame([(i, "t", i, i + 1, i * 10, i * 10 + 9, t) for i, t in enumerate(texts)], CUES)


def spliced(spark, texts, *edits):
    cues = cues_of(spark, *texts)
    accepted = spark.createDataFrame([("t", *e) for e in edits], "transcript_id string, lo bigint, hi bigint, replacement string")
    return [r.text for r in splice(cues, words(cues), accepted).orderBy("cue_order").collect()]


def test_splice_keeps_every_other_character(spark):
    assert spliced(spark, ["use  cough ka, and raft"], (1, 2, "Kafka")) == ["use  Kafka, and raft"]
    assert spliced(spark, ["a b c"], (0, 0, "x"), (2, 2, "z")) == ["x b z"]
    assert spliced(spark, ["a b c"], (0, 1, "x"), (1, 2, "y")) == ["x c"]
    assert spliced(spark, ["— b"], (0, 0, "x")) == ["x b"]
    assert spliced(spark, ["gone"], (0, 0, "")) == [""]


def test_splice_over_cues(spark):
    assert spliced(spark, ["the cough", "ka, works"], (1, 2, "Kafka")) == ["the Kafka", ", works"]
    assert spliced(spark, ["the cough", "ka", "next"], (1, 2, "Kafka")) == ["the Kafka", "next"]
    assert spliced(spark, ["the cough", "ka so"], (1, 2, "Kafka")) == ["the Kafka", "so"]


def test_pieces_tell_what_came_from_where(spark):
    cues = cues_of(spark, "the cough", "ka, so", "it ka", "ka", None, "plain")
    accepted = spark.createDataFrame([("t", 1, 2, "Kafka"), ("t", 5, 6, "Raft")], "transcript_id string, lo bigint, hi bigint, replacement string")
    got = {r.cue_id: r for r in spliced_pieces(cues, words(cues), accepted).collect()}
    parts = lambda i: [tuple(p) for p in got[i].pieces or []]
    assert parts(0) == [("the ", None, None, None), ("Kafka", "cough", 1, 2)]
    assert parts(1) == [("", "ka", 1, 2), (", so", None, None, None)] and (got[1].gone, got[1].merged_into) == (False, 0)
    assert parts(2) == [("it ", None, None, None), ("Raft", "ka", 5, 6)] and got[2].merged_into is None
    assert (got[3].gone, got[3].merged_into) == (True, 2) and parts(5) == [("plain", None, None, None)] and got[4].gone is not True
    text = {r.cue_id: r.text for r in splice(cues, words(cues), accepted).collect()}
    assert {i: "".join(p[0] for p in parts(i)) for i in got if not got[i].gone and i != 4} == {i: t for i, t in text.items() if t is not None}


def test_merge_widens_candidates(spark):
    cues = cues_of(spark, "met Nome, Brown today")
    flags = spark.createDataFrame(
        [("t", 1, 1, "Nome", 1, 0, 9, "oov", "odd", ["Noam"], 0.9), ("t", 1, 2, "Nome, Brown", 1, 0, 9, "split_word", "joined", ["Gnome Brown"], 0.8), ("t", 3, 3, "today", 1, 0, 9, "oov", "odd", [], 0.4)], FLAGS
    )
    rows = D.merge(flags, words(cues)).orderBy("lo").collect()
    assert [(r.lo, r.hi, r.span, r.detector, r.reason, r.candidates, r.confidence) for r in rows] == [
        (1, 2, "Nome, Brown", "oov+split_word", "odd; joined", ["Noam, Brown", "Gnome Brown"], 0.95),
        (3, 3, "today", "oov", "odd", [], 0.4),
    ]


def test_detectors_on_a_small_transcript(spark):
    text = ["the word consensus needs coughka again. We use Pytorch and con sensus and kafka.", "Kalshi Kalshi Kalshi Kalshi Kalshi Kalshi Kalshi Kashi"]
    cues = cues_of(spark, *text)
    terms = spark.createDataFrame([("PyTorch",), ("Kafka",), ("Yann LeCun",)], "term string")
    freq = spark.createDataFrame([(w, 5.0) for w in "the word consensus needs again we use and".split()] + [("sensus", 0.5)], "cleaned string, zipf double")
    i = D.inputs(words(cues), terms, freq)
    assert {(r.variant, r.canonical) for r in i.variants.collect()} == {("kalshi", "kalshi")}
    vocab = {r.span: r for r in D.sounds_like_term(i).collect()}
    assert vocab["Pytorch"].candidates == ["PyTorch"] and vocab["Pytorch"].confidence == 0.6
    assert vocab["coughka"].candidates == ["Kafka"] and "kafka" not in vocab
    own = {r.span: r for r in D.sounds_like_own(i).collect()}
    assert own["Kashi"].candidates == ["Kalshi"]
    split = {r.span: r for r in D.split_word(i).collect()}
    assert split["con sensus"].candidates == ["consensus"] and split["con sensus"].confidence == 0.75
    assert "coughka" in {r.span for r in D.out_of_vocabulary(i).collect()}
    found = {r.span: r for r in D.detect(i).collect()}
    assert found["coughka"].detector == "oov+phonetic_internal+phonetic_vocab" and found["coughka"].confidence == 0.98
    assert found["coughka"].context == "the word consensus needs coughka again."


def test_chunk_ends():
    assert C.chunk_ends(0, np.array([]), np.empty((0, 2)), 4) == []
    assert C.chunk_ends(10, np.array([2, 5, 8]), np.empty((0, 2)), 4) == [6, 10]
    assert C.chunk_ends(10, np.array([], dtype=int), np.empty((0, 2)), 4) == [8, 10]
    assert C.chunk_ends(10, np.array([3, 6]), np.array([[2, 5]]), 4) == [7, 10]


@pytest.mark.parametrize("seed", range(5))
def test_chunk_ends_equal_a_plain_walk(seed):
    rng = random.Random(seed)
    n, size = 200, 7
    close = sorted(rng.sample(range(n), 30))
    hints = []
    at = 0
    while at < n - 4:
        at += rng.randint(1, 20)
        hints.append((at, min(n - 1, at + rng.randint(0, 6))))
        at = hints[-1][1] + 1
    want, lo = [], 0
    while lo < n:
        hi = lo
        while True:
            hi += 1
            if hi >= n:
                break
            if any(a <= hi - 1 < b for a, b in hints):
                continue
            if hi - lo >= 2 * size or (hi - lo >= size and hi - 1 in close):
                break
        want.append(hi)
        lo = hi
    assert C.chunk_ends(n, np.array(close), np.array([h for h in hints if h[1] < n]), size) == want


def test_regions_and_kinds(spark):
    said = {"hypothesis": ["we", "long-term", "cough", "ka", "<noise>", "now", "on"], "reference": ["we", "long-turm", "Kafka", None, "now"]}
    tokens = spark.createDataFrame([("c", s, i, t, ["ORG"] if t == "Kafka" else []) for s, ts in said.items() for i, t in enumerate(ts)], "call_id string, side string, pos int, token string, entity_types array<string>")
    got = [tuple(r) for r in A.align_calls(tokens).orderBy("region_no").collect()]
    assert got == [("c", 0, 1, 4, 1, 3, ["term", "cough", "ka"], ["turm", "kafka"], ["ORG"]), ("c", 1, 5, 6, 0, 0, ["on"], [], [])]
    assert A.align_calls(tokens.limit(0)).count() == 0
    rows = [("c", 0, 0, 0, 0, 1, [], ["x"]), ("c", 1, 0, 1, 0, 1, ["um"], []), ("c", 2, 0, 9, 0, 9, list("abcdefg"), []), ("c", 3, 0, 1, 0, 1, ["5"], ["five"]), ("c", 4, 0, 1, 0, 1, ["the"], ["a"]), ("c", 5, 0, 1, 0, 1, ["zorq"], ["work"]), ("c", 6, 0, 1, 0, 1, ["walk"], ["work"]), ("c", 7, 0, 2, 0, 1, ["in", "side"], ["inside"])]
    rows = [(*r, []) for r in rows] + [("c", 8, 0, 1, 0, 1, ["may"], ["main"], ["DATE"]), ("c", 9, 0, 1, 0, 1, ["walk"], ["wok"], ["ORG"])]
    df = spark.createDataFrame(rows, "call_id string, region_no int, h_from int, h_to int, r_from int, r_to int, h_forms array<string>, r_forms array<string>, entities array<string>")
    known = spark.createDataFrame([("walk",), ("work",)], "cleaned string")
    got = A.classified(df, spark.createDataFrame([("um",)], "form string"), known).collect()
    kinds = {r.region_no: r.kind for r in got}
    assert {r.region_no for r in got if r.entity} == {9}
    assert kinds == {0: "deletion", 1: "filler", 2: "drift", 3: "format", 4: "function-word", 5: "non-word", 6: "real-word", 7: "format", 8: "format", 9: "real-word"}


def plain_cues(tokens, max_chars=42, max_us=7_000_000):
    """Cues by one walk over (text, speaker, begin, finish), as the rules say."""
    groups = []
    for t in tokens:
        g = groups[-1] if groups else None
        if g and t[1] == g[-1][1] and not g[-1][0].endswith((".", "!", "?")) and len(" ".join(x[0] for x in [*g, t])) <= max_chars and t[3] - g[0][2] <= max_us:
            g.append(t)
        else:
            groups.append([t])
    out, before = [], -10_000
    for k, g in enumerate(groups, 1):
        start = max(g[0][2], before + 10_000)
        out.append((k, start, max(g[-1][3], start + 10_000), " ".join(x[0] for x in g)))
        before = start
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cues_equal_a_plain_walk_over_many_blocks(spark, seed):
    """A call that holds most of all rows is cut in blocks of 32 tokens; no sentence end bounds its runs."""
    rng = random.Random(seed)
    rows, want, no = [], [], 0
    for call, n in (("long", 700), ("one", 1), ("short", 40)):
        at, tokens = 0, []
        for i in range(n):
            at += rng.choice([0, 100_000, 400_000, 3_000_000])
            text = "x" * rng.randint(1, 9) + ("." if seed and rng.random() < 0.05 else "")
            tokens.append((text, rng.choice("ab") if rng.random() < 0.1 else "a", at, at + rng.randint(0, 500_000)))
            rows.append((no, call, "hypothesis", i, text, tokens[-1][1], f"{at / 1e6:.6f}", f"{tokens[-1][3] / 1e6:.6f}", None))
            no += 1
        want += [(call, *c) for c in plain_cues(tokens)]
    df = spark.createDataFrame(rows, "token_id bigint, call_id string, side string, pos int, token string, speaker string, ts string, endts string, punctuation string")
    got = A.cues_from_tokens(df.repartition(3), block_bits=5)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert A.cues_from_tokens(df.limit(0)).count() == 0


def test_cues_without_times(spark):
    rows = [("c", i, t, s, a, e) for i, (t, s, a, e) in enumerate([("a", "1", "0", "0.4"), ("b.", "1", "0.5", "0.9"), ("c", "1", None, "bad"), ("d", None, "1", None), ("e", None, None, "0.5")])]
    df = spark.createDataFrame([(*r, "hypothesis", None) for r in rows], "call_id string, pos int, token string, speaker string, ts string, endts string, side string, punctuation string")
    got = [tuple(r)[1:] for r in A.cues_from_tokens(df).orderBy("cue_index").collect()]
    assert got == [(1, 0, 900_000, "a b."), (2, 10_000, 20_000, "c"), (3, 1_000_000, 1_010_000, "d e")]


@pytest.mark.parametrize("seed", range(30))
def test_shortest_unique_window_equals_a_search(seed):
    rng = random.Random(seed)
    tokens = [rng.choice("abc") for _ in range(rng.randint(1, 25))]
    start = rng.randrange(len(tokens))
    end = rng.randint(start + 1, min(len(tokens), start + 3))

    def count(x):
        return sum(tokens[i : i + len(x)] == x for i in range(len(tokens) - len(x) + 1))

    span = tokens[start:end]
    windows = [(hi - lo, start - lo, lo, hi) for lo in range(start + 1) for hi in range(end, len(tokens) + 1)]
    fit = [(lo, hi) for _, left, lo, hi in sorted(windows) if count(tokens[lo:hi]) == 1 and not any(tokens[i : i + len(span)] == span for i in range(lo, start))]
    assert A.shortest_unique(A.unique_lengths(tokens), tokens, start, end) == (fit[0] if fit else (0, len(tokens)))


@pytest.mark.parametrize("seed", range(20))
def test_alignment_costs_no_more_than_a_full_table(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 20))] for _ in range(2))
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    table[:, 0], table[0] = range(len(a) + 1), range(len(b) + 1)
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1, j + 1] = min(table[i, j] + (a[i] != b[j]), table[i, j + 1] + 1, table[i + 1, j] + 1)
    gaps = A.gaps_of(a, b)
    assert sum(max(h1 - h0, r1 - r0) for h0, h1, r0, r1 in gaps) == table[-1, -1]


def test_scores_have_defaults(spark):
    cases = spark.createDataFrame([], "case_id string, transcript_id string, verdict string, candidate string, kind string")
    occ = spark.createDataFrame([], "case_id string, transcript_id string, lo bigint, hi bigint")
    flags = spark.createDataFrame([], "flag_id bigint, transcript_id string, lo bigint, hi bigint, detector string, candidates array<string>")
    r = S.report(S.case_hits(cases, occ, flags), flags, spark.createDataFrame([], "transcript_id string, gi bigint")).first()
    assert (r.recall, r.specificity, r.cold_rate, r.flag_precision) == (1.0, 1.0, 0.0, None)


def test_scores(spark):
    cases = spark.createDataFrame([("1", "t", "should-flag", "Kafka", "non-word"), ("2", "t", "should-flag", None, "real-word"), ("3", "t", "should-not-flag", None, None)], "case_id string, transcript_id string, verdict string, candidate string, kind string")
    occ = spark.createDataFrame([("1", "t", 1, 2), ("2", "t", 9, 9), ("3", "t", 4, 4)], "case_id string, transcript_id string, lo bigint, hi bigint")
    flags = spark.createDataFrame([(1, "t", 2, 3, "oov", []), (2, "t", 4, 4, "oov+split_word", ["x"])], "flag_id bigint, transcript_id string, lo bigint, hi bigint, detector string, candidates array<string>")
    hits = S.case_hits(cases, occ, flags)
    assert {r.case_id: (r.touched, r.proposed) for r in hits.collect()} == {"1": (True, False), "2": (False, False), "3": (True, True)}
    err = spark.createDataFrame([("t", 1), ("t", 2), ("t", 9)], "transcript_id string, gi bigint")
    r = S.report(hits, flags, err, match_candidates=False).first()
    assert (r.tp, r.fn, r.tn, r.fp, r.flags, r.cold, r.touching) == (1, 1, 0, 1, 2, 1, 1)


def test_cases_are_found_within_their_context(spark):
    text = "cough ka we run cough — ka now cough ka and cough ka again cough ka and cough ka".split()
    words = spark.createDataFrame([("t", i, "" if w == "—" else w) for i, w in enumerate(text)], "transcript_id string, global_index bigint, cleaned string")
    rows = [("all", "cough ka", None), ("first", "cough ka", "cough ka and cough ka"), ("marked", "ka", "Cough — ka now"), ("outside", "run", "cough ka and"), ("nowhere", "cough ka", "cough ka or"), ("other", "zorvex", None)]
    cases = spark.createDataFrame([(c, "t", p, x) for c, p, x in rows], "case_id string, transcript_id string, phrase string, context string")
    occ = S.locate(cases, words)
    assert occ.columns == ["transcript_id", "case_id", "phrase", "context", "lo", "hi"]
    got = sorted((r.case_id, r.lo, r.hi) for r in occ.collect())
    assert got == [("all", 0, 1), *[("all", i, i + 1) for i in (8, 11, 14, 17)], ("first", 8, 9), ("first", 14, 15), ("marked", 6, 6)]
    S.require_found(cases.filter("case_id IN ('all', 'first', 'marked')"), occ)
    with pytest.raises(ValueError, match="nowhere.*other.*outside"):
        S.require_found(cases, occ)


def test_entities_are_tallied(spark):
    hits = [("should-flag", True, True, True), ("should-flag", True, False, True), ("should-flag", False, False, True), ("should-flag", True, True, False), ("should-not-flag", True, True, True)]
    hits = spark.createDataFrame(hits, "verdict string, touched boolean, proposed boolean, entity boolean")
    flags = spark.createDataFrame([], "flag_id bigint, transcript_id string, lo bigint, hi bigint, detector string, candidates array<string>")
    err = spark.createDataFrame([], "transcript_id string, gi bigint")
    for match, caught in ((False, 2), (True, 1)):
        r = S.report(hits, flags, err, match_candidates=match).first()
        assert (r.entity_caught, r.entity_cases) == (caught, 3)
    r = S.report(hits.filter("NOT entity"), flags, err).first()
    assert (r.entity_caught, r.entity_cases) == (None, None)


def test_waits(spark):
    day, h = 86_400_000_000, 3_600_000_000
    df = spark.createDataFrame([("s", 0, 6000), ("s", 2 * h, 4000), ("s", -day, 999)], "k string, at bigint, v bigint")
    now = 3 * h
    assert W.wait_until_fits(df, "k", "at", "v", day, now, 12000, 3000).first().wait_us == 21 * h
    assert W.wait_until_fits(df, "k", "at", "v", day, now, 12000, 9000).first().wait_us == 23 * h
    assert W.wait_until_fits(df, "k", "at", "v", day, now, 12000, 12001).first().wait_us is None
    assert W.wait_until_fits(df, "k", "at", "v", day, now, 12000, 2000).first().wait_us == 0
    r = W.next_return(df, "k", "at", "v", day, now).first()
    assert (r.gives, r.wait_us) == (6000, 21 * h)
