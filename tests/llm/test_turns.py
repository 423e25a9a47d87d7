import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurlake.llm import boundaries as B
from murmurlake.llm import turns as T

FORMS = ["um", "mm", "umm-hmm", "er"]


@pytest.mark.parametrize("token,word", [("Ummm...", False), ("m", True), ("MM,", False), ("uumm-hmmm", False), ("errr-", False), ("here", True), ("—", False), ("00:01:02.5", False), ("12", True), ("m2", True), ("♪", False), ("", False)])
def test_words(token, word):
    assert T.is_word(token, T.filler_pattern(FORMS)) is word


@pytest.mark.parametrize(
    "text,want",
    [
        ("- LOANE ISTJORO (host): [music] hello", [("loane istjoro", True, False), ("music", False, True)]),
        ("<v Spk 03>um", [("#3", False, False)]),
        ("so. >> L. Istjoro: (applause)", [(None, False, True), ("l. istjoro", True, False), ("applause", False, False)]),
        ("at 10:30 we", [(None, False, True)]),
        ("Remember one thing: the", [("remember one thing", True, True)]),
        ("(he said it, then left)", [("he said it, then left", True, False)]),
        ("Speaker 2: Ｈi", [("#2", True, True)]),
        ("*coughs* [00:01]", [("00:01", False, False)]),
        ("", []),
    ],
)
def test_segments(text, want):
    got = T.segments(text, T.filler_pattern(FORMS))
    assert got == want


def test_turns_from_cues_and_tokens(spark):
    roster = spark.createDataFrame([("t", 1, "Loane Istjoro"), ("t", 2, "Griel Istjoro"), ("c", 1, "Loane Istjoro"), ("c", 2, "Ana Brix"), (None, 1, "x y")], "owner_id string, speaker_no int, display_name string")
    al = T.aliases(roster)
    assert "istjoro" not in {r.key for r in al.filter("owner = 't'").collect()}
    cues = [("t", 0, 0, 1, "before"), ("t", 5, 1, 2, "Loane: um"), ("t", 5, 2, 3, "hello"), ("t", 9, 3, 4, "GRIEL: (sighs) yes. >> Speaker 1: no"), ("t", 1, 9, 5, "late"), ("t", None, 4, 6, "Griel: x"), ("t", 11, 5, 7, None), ("t", 12, 6, 8, "[griel istjoro]"), ("t", 13, 7, 9, "end"), ("u", 1, 1, 10, "Loane: none")]
    df = spark.createDataFrame(cues, "owner string, o1 bigint, o2 bigint, id bigint, text string")
    tokens = [("c", 0, 0, 20, "hi", None), ("c", 1, 0, 21, "um", "Ana"), ("c", 2, 0, 22, "there", "ANA"), ("c", 3, 0, 23, "you", " "), ("c", 4, 0, 24, "[laughs]", "1"), ("c", 5, 0, 25, "two", None), ("c", 6, 0, 26, "three", "Istjoro, Loane:"), ("c", 7, 0, 27, None, "2"), ("c", 8, 0, 28, "four", "S01")]
    tk = spark.createDataFrame(tokens, "owner string, o1 bigint, o2 bigint, id bigint, token string, speaker string")
    out = T.turns(T.cue_marks(df, al, FORMS).unionByName(T.token_marks(tk, al, FORMS)))
    got = sorted((r.turn_of, r.owner_id, r.turn_no, r.speaker_no, r.first_id, r.last_id) for r in out.collect())
    assert got == [("cue", "t", 1, 1, 3, 3), ("cue", "t", 2, 2, 4, 4), ("cue", "t", 3, 1, 4, 4), ("cue", "t", 4, 2, 9, 9), ("token", "c", 1, 2, 22, 25), ("token", "c", 2, 1, 26, 28)]
    empty = T.turns(T.cue_marks(df.limit(0), al, FORMS).unionByName(T.token_marks(tk.limit(0), al, FORMS)))
    assert empty.count() == 0


def test_boosting_learns_and_its_column_agrees(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, len(B.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = B.fit(x[:2000], y[:2000])
    held = model.score(x[2000:])
    assert ((held > 0) == (y[2000:] > 0)).mean() > 0.9
    df = spark.createDataFrame([(*map(float, r),) for r in x[2000:2050]], ", ".join(f"{f} double" for f in B.FEATURES))
    p = [r.probability for r in B.decided(df.withColumn("former_id", F.lit(1)), model).collect()]
    assert np.allclose(p, 1 / (1 + np.exp(-held[:50])))
    assert B.fit(np.empty((0, 7)), np.empty(0)).score(np.zeros((1, 7)))[0] == 0.0


def test_held_out_decisions(spark):
    from murmurlake.llm.q_turns import labelled_pairs

    got = B.held_out_report(labelled_pairs(spark, "/root/testdata/sf0.01")[1])
    assert got["accuracy"] > max(got["base"], 1 - got["base"]) and got["precision"] > 0.6 and got["recall"] > 0.6


def test_decided_turns(spark):
    cues = [("u", 0, 0, 1, 5, "Well then. "), ("u", 10, 1, 2, 15, "um [music]"), ("u", 20, 2, 3, 25, "go on"), ("u", 90, 3, 4, 95, "No."), ("v", 0, 0, 5, 1, "x"), ("v", None, 1, 6, 2, "y"), ("v", 3, 2, 7, None, None), ("u", 90, 3, 4, 95, "No.")]
    df = spark.createDataFrame(cues, "owner string, o1 bigint, o2 bigint, id bigint, ends bigint, text string")
    pairs = B.adjacent(T.cue_features(df, FORMS))
    rows = {r.id: r for r in pairs.collect()}
    assert set(rows) == {1, 3, 4, 5} and rows[3].former_id == 1 and rows[3].former_ends == 1.0 and rows[3].words == 2.0
    model = B.Boosted(base=-1.0, trees=[(0, 3e-5, (0, 1e9, 0.0, 0.0), (0, 1e9, 5.0, 5.0))])  # a gap of over 30 microseconds
    got = sorted((r.owner_id, r.turn_no, r.first_id, r.last_id, r.cues) for r in B.decided_turns(B.decided(pairs, model)).collect())
    assert got == [("u", 1, 1, 3, 2), ("u", 2, 4, 4, 1), ("v", 1, 5, 5, 1)]
    assert B.decided_turns(B.decided(pairs.limit(0), model)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_turns_of_one_owner_over_many_blocks_equal_a_walk(spark, seed):
    """One owner has most of all rows; labels and words fall anywhere in many blocks."""
    import random

    rng = random.Random(seed)
    rows, want = [], []
    for owner, n in (("hot", 400), ("w", 5)):
        held, before, no = None, None, 0
        for i in range(n):
            speaker = rng.choice([None] * 6 + [1, 2])
            spoken = rng.random() < 0.7 or speaker is None
            rows.append(("token", owner, i // 7, i, 0, i, 0, speaker, spoken))
            held = speaker or held
            if spoken and held:
                no += held != before
                before = held
                want.append((owner, i, held, no))
    marks = spark.createDataFrame(rows, "turn_of string, owner string, block int, o1 bigint, o2 bigint, id bigint, seg int, speaker_no int, spoken boolean")
    got = sorted((r.owner, r.id, r.speaker_no, r.turn_no) for r in T.spoken_words(marks).collect())
    assert got == sorted(want)
