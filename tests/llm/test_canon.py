import pytest

from murmurlake.llm.canon import UNSTABLE, canonical, lookalike_classes, lookalike_pairs, with_canonical

SAME = ["Sulhölél 7", "Sulhölél 7", "Ｓｕｌｈöｌéｌ ７", "Ѕulһölél 7", "Sul​hö­lél　7", "﻿Sulhölél\t7 "]


def test_same_look_same_form():
    assert {canonical(t).strip() for t in SAME} == {"Sulhölél 7"}
    assert canonical("oﬃce‑ﬂoor") == "office-floor"
    assert canonical("e​́") == "é"
    assert canonical("KÅ") == "KÅ"


@pytest.mark.parametrize("a,b", [("Case", "case"), ("Sulholel", "Sulhölél"), ("m2", "m²"), ("it's", "it’s"), ("a\nb", "a b"), ("a b", "a  b"), ("a–b", "a-b"), ("I", "l")])
def test_visible_differences_stay(a, b):
    assert canonical(a) != canonical(b)


def test_forms_do_not_change_again():
    for t in [*SAME, "é漢字\r\nх", "́x", "", "ẛ̣", "각"]:
        once = canonical(t)
        assert canonical(once) == once


def test_pairs_equal_brute_force(spark):
    texts = [*SAME, SAME[0], "sulhölél 7", "", None, "​", " ", "x" * 50_000, "x" * 49_999 + "ｘ"]
    rows = [(i, s, t, "z") for s in ("t", "u", None) for i, t in enumerate(texts, 100 * (1 + ["t", "u", None].index(s)))]
    df = spark.createDataFrame(rows, "id bigint, scope string, text string, id_a string")
    got = sorted((r.scope or "", r.id_a, r.id_b) for r in lookalike_pairs(df, ["scope"], "id", "text").collect())
    want = sorted(
        (s or "", i, j) for i, s, t, _ in rows for j, s2, u, _ in rows if i < j and s == s2 and t and u and t != u and canonical(t).strip(" \n") == canonical(u).strip(" \n")
    )
    assert got == want and got
    assert lookalike_pairs(df.limit(0), ["scope"], "id", "text").count() == 0


def test_form_column(spark):
    df = spark.createDataFrame([("a b ", "k"), (None, "k"), ("plain", "k")], "text string, __x string")
    assert [r.form for r in with_canonical(df, "text", "form").collect()] == ["a b", None, "plain"]


def test_stable_text_of_any_script_needs_no_work(spark):
    stable = ["café Grüße", "日本語 한국어", "plain", "x² “q” — …", ""]
    work = ["cafe\u0301", "x\u00a0y", "о", "a\u200bb", "ｘ", "\u1100\u1161", "가\u11a8", "\u2126", "tab\t", "𝐀", "Ⅰ", "Ꭺ", "\r"]
    df = spark.createDataFrame([(t, t in work) for t in stable + work], "t string, w boolean")
    assert df.filter(df.t.rlike(UNSTABLE) != df.w).count() == 0
    assert [canonical(t) for t in stable] == stable
    assert [canonical(t) for t in ("𝐀", "Ⅰ", "Ꭺ", "가\u11a8")] == ["A", "I", "A", "각"]


def test_splicing_equals_normalising_the_whole_text():
    import random
    import unicodedata

    from murmurlake.llm.canon import _segment

    rng = random.Random(2)
    letters = "aeo é漢가\u1100\u1161\u11a8\u0301\u0327\u0345x\u200bоｘﬁ\r\n\u00a0Ω\u09c7\u09be𝐀"
    for _ in range(5000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))
        assert canonical(t) == unicodedata.normalize("NFC", _segment(t)), ascii(t)


def test_classes_tell_the_same_as_pairs(spark):
    texts = [*SAME, SAME[0], "other", None, "", "оther"]
    df = spark.createDataFrame([(i, s, t) for s in ("t", None) for i, t in enumerate(texts, 0 if s else 50)], "id bigint, scope string, text string")
    pairs = lookalike_pairs(df, ["scope"], "id", "text").collect()
    got = {r.id: (r.class_id, r.links) for r in lookalike_classes(df, ["scope"], "id", "text").collect()}
    ends = [x for p in pairs for x in (p.id_a, p.id_b)]
    assert {i: n for i, (_, n) in got.items()} == {i: ends.count(i) for i in set(ends)}
    assert {i: c for i, (c, _) in got.items()} == {i: min(j for j in ends if canonical(texts[j % 50]).strip() == canonical(texts[i % 50]).strip() and j // 50 == i // 50) for i in got}
