import pytest
from pyspark.sql import functions as F

from murmurlake.functions import text as T
from murmurlake.functions.phonetic import jaro_winkler, sound_codes
from murmurlake.operators.tokens import words


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize("token,expected", [("Hello,", True), ("API", False), ("APIs", False), ("As", True), ("Its", True), ("2024", False), ("a", False), ("—", False), ("m2", False), ("NASDAQ", True), ("été", True), ("LLMs", False)])
def test_wordlike(spark, token, expected):
    assert one(spark, T.is_wordlike, token) is expected


def test_clean_and_possessive(spark):
    assert one(spark, T.clean, "“Straße”,") == "strasse"
    assert one(spark, T.possessive_base, "openai’s") == "openai"
    assert one(spark, T.possessive_base, "terms") is None


def test_positions_are_code_points_and_lossless(spark):
    text = "  Ünï  b\tc d "
    got = [(r["word"], r["char_offset"]) for r in one(spark, T.positioned, text)]
    assert got == [("Ünï", 2), ("b", 7), ("c", 9), ("d", 11)]
    for w, at in got:
        assert text[at : at + len(w)] == w
    assert one(spark, T.positioned, "") == []
    assert one(spark, T.positioned, None) is None


def test_times(spark):
    assert one(spark, lambda c: T.caption_time(c.cast("bigint")), "3661001500") == "01:01:01,002"
    assert one(spark, T.parse_time, "1:02:03.5") == 3723500000
    assert one(spark, T.parse_time, "02:03,25") == 123250000
    assert one(spark, T.parse_time, "x") is None
    assert one(spark, lambda c: T.player_time(c.cast("bigint"), True), "61000001") == "1:02"
    assert one(spark, lambda c: T.wait_text(c.cast("bigint")), "3660000001") == "1 h 2 min"
    assert one(spark, T.lenient_seconds, " 1.5 ") == 1.5
    assert one(spark, T.lenient_seconds, ".") is None


def test_markup_lists_and_links(spark):
    assert one(spark, T.highlight, "a < b & a < b", "a < b") == "<mark>a &lt; b</mark> &amp; a &lt; b"
    assert one(spark, T.list_terms, " x, ,y\nz ") == ["x", "y", "z"]
    assert one(spark, T.title_phrases, "My Talk | Host - my talk: Part, two") == ["My Talk", "Host", "Part", "two"]
    for link in ("https://www.youtube.com/watch?x=1&v=abcdefghijk&t=3", "https://youtu.be/abcdefghijk?t=1", "youtube.com/shorts/abcdefghijk", "abcdefghijk"):
        assert one(spark, T.video_id, link) == "abcdefghijk"
    assert one(spark, T.video_id, "https://example.org/watch?v=abcdefghijk") is None
    assert one(spark, lambda c: T.watch_link(c, F.lit(2500000)), "abcdefghijk").endswith("&t=1s")
    assert one(spark, T.short_tag, " News_1 ") == "news_1"
    assert one(spark, T.short_tag, "a b") is None
    assert one(spark, T.clamp_confidence, "7") == 1.0
    assert one(spark, T.clamp_confidence, "much") == 0.0
    assert one(spark, T.without_fence, "```json\n[1]\n```") == "[1]"
    assert one(spark, T.is_miscased, "Deepseek", "DeepSeek") is True
    assert one(spark, T.is_miscased, "DEEPSEEK", "DeepSeek") is False
    assert one(spark, lambda c: F.array_join(T.align_words(c), "|"), "Long-term, 'em.") == "long|term|em"


def test_sound_codes_and_similarity(duck):
    anchors = {"coughka": ["KFK"], "kafka": ["KFK"], "caushi": ["KX"], "kalshi": ["KLX"], "smith": ["SM0", "XMT"], "schmidt": ["XMT", "SMT"], "knight": ["NT"], "physics": ["FSKS"]}
    for w, codes in anchors.items():
        assert sound_codes(w) == codes
    assert sound_codes("…") == []
    pairs = [("caushi", "kashi"), ("caushi", "kalshi"), ("kashi", "kalshi"), ("corsera", "coursera"), ("abc", "xyz"), ("aa", "aaaa"), ("martha", "marhta")]
    for a, b in pairs:
        assert abs(jaro_winkler(a, b) - duck.execute(f"SELECT jaro_winkler_similarity('{a}', '{b}')").fetchall()[0][0]) < 1e-12
    assert jaro_winkler("", "x") == 0.0


def test_words_count_each_cue_once(spark):
    rows = [(1, "t", 1, 1, 0, 1, "b c"), (0, "t", 0, 0, 0, 1, "a"), (1, "t", 1, 1, 0, 1, "b c"), (2, "t", 2, 2, 0, 1, None), (3, "t", 3, 3, 0, 1, ""), (4, None, 0, 0, 0, 1, "z")]
    df = spark.createDataFrame(rows, "cue_id bigint, transcript_id string, cue_order int, cue_index int, start_us bigint, end_us bigint, text string")
    got = sorted((r.transcript_id or "", r.global_index, r.word) for r in words(df).collect())
    assert got == [("", 0, "z"), ("t", 0, "a"), ("t", 1, "b"), ("t", 2, "c")]
