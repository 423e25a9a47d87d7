import random

from murmurlake.llm.spam import curves, digest, find_spam, line_kind, scan_pages, scored

PROSE = ["The {a} must not be {b} here", "Keeps the {a} until it is {b}", "See the {b} {a} for details", "Returns the {a}, or nothing when it is {b}"]
NOUNS, ADJ = [f"n{c}un" for c in "abcdefghij"], ["old", "thin", "green", "warm", "late"]
SHOP, BRAND = ["buy", "cheap", "sale", "best", "coupon", "deal"], ["zorvelik", "holnorel", "tavimor"]


def pages():
    rng = random.Random(1)
    sentence = lambda: rng.choice(PROSE).format(a=rng.choice(NOUNS), b=rng.choice(ADJ))
    link = lambda: f"https://{rng.choice(BRAND)}.example/{rng.choice(NOUNS)}?id={rng.randint(1, 999)}"
    phrase = lambda: f"{rng.choice(SHOP)} {rng.choice(SHOP)} {rng.choice(BRAND)}"
    good = [". ".join(sentence() for _ in range(rng.randint(3, 30))) + "." for _ in range(120)]
    good += ["\n".join(f"{i}: {s}" for i in range(60)) for s in (sentence() for _ in range(5))]
    good += ["\n".join(f"assert {rng.choice(NOUNS)}({i}) == {i}" for i in range(50)), "\n".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))]
    good += ["\n".join(f"* [{rng.choice(NOUNS)}]({link()}) - {sentence()}. {sentence()}" for _ in range(20))]
    good += ["sku,name,price,note\n" + "\n".join(f'{i},{rng.choice(NOUNS)},{i}.99,"{sentence()}."' for i in range(30))]
    bad = ["\n".join(phrase() for _ in range(60)), ", ".join(phrase() for _ in range(80)), "\n".join(link() for _ in range(30)), "\n".join(f"[{phrase()}]({link()})" for _ in range(30))]
    bad += ["\n".join(f"- tag: {rng.choice(SHOP)}-{rng.choice(BRAND)}" for _ in range(60)), "/*\n" + "\n".join(" ".join(phrase() for _ in range(4)) for _ in range(30)) + "\n*/\nint x = 1;", f"{sentence()}.\n\n" + "\n".join(f"{rng.choice(BRAND)} thin L/4{i % 9} {i}.99 >> {rng.choice(SHOP)} <<" for i in range(40))]
    return good, bad


def test_spam_is_found_and_only_spam(spark):
    good, bad = pages()
    rows = [(i, t, "text", 0) for i, t in enumerate(good + bad)] + [(9000, None, "text", 0), (9001, "", None, 0), (9002, "\n \n", None, 0), (None, bad[0], "text", 0), (len(good), bad[0], "text", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, tokens int")
    assert sorted(r.doc_id for r in find_spam(df).collect()) == list(range(len(good), len(good) + len(bad)))
    assert find_spam(df.limit(0)).count() == 0


def test_curve_of_a_known_page(spark):
    df = spark.createDataFrame([(1, "a a a a b b c c"), (2, "x y z")], "doc_id bigint, text string").selectExpr("*", "'t' AS lang")
    got = {r.doc_id: r for r in curves(scan_pages(df, "doc_id", "text", "lang")).collect()}
    assert got[2].slope == 0.0 and got[2].residual == 0.0
    assert abs(got[1].slope + 0.756) < 0.01  # ln 4, ln 2, ln 2 over ln 1, ln 2.5, ln 2.5


def test_lines():
    assert line_kind("23) brand https://a.test/x")[0] == "link"
    assert line_kind("- Works on a steady channel only ([#157](https://a.test/x))")[0] == "other"
    assert line_kind("x >> y <<")[0] == "tag"
    assert line_kind("if (a == b) {")[0] == "other"
    assert line_kind("# buy cheap zorvelik") == ("words", ["buy", "cheap", "zorvelik"])
    assert digest("", set()) is None


def test_long_varied_product_and_tag_lines_are_spam(spark):
    """No word occurs three times, no link, and one mark per long line: only the lines show what these are."""
    words = iter(f"{a}{b}{c}en" for a in "bdfgk" for b in "aeiou" for c in "lmnrst")
    some = lambda n: [next(words) for _ in range(n)]
    product = "\n".join("{0}ium {1}ling {2}stone S/31 129.99 >> {3} {4} {5}ware <<".format(*some(6)) for _ in range(8))
    tags = "\n".join("Tags: " + ", ".join(some(9)) for _ in range(8))
    good, _ = pages()
    rows = [(i, t, "text") for i, t in enumerate([*good, product, tags])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in find_spam(df).collect()) == [len(good), len(good) + 1]


def test_single_lines_of_tags_and_short_keywords_are_spam(spark):
    """Pages that a look at counts of words, links and marks alone would pass by."""
    names = [f"{a}{b}{c}" for a in "bdfgklmnprstvz" for b in "aeiou" for c in "lmnrst"]
    one = "Tags: " + ", ".join(names[:80])
    four = "\n".join("Tags: " + ", ".join(names[i : i + 20]) for i in range(80, 160, 20))
    short = "\n".join(" ".join(f"{a} {b} zu" for a, b in zip(names[i : i + 4], names[i + 1 : i + 5])) for i in range(160, 180)) + "\n" + "\n".join(" ".join(names[160 + (i * 7 + j * 3) % 12] for j in range(9)) for i in range(40))
    good, bad = pages()
    rows = [(i, t, "text") for i, t in enumerate([*good, *bad, one, four, short])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in find_spam(df).collect()) == list(range(len(good), len(good) + len(bad) + 3))


def test_a_page_copied_all_over_stays_spam(spark):
    """A third of all rows are copies of one spam page; they vouch for nothing."""
    good, bad = pages()
    rows = [(i, t, "text") for i, t in enumerate(good + [bad[0]] * (len(good) // 2))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in find_spam(df).collect()) == list(range(len(good), len(rows)))


def test_score_alone_finds_all_spam_and_less_than_half_of_the_rest(spark):
    from murmurlake.sources.tables import table

    got = scored(scan_pages(table(spark, "/root/testdata/sf0.01", "documents"), "doc_id", "text", "lang")).select("is_extreme", "share").toPandas()
    spam = got["share"].fillna(0) > 0.5
    assert got["is_extreme"][spam].all() and got["is_extreme"][~spam].mean() < 0.5
