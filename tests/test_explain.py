from pyspark.sql import functions as F

from murmurlake.functions import phonetic as P
from murmurlake.operators import explain as X
from murmurlake.operators import vocab as V

FLAG = "flag_id bigint, transcript_id string, span string, detector string, candidates array<string>, confidence double, context string, start_us bigint"


def test_sure_needs_a_lead(spark):
    rows = [(1, "t", "kashi", "phonetic_internal", ["kalshi"], 0.7, "", 0), (2, "t", "kashi", "phonetic_internal", ["kalshi", "kalsha"], 0.7, "", 0), (3, "t", "kashi", "oov", ["kalshi"], 0.7, "", 0), (4, "t", "kashi", "phonetic_internal", [], 0.7, "", 0), (5, "t", "kashi", "phonetic_internal", ["kashi!", "xyz"], 0.7, "", 0)]
    got = {r.flag_id: r.sure for r in X.is_sure(spark.createDataFrame(rows, FLAG)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True}


def test_report_and_table(spark):
    rows = [(1, "t", "a|b", "oov", ["x", "y"], 0.5, "see a|b\nnow a|b", 61_000_000)]
    df = spark.createDataFrame(rows, FLAG)
    assert X.report_lines(df).first().line == "[00:01:01,000] see »a|b«\nnow a|b -> x (+1 more)"
    assert X.markdown_rows(df).first().row == "| a\\|b | x | 0.50 | oov | see a\\|b now a\\|b |  |"


def test_every_flag_has_a_line_and_a_row(spark):
    rows = [(1, "t", "b", "oov", [], None, None, None), (2, "t", None, "oov", ["x"], 0.5, "a b", 0), (3, "t", "", "oov", None, 0.5, "a b", 0), (4, "t", None, None, [], None, None, None)]
    df = spark.createDataFrame(rows, FLAG)
    assert {r.flag_id: r.line for r in X.report_lines(df).collect()} == {1: "[--:--:--,---] »b«", 2: "[00:00:00,000] a b -> x", 3: "[00:00:00,000] a b", 4: "[--:--:--,---] "}
    assert {r.flag_id: r.row for r in X.markdown_rows(df).collect()} == {1: "| b |  |  | oov |  |  |", 2: "|  | x | 0.50 | oov | a b |  |", 3: "|  |  | 0.50 | oov | a b |  |", 4: "|  |  |  |  |  |  |"}


def test_table_has_a_row_for_every_flag(spark, tmp_path):
    from murmurlake.plans.explain import markdown_rows

    rows = [(1, "t", "b", "oov", [], None, "a b", 0), (2, "t", "b", "oov", [], 0.5, "a b", 0)]
    spark.createDataFrame(rows, FLAG).write.parquet(f"{tmp_path}/flags.parquet")
    assert sorted(r.flag_id for r in markdown_rows(spark, str(tmp_path)).collect()) == [1, 2]


def test_spend_is_unknown_once_a_cost_is(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 0.5)], "k string, cost_usd double")
    assert {r.k: (r.calls, r.total) for r in X.spend(df, ["k"]).collect()} == {"a": (2, None), "b": (2, 2.5)}


def test_estimate_and_split(spark):
    df = spark.createDataFrame([(["abcd", "abcdefg", ""],)], "m array<string>")
    assert df.select(X.request_tokens(F.col("m"), 320).alias("n")).first().n == 322
    ids = spark.createDataFrame([(f"c{i:02}",) for i in range(20)], "k string")
    a, b = ({r.k: r.part for r in X.seeded_split(ids.repartition(n), "k", 5, 10, 28).collect()} for n in (1, 4))
    assert a == b and sorted(a.values()).count("sample") == 10 and all(a[f"c{i:02}"] == "first" for i in range(5))


def test_related_words_and_cases(spark):
    words = spark.createDataFrame([("t", "kafka", True), ("t", "coughka", True), ("u", "kafka", True)], "transcript_id string, cleaned string, wordlike boolean")
    flags = spark.createDataFrame([(1, "t", "cough ka")], "flag_id bigint, transcript_id string, span string")
    assert X.related(flags, words).first().related == ["kafka"]
    tokens = [("c", "hypothesis", i, w, "") for i, w in enumerate("we run cough ka now and cough ka".split())] + [("c", "reference", i, w, "") for i, w in enumerate("we run Kafka now and cough ka".split())]
    t = spark.createDataFrame(tokens, "call_id string, side string, pos int, token string, punctuation string")
    regions = spark.createDataFrame([("c", 0, 2, 4, 2, 3, "real-word", True), ("c", 1, 0, 1, 0, 1, "drift", False)], "call_id string, region_no int, h_from int, h_to int, r_from int, r_to int, kind string, entity boolean")
    got = [tuple(r) for r in X.cases_from_regions(regions, t).collect()]
    assert got == [("c", 0, "cough ka", "Kafka", "cough ka now", "real-word", True)]


def test_clusters_are_chains_and_suspects_are_doubted(spark):
    schema = "transcript_id string, cleaned string, n bigint, first_gi bigint, display string"
    rows = [("t", "kalshi", 7, 0, "Kalshi"), ("t", "kashi", 3, 1, "Kashi"), ("t", "caushi", 3, 2, "Caushi")]
    got = {r.cleaned: r.canonical for r in V.clusters(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"kalshi": "kalshi", "kashi": "kalshi", "caushi": "kalshi"}
    assert P.jaro_winkler("caushi", "kalshi") < 0.82
    w = [("t", i, "Corsera", "corsera", True) for i in range(3)] + [("t", 9 + i, "Zorvex", "zorvex", True) for i in range(3)] + [("t", 20, "Zorvex", "zorvex", True)] * 3
    words = spark.createDataFrame(w, "transcript_id string, global_index bigint, word string, cleaned string, wordlike boolean")
    freq = spark.createDataFrame([("coursera", 2.0)], "cleaned string, zipf double")
    variants, suspects = V.learned(words, spark.createDataFrame([], "cleaned string, display string"), freq)
    assert [(r.variant, r.counts) for r in variants.collect()] == [("zorvex", 6)]
    assert [(r.variant, r.neighbours) for r in suspects.collect()] == [("corsera", ["Coursera"])]
