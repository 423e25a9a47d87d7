import random

from pyspark.sql import functions as F

from murmurlake.llm.terms import TermCounts, marked, whole_term, words_of
from murmurlake.session import scratch_table

SCHEMA = "field string, owner string, term string, n bigint, sign int"


def brute(rows):
    occ, rec = {}, {}
    for f, o, t, n, s in rows:
        if t is None:
            continue
        occ[(f, o, t)] = occ.get((f, o, t), 0) + (n or 0) * s
        rec[(f, o, t)] = rec.get((f, o, t), 0) + s
    out = {}
    for (f, o, t), k in rec.items():
        if k > 0:
            a, b = out.get((f, t), (0, 0))
            out[(f, t)] = (a + occ[(f, o, t)], b + (o is not None))
    return out


def counts(state):
    return {(r.field, r.term): (r.total, r.owners) for r in state.counts().collect()}


def test_deltas_equal_counting_anew(spark):
    rng = random.Random(3)
    live, log = [], []
    state = TermCounts(spark, scratch_table(spark, "test-terms"), buckets=4, max_levels=3)
    for _ in range(4):
        gone = rng.sample(live, len(live) // 3)
        for g in gone:
            live.remove(g)
        new = [(rng.choice("fg"), rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", "z", "", None]), rng.choice([0, 1, 2, None])) for _ in range(20)]
        live += new
        change = [(*g, -1) for g in gone] + [(*n, 1) for n in new]
        log += change
        state.apply(spark.createDataFrame(change, SCHEMA))
        assert counts(state) == brute(log) == brute([(*r, 1) for r in live])
        held = {(f, o) for f, o, t, _ in live if t is not None and o is not None}
        assert {r.field: r.records for r in state.records().collect()} == {f: sum(g == f for g, _ in held) for f in {f for f, *_ in log}}
    assert len(state.levels) == 2  # summed up once on the way


def test_empty_first_load(spark):
    state = TermCounts(spark, scratch_table(spark, "test-empty")).apply(spark.createDataFrame([], SCHEMA))
    assert state.counts().count() == 0
    assert marked(state.counts(), state.records()).count() == 0


def test_marks_and_ties(spark):
    rows = [("f", o, t, n, 1) for o, t, n in [("a", "one", 1), ("a", "two", 3), ("b", "two", 1), ("b", "half", 2), ("b", "zero", None)]]
    state = TermCounts(spark, scratch_table(spark, "test-marks")).apply(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r.term, r.mark) for r in marked(state.counts(), state.records()).collect())
    assert got == [("half", "rare"), ("one", "rare"), ("two", "common"), ("zero", "rare")]


def test_terms_of_a_text(spark):
    text = " “Größe” a … (b-c)　'x'  "
    assert spark.range(1).select(words_of(F.lit(text)).alias("t")).first().t == ["größe", "a", "b-c", "x"]
    assert spark.range(1).select(whole_term(F.lit("  “A  B!” ")).alias("t")).first().t == "a  b"
    assert spark.range(1).select(whole_term(F.lit(" … ")).alias("t")).first().t is None
    assert spark.range(1).select(words_of(F.lit("")).alias("t")).first().t == []


def size_of(path):
    import os

    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path.removeprefix("file://").removeprefix("file:")) for f in fs)


def test_what_is_written_follows_the_change_set(spark):
    state = TermCounts(spark, scratch_table(spark, "test-size"), buckets=4)
    state.apply(spark.range(200_000).selectExpr("'f' AS field", "CAST(id % 1000 AS STRING) AS owner", "CAST(id AS STRING) AS term", "1L AS n", "1 AS sign"))
    state.apply(spark.createDataFrame([("f", "1", "1", 1, -1), ("f", "new", "1", 1, 1)], SCHEMA))
    first, second = (size_of(f"{state.path}/level={n}") for n in state.levels)
    assert second < first / 50, (first, second)
    assert {(r.term, r.total, r.owners) for r in state.counts().filter("term IN ('1', '2')").collect()} == {("1", 1, 1), ("2", 1, 1)}
    assert state.records().first().records == 1001
    assert state.compact().levels == [3] and state.counts().count() == 200_000 and state.records().first().records == 1001
