import random

import pytest

from murmurlake.operators.intervals import periods_and_gaps, run_bitmaps
from murmurlake.operators.scans import scan_before


def brute(rows):
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    out = []
    for k, v in by.items():
        merged = []
        for s, e in sorted(v):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        out += [(k, "period", s, e) for s, e in merged]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    got = [(r.k, r.kind, r.start_us, r.end_us) for r in periods_and_gaps(df, ["k"], "s", "e", **kw).collect()]
    return sorted(got, key=str)


def test_touching_nested_and_separate(spark):
    rows = [("a", 0, 5), ("a", 5, 7), ("a", 1, 2), ("a", 8, 9), ("a", 8, 9), ("b", 3, 3), ("b", 4, 2), ("c", None, 4), ("c", 1, None), (None, 1, 2), (None, 4, 6)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_random_intervals_over_small_shards(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        s = rng.randint(-300, 3000)
        rows.append((rng.choice(["a", "a", "a", "b", None]), s, s + rng.choice([1, 2, 3, 7, 16, 40, 700])) if rng.random() < 0.9 else ("a", s, s - 1))
    sparse = [r for r in rows if rng.random() < 0.3]
    for some in (rows, sparse, sparse[:25]):
        assert run(spark, some, shard_bits=3) == brute(some)


def test_very_long_interval_covers_many_shards(spark):
    rows = [("a", 0, 1 << 45), ("a", 5, 6), ("a", 1 << 46, (1 << 46) + 1), ("a", -(1 << 40), -(1 << 40) + 3)]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_clashing_names(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([("a", 1, 2, "x", 3)], "kind string, start_us bigint, end_us bigint, runs string, lo int")
    out = periods_and_gaps(df.withColumnRenamed("kind", "shard"), ["shard"], "start_us", "end_us").collect()
    assert [tuple(r) for r in out] == [("a", "period", 1, 2)]


def test_blocked_scan_equals_plain_scan(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 5, 9])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, v int").selectExpr("*", "o div 7 AS b")
    for fold, f in (("max", max), ("sum", sum)):
        got = {r.o: r.out for r in scan_before(df, ["k"], "b", ["o"], "v", "out", fold=fold).collect()}
        for k, o, _ in rows:
            before = [v for kk, oo, v in rows if kk == k and oo < o and v is not None]
            assert got[o] == (f(before) if before else None)


def test_a_hot_transcript_is_spread_over_shards(spark):
    """One transcript has a third of all rows; with the production shards no block of it is more than a small part."""
    rng = random.Random(9)
    hour = 3_600_000_000
    hot = [("hot", s, s + rng.randint(1, 3_000_000)) for s in (rng.randint(0, 3 * hour) for _ in range(2000))]
    rest = [(f"t{i % 80}", s, s + 900_000) for i, s in enumerate(rng.randint(0, hour) for _ in range(4000))]
    df = spark.createDataFrame(hot + rest, "k string, s bigint, e bigint")
    sizes = [r["count"] for r in run_bitmaps(df, ["k"], "s", "e").filter("k = 'hot'").groupBy("shard").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 0.1 * sum(sizes)
    assert run(spark, hot + rest) == brute(hot + rest)
