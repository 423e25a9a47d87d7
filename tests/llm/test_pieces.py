import random

import numpy as np
import pytest

from murmurlake.llm import pieces as P

SCHEMA = "request_id bigint, words array<struct<gi:int,word:string>>, before string, after string, piece_no string"


def greedy(strength, limit, overlap):
    """The rule, read off word by word."""
    n, out, start, end = len(strength), [], 0, -1
    while True:
        if n - start <= limit:
            out.append((start, n - 1))
            return out
        possible = [j for j in range(start, start + limit) if j - start + 1 > overlap and j > end]
        for level in (2, 1):
            good = [j for j in possible if strength[j] == level]
            if good:
                cut = good[-1]
                break
        else:
            cut = start + limit - 1
        out.append((start, cut))
        start, end = cut + 1 - overlap, cut


@pytest.mark.parametrize("seed", range(30))
def test_longest_equals_the_rule(seed):
    rng = random.Random(seed)
    s = np.array([rng.choices([0, 1, 2], [20, rng.choice([0, 1, 3]), rng.choice([0, 1])])[0] for _ in range(rng.randint(0, 400))], dtype=np.int8)
    limit = rng.choice([5, 12, 30])
    overlap = rng.choice([0, 1, limit // 2, limit - 1])
    if len(s) > limit:
        assert P.cut_longest(s, limit, overlap) == greedy(s, limit, overlap)


@pytest.mark.parametrize("seed", range(20))
def test_bisection_covers_all_words_within_the_limit(seed):
    rng = random.Random(seed)
    s = np.array([rng.choice([0, 0, 0, 1, 2]) for _ in range(rng.randint(1, 500))], dtype=np.int8)
    got = P.cut_by_bisection(s, 30, 6)
    assert got[0][0] == 0 and got[-1][1] == len(s) - 1
    for (a, b), (c, d) in zip(got, got[1:]):
        assert c == max(0, b + 1 - 6) and d > b
    assert all(b - a + 1 <= 30 for a, b in got)


def test_boundary_strengths():
    import pyarrow as pa

    words = ["end.", 'end."', "end?)", "so…", "but,", "a;", 'x:”', "mid", None, "", ".)", "'"]
    assert P.strengths(pa.array(words)).tolist() == [2, 2, 2, 2, 1, 1, 1, 0, 0, 0, 2, 0]


def test_nulls_empty_repeated_and_clashing_names(spark):
    long = [(100 + i, "w." if i == 149 else None if i == 3 else "w") for i in range(300)]
    rows = [(1, long, None, "", "x"), (1, long, None, "", "x"), (2, None, "b", "a", "x"), (3, [], "b", "a", "x"), (4, long[:200], "b", "a", "x"), (None, long, "", "", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, P.cut_items(df, "request_id").select("request_id", "piece_no", "first_gi", "last_gi").collect()))
    assert got == [(1, 1, 100, 249), (1, 2, 230, 399)]
    assert P.cut_items(df.limit(0), "request_id").count() == 0
    around = {r.piece_no: (r.before, r.after, len(r.text.split())) for r in P.with_surroundings(P.cut_items(df, "request_id"), df, "request_id", 3).collect()}
    assert around == {1: (None, "w w w", 149), 2: ("w w w", "", 170)}
    with pytest.raises(ValueError):
        P.cut_items(df, "request_id", limit=5, overlap=5)
