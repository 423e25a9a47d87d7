import random

import pytest

from murmurlake.llm import encode as E

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(E.DEFAULT_VOCABULARY), reason="no vocabulary")
ALPHABETS = ["ab \n", "aaaaaaaaaaaaaaaaaaaaaaa \n\t", "é漢字a   ", "ab1 !\n'tre", "aaaa", "=-_*# \n", " \n\t\x1c\x85　a", "abcdefghij"]


def texts(rng, k):
    for _ in range(k):
        al = rng.choice(ALPHABETS)
        yield "".join(rng.choice(al) * rng.choice([1, 1, 2, 9, 60]) for _ in range(rng.randint(0, 30)))


def test_tree_equals_one_go():
    coder = E.PieceEncoder(E.DEFAULT_VOCABULARY, leaf_chars=16)
    for t in texts(random.Random(1), 4000):
        assert coder.encode(t) == coder.encoding.encode_ordinary(t)


def test_table(spark):
    rng = random.Random(2)
    rows = [(i, t, "k") for i, t in enumerate([None, "", " ", "<|endoftext|>", "x" * 30_000, "漢" * 9_000, *texts(rng, 60)])]
    rows.append(rows[4])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, part string")
    got = [(r.doc_id, r.part, r.ids) for r in E.encode_texts(df, "text", ["doc_id", "part"], leaf_chars=64, spread_chars=200).collect()]
    plain = E.PieceEncoder(E.DEFAULT_VOCABULARY).encoding
    want = [(i, p, plain.encode_ordinary(t or "")) for i, t, p in rows]
    assert sorted(got) == sorted(want)
    sizes = E.encode_texts(df, "text", ["doc_id"], out="n", counts_only=True, spread_chars=200)
    assert sorted((r.doc_id, r.n) for r in sizes.collect()) == sorted((i, len(x)) for i, _, x in want)
    assert E.encode_texts(df.limit(0), "text", ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        E.encode_texts(df, "text", ["doc_id"], out="doc_id")
