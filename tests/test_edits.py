import random

from murmurlake.operators.edits import apply_edits, edits_of, word_edits


def test_edits_rebuild_the_new_words():
    rng = random.Random(2)
    for _ in range(3000):
        old, new = (rng.choice([" ", "", "  "]) + rng.choice([" ", "  ", "\n"]).join(rng.choice("abcd") for _ in range(rng.randint(0, 8))) for _ in range(2))
        edits = word_edits(old, new)
        assert apply_edits(old, edits).split() == new.split(), (old, new, edits)
        assert all(x[1] <= y[0] for x, y in zip(edits, edits[1:]))


def test_edit_rows(spark):
    df = spark.createDataFrame([(1, "use cough ka now", "use Kafka now"), (2, "same", "same"), (3, None, "x")], "cue_id bigint, a string, b string")
    assert [tuple(r) for r in edits_of(df, "cue_id", "a", "b").collect()] == [(1, 0, 4, 12, "Kafka")]
