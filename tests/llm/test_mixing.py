import random

from murmurlake.llm.mixing import leaf_budgets, mix, share_out


def test_shares():
    assert share_out(10, [(1, 100), (3, 100)]) == [2.5, 7.5]
    assert share_out(10, [(1, 100), (3, 3)]) == [7.0, 3]
    assert share_out(10, [(1, 2), (3, 3)]) == [2, 3]
    assert share_out(10, [(0, 9), (1, 20)]) == [0.0, 10.0]
    assert share_out(0, []) == []


def test_siblings_take_over_before_ancestors():
    leaves = [(("code", "en"), (0.5, 1), 10.0), (("code", "de"), (0.5, 1), 1000.0), (("prose", "en"), (0.5, 1), 1000.0)]
    assert leaf_budgets(leaves, 100) == {("code", "en"): 10.0, ("code", "de"): 40.0, ("prose", "en"): 50.0}
    short = [(("code", "en"), (0.5, 1), 10.0), (("code", "de"), (0.5, 1), 20.0), (("prose", "en"), (0.5, 1), 1000.0)]
    assert leaf_budgets(short, 100) == {("code", "en"): 10.0, ("code", "de"): 20.0, ("prose", "en"): 70.0}


def test_prefix_of_a_seeded_epoch(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("aab"), rng.choice([0, None, 1, 5, 40])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc bigint, source string, size bigint")
    budgets = spark.createDataFrame([("a", 1, 333.0), ("b", 0, 100.0), ("c", 0, 5.0)], "source string, full int, rest double")
    got = mix(df, ["source"], "doc", "size", budgets, seed=7).collect()
    again = mix(df.repartition(7), ["source"], "doc", "size", budgets, seed=7, block_bits=3).collect()
    assert sorted(got) == sorted(again)
    size = lambda s, e: sum(r["size"] or 0 for r in got if r.source == s and r.epoch == e)
    assert sum(1 for r in got if r.source == "a" and r.epoch == 1) == sum(1 for r in rows if r[1] == "a")
    assert abs(size("a", 2) - 333) <= 20 and abs(size("b", 1) - 100) <= 20
    assert len({(r.doc, r.epoch) for r in got}) == len(got)
    assert mix(df.limit(0), ["source"], "doc", "size", budgets, seed=7).count() == 0


def test_whole_mix_reaches_its_budgets(spark):
    from murmurlake.llm.q_mixing import p7_mix, p7_shares

    root = "/root/testdata/sf0.001"
    taken = p7_mix(spark, root).collect()
    caps = {r.source: r.max_repeats for r in spark.read.parquet(f"{root}/mix_targets.parquet").collect()}
    per = {}
    for r in taken:
        per[r.doc_id] = max(per.get(r.doc_id, 0), r.epoch)
        assert r.epoch <= caps[r.source]
    biggest = max(r.tokens for r in taken)
    for r in p7_shares(spark, root).collect():
        langs = max(1, len({t["lang"] for t in taken if t.source == r.source}))
        assert abs(r.taken_tokens - r.budget_tokens) <= langs * biggest / 2 + 1
        assert r.taken_tokens <= r.held_tokens * r.max_repeats


def test_the_plan_fills_up_siblings_first(spark):
    """Water-filling at every level: open siblings have one multiple of their weights, full ones at most that."""
    from collections import defaultdict

    from murmurlake.llm.q_mixing import DOMAINS, TEMPERATURE, p7_leaves

    root = "/root/testdata/sf0.01"
    caps = {r.source: r.max_repeats for r in spark.read.parquet(f"{root}/mix_targets.parquet").collect()}
    domain_of = {lang: d for d, langs in DOMAINS.items() for lang in langs}
    families = defaultdict(list)
    held = defaultdict(float)
    given = defaultdict(float)
    for r in p7_leaves(spark, root).collect():
        d = (r.source, domain_of.get(r.lang, "other"))
        families[d].append((r.held**TEMPERATURE, r.held * caps[r.source], r.budget))
        held[d] += r.held
        given[d] += r.budget
    for (source, domain), tokens in held.items():
        families[source].append((tokens**TEMPERATURE, tokens * caps[source], given[(source, domain)]))
    full = mixed = 0
    for kids in families.values():
        open_ = [b / w for w, limit, b in kids if w and b < limit - 1e-6]
        full += sum(b >= limit - 1e-6 for _, limit, b in kids)
        if open_:
            mixed += len(open_) < len(kids)
            assert max(open_) - min(open_) <= 1e-6 * max(open_)
            assert all(limit / w <= max(open_) * (1 + 1e-6) for w, limit, b in kids if w and b >= limit - 1e-6)
    assert full and mixed  # some leaves were full and their siblings took over
