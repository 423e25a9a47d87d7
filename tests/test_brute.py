"""Queries beyond SQL against plain walks over the same data, one transcript or call at a time.

The walks share only the text functions with the library (word positions, clean forms, fitness and
frequencies are checked by SQL) and the sound codes and similarity, which have published anchors in
tests/test_text.py. Everything the operators do with them is done anew here, the plain way.
"""

from collections import Counter, defaultdict

import pytest

from murmurlake.functions import phonetic as P
from murmurlake.functions import text as T
from murmurlake.operators import tokens as O
from murmurlake.operators import vocab as V
from murmurlake.plans import registry
from murmurlake.sources.tables import table

from .conftest import DATA
from .helpers import plain

QUERIES = registry.queries()
BRUTE = ("oov_flags", "sounds_like_term_flags", "sounds_like_own_flags", "split_word_flags", "detected_flags", "learned_terms", "term_codes", "related_words", "aligned_regions", "region_kinds", "call_cases")


def codes(word):
    return set(P.sound_codes(word))


def similar(a, b):
    return P.jaro_winkler(a, b)


class World:
    """Words of every transcript with what the detectors look at, the terms, frequencies and learned spellings."""

    def __init__(self, spark):
        from pyspark.sql import functions as F

        w = O.name_like(O.with_clean(O.words(table(spark, DATA, "cues"))))
        freq = O.frequencies(O.with_clean(O.words(table(spark, DATA, "cues"))))
        self.zipf = {r.cleaned: r.zipf for r in freq.collect()}
        base = {r.cleaned: r.base for r in w.select("cleaned", T.possessive_base(F.col("cleaned")).alias("base")).distinct().collect()}
        trimmed = {r.word: r.t for r in w.select("word", T.trim_edges(F.col("word")).alias("t")).distinct().collect()}
        self.words = defaultdict(list)
        for r in sorted(w.collect(), key=lambda r: (str(r.transcript_id), r.global_index)):
            self.words[r.transcript_id].append({**r.asDict(), "zipf": self.zipf.get(r.cleaned, 0.0), "stop": r.cleaned in T.STOPWORDS, "base": base[r.cleaned], "trimmed": trimmed[r.word]})
        terms = defaultdict(set)
        self.sounding = []
        for r in table(spark, DATA, "transcripts").select(F.explode(T.list_terms(F.col("priming_terms"))).alias("t")).distinct().collect():
            shown = r.t.strip(T.SPAN_EDGE)
            parts = [p for p in (x.strip(T.EDGE).lower().replace("ß", "ss") for x in shown.split()) if p]
            if parts:
                if len(parts) == 1:
                    terms[parts[0]].add(shown)
                else:
                    self.sounding.append((shown, "".join(parts), parts))
        self.terms = {k: min(v) for k, v in terms.items()}
        self.sounding += [(v, k, [k]) for k, v in self.terms.items()]
        self.variants, self.suspects = {}, {}
        for t, ws in self.words.items():
            self.variants[t], self.suspects[t] = self.learn(ws)

    def learn(self, ws):
        fit = [w for w in ws if w["wordlike"] and len(w["cleaned"]) >= 3 and not w["stop"] and w["cleaned"] not in self.terms and self.zipf.get(w["cleaned"], 0) < V.KNOWN_ZIPF]
        n = Counter(w["cleaned"] for w in fit)
        first = {}
        for w in fit:
            first.setdefault(w["cleaned"], w)
        owner = {}
        for c in sorted((c for c in n if n[c] >= 3), key=lambda c: (-n[c], first[c]["global_index"])):
            owner[c] = next((owner[s] for s in owner if similar(c, s) >= 0.82), c)
        total = Counter()
        for c, o in owner.items():
            total[o] += n[c]
        suspects = {}
        for o in total:
            if total[o] < V.TRUST_COUNT and o not in self.zipf:
                near = sorted(((-similar(o, k), k) for k, z in self.zipf.items() if z >= V.NEIGHBOUR_ZIPF and k != o and codes(k) & codes(o) and similar(o, k) >= V.NEIGHBOUR_SIMILARITY))[:3]
                if near:
                    shown = first[o]["trimmed"] or first[o]["word"]
                    suspects[o] = [k[:1].upper() + k[1:] if shown[0].isupper() else k for _, k in near]
        variants = {c: (o, first[c]["trimmed"] or first[c]["word"], total[o] if c == o else n[c], c == o) for c, o in owner.items() if o not in suspects}
        return variants, {c: suspects[o] for c, o in owner.items() if o in suspects}

    def oov(self):
        for t, ws in self.words.items():
            known = set(self.terms) | {c for c, v in self.variants[t].items() if v[3]}
            for w in ws:
                if w["wordlike"] and not w["stop"] and len(w["cleaned"]) >= 3 and w["zipf"] <= 0 and w["cleaned"] not in known and w["base"] not in known:
                    owned = [f"{self.terms[k]}'s" for k in self.terms if k + "s" == w["cleaned"]]
                    yield t, w["global_index"], w["global_index"], tuple(self.suspects[t].get(w["cleaned"]) or owned), 0.9

    def term_flags(self):
        for t, ws in self.words.items():
            for w in ws:
                if not w["wordlike"]:
                    continue
                shown = self.terms.get(w["cleaned"])
                if shown is not None:
                    caps = lambda x: x == x.upper() != x.lower()
                    if shown[1:] != shown[1:].lower() and not caps(shown) and w["trimmed"] != shown and not caps(w["trimmed"]):
                        yield t, w["global_index"], w["global_index"], (shown,), 0.6
                elif not w["stop"] and w["zipf"] < V.KNOWN_ZIPF:
                    hits = sorted((-similar(w["cleaned"], k), term) for term, k, parts in self.sounding if len(parts) == 1 and codes(k) & codes(w["cleaned"]))
                    if hits:
                        yield t, w["global_index"], w["global_index"], tuple(x for _, x in hits), round(min(0.95, 0.6 - 0.35 * hits[0][0]), 3)

    def own_flags(self):
        for t, ws in self.words.items():
            variants = self.variants[t]
            taught = {c for c, v in variants.items() if v[3]}
            surfaces = {w["cleaned"]: w for w in ws if w["wordlike"] and not w["stop"] and len(w["cleaned"]) >= 3}
            named = {c for c in surfaces if c in self.terms or c in taught}
            good = named | {c for c in surfaces if self.zipf.get(c, 0) >= V.KNOWN_ZIPF}
            known = sorted(variants, key=lambda c: (-variants[c][2], c))
            near = {}
            for c in set(surfaces) - good:
                best = max(((similar(c, v), -k) for k, v in enumerate(known)), default=(0, 0))
                if best[0] >= 0.82:
                    near[c] = variants[variants[known[-best[1]]][0]][1]
            for w in ws:
                c = w["cleaned"]
                if c not in surfaces or c in good or not w["wordlike"] or w["stop"]:
                    continue
                if c in near:
                    yield t, w["global_index"], w["global_index"], (near[c],), 0.7
                    continue
                for code in sorted(codes(c)):
                    hits = sorted((-similar(c, g), g) for g in good if code in codes(g) and (g in named or not w["name_like"]))
                    if hits:
                        yield t, w["global_index"], w["global_index"], tuple(g for _, g in hits), 0.7
                        break

    def split_flags(self):
        for t, ws in self.words.items():
            by_cue = defaultdict(list)
            for w in ws:
                by_cue[w["cue_id"]].append(w)
            for cue in by_cue.values():
                taken = set()
                for size in (2, 3):
                    for i in range(len(cue) - size + 1):
                        win = cue[i : i + size]
                        if not all(w["wordlike"] and not w["stop"] and w["cleaned"] and (len(w["cleaned"]) <= 5 or w["zipf"] < 3) for w in win) or all(w["zipf"] >= 4.5 for w in win):
                            continue
                        parts = [w["cleaned"] for w in win]
                        run = "".join(parts)
                        if len(run) <= 3 or taken & {w["global_index"] for w in win}:
                            continue
                        known = {p for p in parts if p in self.terms}
                        hits = sorted({(-similar(run, k), term) for term, k, tp in self.sounding if k != run and codes(k) & codes(run) and " ".join(tp) not in parts and known <= set(tp)})
                        common = self.zipf.get(run, 0) >= 3 and any(w["zipf"] < V.KNOWN_ZIPF for w in win)
                        if hits or common:
                            taken |= {w["global_index"] for w in win}
                            yield t, win[0]["global_index"], win[-1]["global_index"], tuple(x for _, x in hits) or (run,), 0.82 if hits else 0.75


@pytest.fixture(scope="module")
def world(spark):
    return World(spark)


def found(df):
    return Counter((r.transcript_id, r.lo, r.hi, tuple(r.candidates), plain(r.confidence)) for r in df.collect())


def test_out_of_vocabulary(spark, world):
    got = Counter((r.transcript_id, r.lo, r.lo, tuple(c for c in r.candidates.split("|") if c), r.confidence) for r in QUERIES["oov_flags"](spark, DATA).collect())
    assert got == Counter(world.oov()) and got


@pytest.mark.parametrize("name,walk", [("sounds_like_term_flags", World.term_flags), ("sounds_like_own_flags", World.own_flags), ("split_word_flags", World.split_flags)])
def test_sounding_detectors(spark, world, name, walk):
    want = Counter((*f[:4], plain(f[4])) for f in walk(world))
    assert found(QUERIES[name](spark, DATA)) == want


def test_detected_flags_cover_all_findings(spark, world):
    """Every finding of a detector lies in one merged flag, with its detectors, and nothing else is flagged."""
    names = {"oov": world.oov(), "phonetic_vocab": world.term_flags(), "phonetic_internal": world.own_flags(), "split_word": world.split_flags()}
    spots = sorted(((t, lo, hi, n, c) for n, flags in names.items() for t, lo, hi, _, c in flags), key=str)
    by = defaultdict(list)
    for s in spots:
        by[s[0]].append(s[1:])
    want = Counter()
    for t, flags in by.items():
        group = []
        for lo, hi, n, c in [*sorted(flags), (1 << 60, 0, "", 0)]:
            if group and lo > max(h for _, h, _, _ in group):
                kinds = sorted({n for _, _, n, _ in group})
                top = max(c for *_, c in group)
                want[(t, group[0][0], max(h for _, h, _, _ in group), "+".join(kinds), plain(top if len(group) == 1 else min(0.98, top + 0.05 * (len(kinds) - 1))))] += 1
                group = []
            group.append((lo, hi, n, c))
    got = Counter((r.transcript_id, r.lo, r.hi, r.detector, plain(r.confidence)) for r in QUERIES["detected_flags"](spark, DATA).collect())
    assert {k[:4] for k in got} == {k[:4] for k in want}
    assert sum(abs(a[4] - b[4]) > 1e-3 for a, b in zip(sorted(got, key=str), sorted(want, key=str))) == 0


def test_learned_terms(spark, world):
    got = {(r.transcript_id, r.variant, r.canonical, r.display, r.counts, r.is_canonical) for r in QUERIES["learned_terms"](spark, DATA).collect()}
    assert got == {(t, c, *v) for t, vs in world.variants.items() for c, v in vs.items()} and got


def test_term_codes(spark):
    terms = {r.canonical for r in table(spark, DATA, "doc_vocab").filter("canonical IS NOT NULL").collect()}
    got = {(r.canonical, r.code) for r in QUERIES["term_codes"](spark, DATA).collect()}
    assert got == {(t, c) for t in terms for c in codes(t)}


def test_related_words(spark, world):
    flags = {r.flag_id: r for r in table(spark, DATA, "flags").collect()}
    want = {}
    for i, f in flags.items():
        own = "".join(c for c in (f.span or "").lower() if c.isalpha() or c.isdecimal())
        near = sorted({w["cleaned"] for w in world.words[f.transcript_id] if w["wordlike"] and w["cleaned"] != own and codes(w["cleaned"]) & codes(own)}) if own else []
        if near:
            want[i] = near[:3]
    assert {r.flag_id: r.related for r in QUERIES["related_words"](spark, DATA).collect()} == want


def test_regions_kinds_and_cases(spark):
    """On sf0.01, as the smallest tables have no reference side."""
    root = DATA.replace("0.001", "0.01")
    regions = QUERIES["aligned_regions"](spark, root).collect()
    tokens = defaultdict(dict)
    for r in table(spark, root, "nlp_tokens").filter("token IS NOT NULL").collect():
        if r.token and not (r.token.startswith("<") and r.token.endswith(">")) and set(r.token) != {"*"}:
            tokens[(r.call_id, r.side)][(r.pos, r.token_id)] = r.token
    assert {c for c, s in tokens if s == "reference"} >= {r.call_id for r in regions} and regions
    kept = Counter()
    for r in regions:
        # outside its regions a call's two sides are the same
        kept[r.call_id] += 1
    for call in kept:
        mine = sorted((r for r in regions if r.call_id == call), key=lambda r: r.region_no)
        assert [r.region_no for r in mine] == list(range(len(mine)))
        sides = []
        for s, a, b in (("hypothesis", "h_from", "h_to"), ("reference", "r_from", "r_to")):
            every = [tokens[(call, s)][k] for k in sorted(tokens[(call, s)])]
            cut = {i for r in mine for i in range(r[a], r[b])}
            sides.append(every_form(spark, [t for i, t in enumerate(every) if i not in cut]))
        assert sides[0] == sides[1]
    kinds = Counter((r.call_id, r.kind) for r in regions)
    assert {(r.call_id, r.kind): r.regions for r in QUERIES["region_kinds"](spark, root).collect()} == kinds
    cases = {(r.call_id, r.region_no): r for r in QUERIES["call_cases"](spark, root).collect()}
    assert set(cases) == {(r.call_id, r.region_no) for r in regions if r.kind in ("format", "function-word", "non-word", "real-word")}
    for (call, no), c in cases.items():
        assert c.span in c.context


def every_form(spark, tokens):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(tokens)), "i int, t string")
    return [f for r in df.select("i", T.align_words(F.col("t")).alias("f")).orderBy("i").collect() for f in r.f]
