"""Queries over chunk plans, verdicts, splices, alignment, scores and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.operators import align as A
from murmurlake.operators import chunks as C
from murmurlake.operators import score as S
from murmurlake.operators import tokens as O
from murmurlake.operators import verdicts as V
from murmurlake.operators import windows as W
from murmurlake.operators.detect import islands
from murmurlake.operators.records import once
from murmurlake.operators.scans import scan_before
from murmurlake.operators.splice import span_edits, splice, spliced_pieces
from murmurlake.plans import tokens as q
from murmurlake.session import materialise
from murmurlake.sources.tables import table

DAY_US = 86_400_000_000
#: Fixed "now" of the queries that need one.
AS_OF = "2024-12-01 00:00:00"


def _words(spark: SparkSession, root: str) -> DataFrame:
    return materialise(O.with_clean(O.words(table(spark, root, "cues"))))


def _flags(spark: SparkSession, root: str) -> DataFrame:
    f = q.flag_spans(table(spark, root, "flags"))
    return f.withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))


def _hints(spark: SparkSession, root: str) -> DataFrame:
    """One flag for every island of overlapping ones: the first."""
    rows = islands(_flags(spark, root))
    first = rows.groupBy("transcript_id", "island").agg(F.min(F.struct("lo", "hi", "flag_id", "span", "candidates")).alias("f"))
    return materialise(first.select("transcript_id", "f.lo", "f.hi", "f.span", "f.candidates"))


def accepted_edits(spark: SparkSession, root: str) -> DataFrame:
    """The character ranges that the first candidates of the stored flags would write."""
    return span_edits(_accepted(spark, root), _words(spark, root), table(spark, root, "cues"))


def _accepted(spark: SparkSession, root: str) -> DataFrame:
    f = _flags(spark, root).filter(F.size("candidates") > 0)
    return f.select("transcript_id", "lo", "hi", F.col("candidates")[0].alias("replacement"))


def spliced_cues(spark: SparkSession, root: str) -> DataFrame:
    """Every cue with the first candidates of the stored flags written in."""
    return splice(table(spark, root, "cues"), _words(spark, root), _accepted(spark, root)).select("cue_id", "text")


def splice_origins(spark: SparkSession, root: str) -> DataFrame:
    """Every written piece with what it replaces, and the cues whose words went into another one."""
    out = spliced_pieces(table(spark, root, "cues"), _words(spark, root), _accepted(spark, root))
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return out.select("cue_id", "gone", "merged_into", F.filter("pieces", lambda p: p["original"].isNotNull()).alias("written"), text.alias("text")).select(
        "cue_id", "gone", "merged_into", F.array_join(F.transform("written", lambda p: F.concat(p["original"], F.lit(" -> "), p["text"])), "; ").alias("written"), "text"
    )


def chunk_plan(spark: SparkSession, root: str) -> DataFrame:
    return C.plan_chunks(_words(spark, root), _hints(spark, root))


def chunk_texts(spark: SparkSession, root: str) -> DataFrame:
    w, h = _words(spark, root), _hints(spark, root)
    r = C.numbered_words(C.chunk_requests(w, C.plan_chunks(w, h), h))
    return r.select("transcript_id", "chunk_no", "before", "after", "numbered", F.size("hints").alias("hints"))


def stub_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """Chunks judged by the stub, one verdict for each word."""
    w, h = _words(spark, root), _hints(spark, root)
    requests = materialise(C.chunk_requests(w, C.plan_chunks(w, h), h))
    return V.resolve_verdicts(V.judge_chunks(requests).verdicts, requests).select("transcript_id", "start", "end", "replacement", "confidence", "judged")


def _tokens(spark: SparkSession, root: str) -> DataFrame:
    return once(table(spark, root, "nlp_tokens"), "token_id")


def aligned_regions(spark: SparkSession, root: str) -> DataFrame:
    """Where hypothesis and reference of a call differ, and what kind of difference it is."""
    t = _tokens(spark, root)
    known = O.frequencies(O.with_clean(O.words(table(spark, root, "cues"))))
    return A.classified(A.align_calls(t), table(spark, root, "fillers").filter("form IS NOT NULL"), known)


def region_kinds(spark: SparkSession, root: str) -> DataFrame:
    return aligned_regions(spark, root).groupBy("call_id", "kind").agg(F.count("*").alias("regions"))


def token_cues(spark: SparkSession, root: str) -> DataFrame:
    return A.cues_from_tokens(_tokens(spark, root))


def _cases(spark: SparkSession, root: str) -> DataFrame:
    """Learned spellings as labelled cases: variants should be flagged, canonical spellings should not."""
    v = table(spark, root, "doc_vocab").filter("variant IS NOT NULL AND canonical IS NOT NULL AND is_canonical IS NOT NULL")
    v = v.select("transcript_id", "variant", "canonical", "is_canonical").distinct()
    return v.select(
        "transcript_id", F.col("variant").alias("phrase"), F.concat_ws("|", "transcript_id", "variant", "canonical").alias("case_id"),
        F.when(F.col("is_canonical"), "should-not-flag").otherwise("should-flag").alias("verdict"), F.when(~F.col("is_canonical"), F.col("canonical")).alias("candidate"),
        F.when(F.contains("variant", F.lit(" ")), "phrase").otherwise("word").alias("kind"),
    )


def located_terms(spark: SparkSession, root: str) -> DataFrame:
    return S.locate(_cases(spark, root), _words(spark, root)).select("case_id", "transcript_id", "lo", "hi")


def _scored(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cases = _cases(spark, root)
    occ = materialise(S.locate(cases, _words(spark, root)))
    flags = _flags(spark, root)
    hits = S.case_hits(cases, occ, flags)
    errors = occ.filter("verdict = 'should-flag'").select("transcript_id", F.explode(F.sequence("lo", "hi")).alias("gi"))
    return hits, flags, errors


def score_report(spark: SparkSession, root: str) -> DataFrame:
    return S.report(*_scored(spark, root), match_candidates=False)


def recall_by_kind(spark: SparkSession, root: str) -> DataFrame:
    return S.by_kind(_scored(spark, root)[0])


def _events(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("cents", F.floor(F.col("value") * 100).cast("bigint"))


def rolling_day(spark: SparkSession, root: str) -> DataFrame:
    """Per event what its user spent in the 24 hours up to it."""
    return W.rolling_sum(_events(spark, root), "user_id", "at_us", "cents", DAY_US, "used").select("event_id", "used")


def next_returns(spark: SparkSession, root: str) -> DataFrame:
    now = _events(spark, root).agg(F.max("at_us")).collect()[0][0]
    return W.next_return(_events(spark, root), "user_id", "at_us", "cents", DAY_US, now)


def day_counts(spark: SparkSession, root: str) -> DataFrame:
    return W.day_events(table(spark, root, "events"), "ts", "event_type")


def detail_counts(spark: SparkSession, root: str) -> DataFrame:
    return W.detail_counts(table(spark, root, "transcripts"), "format")


def idle_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions without activity for a day, as of a fixed moment."""
    return W.idle(table(spark, root, "transcripts"), "session_id", "last_activity", DAY_US, AS_OF).select("session_id", F.unix_micros("last").alias("last_us"))


def session_list(spark: SparkSession, root: str) -> DataFrame:
    """Transcripts of every session, the newest first."""
    t = once(table(spark, root, "transcripts"), "transcript_id")
    # a session may hold a large part of all rows: numbered block by block of time, the newest first
    age = F.coalesce(-F.unix_micros(F.col("created_at").cast("timestamp")), F.lit((1 << 62)))
    rows = materialise(t.select("session_id", "transcript_id", age.alias("age"), F.shiftright(age, 36).alias("block"), F.lit(1).cast("bigint").alias("one")))
    placed = scan_before(rows, ["session_id"], "block", ["age", "transcript_id"], "one", "n", fold="sum")
    return placed.select("session_id", "transcript_id", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("place"))


_CASES = """
cases AS (SELECT DISTINCT transcript_id, variant AS phrase, concat_ws('|', transcript_id, variant, canonical) AS case_id,
    CASE WHEN is_canonical THEN 'should-not-flag' ELSE 'should-flag' END AS verdict, CASE WHEN NOT is_canonical THEN canonical END AS candidate,
    CASE WHEN contains(variant, ' ') THEN 'phrase' ELSE 'word' END AS kind
  FROM doc_vocab WHERE variant IS NOT NULL AND canonical IS NOT NULL AND is_canonical IS NOT NULL)
"""
_OCC = (
    q.WORDS_SQL
    + f""", cw AS (SELECT transcript_id, global_index, {q.CLEAN} AS cleaned FROM w), {_CASES},
p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(trim(phrase), '\\s+'), lambda x: {q.CLEAN.replace('word', 'x')}), lambda x: x <> '') AS ps FROM cases),
e AS (SELECT case_id, transcript_id, len(ps) AS n, unnest(ps) AS cleaned, generate_subscripts(ps, 1) - 1 AS o FROM p),
occ AS (SELECT e.case_id, e.transcript_id, global_index - o AS lo, global_index - o + n - 1 AS hi
  FROM e JOIN cw ON cw.transcript_id = e.transcript_id AND cw.cleaned = e.cleaned
  GROUP BY e.case_id, e.transcript_id, global_index - o, n HAVING count(*) = n)
"""
)
_HITS = (
    _OCC
    + """, f AS (SELECT DISTINCT ON (flag_id) *, list_min(global_indices) AS lo, list_max(global_indices) AS hi FROM flags WHERE len(global_indices) > 0),
m AS (SELECT occ.case_id, f.flag_id, f.candidates FROM occ JOIN f ON f.transcript_id = occ.transcript_id AND f.lo <= occ.hi AND occ.lo <= f.hi),
h AS (SELECT cases.case_id, verdict, kind, count(m.flag_id) > 0 AS touched,
      coalesce(bool_or(m.flag_id IS NOT NULL AND (candidate IS NULL OR len(list_filter(coalesce(m.candidates, []), lambda c: contains(lower(c), lower(candidate)))) > 0)), false) AS proposed
      FROM cases LEFT JOIN m USING (case_id) GROUP BY cases.case_id, verdict, kind)
"""
)
_SPAN_EDGE = "'" + q._EDGE + "' || ' ' || chr(9) || chr(10)"
_EDITS = (
    q.WORDS_SQL.replace("WITH c AS", "WITH RECURSIVE c AS")
    + f""", f AS (SELECT DISTINCT transcript_id, list_min(global_indices) AS lo, list_max(global_indices) AS hi, candidates[1] AS replacement
        FROM (SELECT DISTINCT ON (flag_id) * FROM flags) WHERE len(global_indices) > 0 AND len(candidates) > 0),
    o AS (SELECT transcript_id, lo, hi, replacement, cue_id, cue_order, min(char_offset) AS a, max(char_offset + length(word)) AS b
        FROM f JOIN w USING (transcript_id) WHERE global_index BETWEEN lo AND hi GROUP BY ALL),
    x AS (SELECT *, min(cue_order) OVER k AS c0, max(cue_order) OVER k AS c1 FROM o WINDOW k AS (PARTITION BY transcript_id, lo, hi, replacement)),
    y AS (SELECT x.*, substr(text, a + 1, b - a) AS raw, left(text, b) AS upto FROM x JOIN c USING (cue_id)),
    z AS (SELECT *, length(raw) - length(ltrim(raw, {_SPAN_EDGE})) AS lead, length(raw) - length(rtrim(raw, {_SPAN_EDGE})) AS trail,
        length(rtrim(upto, {_SPAN_EDGE})) AS bare_end FROM y),
    edits AS (SELECT cue_id, (CASE WHEN c0 = c1 THEN CASE WHEN lead + trail >= length(raw) THEN a ELSE a + lead END WHEN cue_order = c0 THEN a + lead ELSE 0 END)::INT AS start,
        (CASE WHEN c0 = c1 THEN CASE WHEN lead + trail >= length(raw) THEN b ELSE b - trail END WHEN cue_order <> c0 AND cue_order = c1 THEN bare_end ELSE b END)::INT AS end,
        CASE WHEN cue_order = c0 THEN replacement ELSE '' END AS written, lo::BIGINT AS lo, hi::BIGINT AS hi, cue_order <> c0 AS cut FROM z)
"""
)
_T = r"""t AS (SELECT call_id, token || coalesce(punctuation, '') AS text, coalesce(speaker, chr(0)) AS who, pos, {s} AS s, {e} AS e,
      FROM (SELECT DISTINCT ON (token_id) * FROM nlp_tokens) WHERE side = 'hypothesis' AND token IS NOT NULL AND NOT regexp_matches(token, '^(<[^>]*>|\*+)?$'))""".format(
    **{k: rf"CASE WHEN regexp_matches({c}, '^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$') THEN round(TRY_CAST(trim({c}) AS DOUBLE) * 1000000)::BIGINT END" for k, c in (("s", "ts"), ("e", "endts"))}
)
QUERIES = {
    "accepted_edits": accepted_edits,
    "spliced_cues": spliced_cues,
    "splice_origins": splice_origins,
    "chunk_plan": chunk_plan,
    "chunk_texts": chunk_texts,
    "stub_verdicts": stub_verdicts,
    "aligned_regions": aligned_regions,
    "region_kinds": region_kinds,
    "token_cues": token_cues,
    "located_terms": located_terms,
    "score_report": score_report,
    "recall_by_kind": recall_by_kind,
    "rolling_day": rolling_day,
    "next_returns": next_returns,
    "day_counts": day_counts,
    "detail_counts": detail_counts,
    "idle_sessions": idle_sessions,
    "session_list": session_list,
}
ORACLES = {
    "accepted_edits": _EDITS + "SELECT * FROM edits",
    "spliced_cues": _EDITS
    + rf""", nn AS (SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY start, lo, hi, "end", written) AS k FROM edits),
    r AS (SELECT cue_id, 0::BIGINT AS k, 0 AS done_to, '' AS done FROM (SELECT DISTINCT cue_id FROM edits)
      UNION ALL
      SELECT r.cue_id, nn.k, CASE WHEN nn.start < done_to THEN done_to ELSE nn."end" END,
        CASE WHEN nn.start < done_to THEN done ELSE done || substr(c.text, done_to + 1, nn.start - done_to) || nn.written END
      FROM r JOIN nn ON nn.cue_id = r.cue_id AND nn.k = r.k + 1 JOIN c ON c.cue_id = r.cue_id),
    ll AS (SELECT cue_id, arg_max(done_to, k) AS done_to, arg_max(done, k) AS done FROM r GROUP BY cue_id),
    gg AS (SELECT cue_id, bool_or(cut) AS cut FROM edits GROUP BY cue_id),
    uu AS (SELECT a.cue_id, coalesce(cut, false) AS cut, CASE WHEN ll.cue_id IS NULL THEN a.text
        WHEN cut THEN regexp_replace(done || substr(a.text, done_to + 1), '^[{q._BL}]+', '') ELSE done || substr(a.text, done_to + 1) END AS text
      FROM (SELECT DISTINCT ON (cue_id) * FROM cues) a LEFT JOIN ll USING (cue_id) LEFT JOIN gg USING (cue_id))
    SELECT cue_id, text FROM uu WHERE NOT (cut AND text = '')""",
    "token_cues": f"""WITH RECURSIVE {_T},
    o AS (SELECT *, coalesce(s, e, 0) AS b, coalesce(e, s, 0) AS f, row_number() OVER (PARTITION BY call_id ORDER BY pos, text) AS n FROM t),
    r AS (SELECT call_id, n, 1 AS k, b AS first, length(text) AS width, text, who, b, f FROM o WHERE n = 1
      UNION ALL
      SELECT call_id, n, CASE WHEN new THEN k + 1 ELSE k END, CASE WHEN new THEN b ELSE first END, CASE WHEN new THEN length(text) ELSE width + 1 + length(text) END, text, who, b, f
      FROM (SELECT o.*, r.k, r.first, r.width, o.who <> r.who OR regexp_matches(r.text, '[.!?]$') OR r.width + 1 + length(o.text) > 42 OR o.f - r.first > 7000000 AS new
            FROM r JOIN o ON o.call_id = r.call_id AND o.n = r.n + 1)),
    g AS (SELECT call_id, k, arg_min(b, n) AS b, arg_max(f, n) AS f, string_agg(text, ' ' ORDER BY n) AS text FROM r GROUP BY call_id, k),
    h AS (SELECT *, 10000 * k + greatest(-10000, max(b - 10000 * k) OVER (PARTITION BY call_id ORDER BY k)) AS start_us FROM g)
    SELECT call_id, k AS cue_index, start_us::BIGINT AS start_us, greatest(f, start_us + 10000)::BIGINT AS end_us, text FROM h""",
    "located_terms": _OCC + "SELECT case_id, transcript_id, lo, hi FROM occ",
    "recall_by_kind": _HITS + "SELECT kind, count_if(touched) AS touched, count_if(proposed) AS proposed, count(*) AS cases FROM h WHERE verdict = 'should-flag' GROUP BY kind",
    "score_report": _HITS
    + """, cc AS (SELECT count_if(verdict = 'should-flag' AND touched) AS tp, count_if(verdict = 'should-flag' AND NOT touched) AS fn,
        count_if(verdict = 'should-not-flag' AND NOT touched) AS tn, count_if(verdict = 'should-not-flag' AND touched) AS fp FROM h),
    gg AS (SELECT count(*) AS flags, count_if(list_contains(string_split(detector, '+'), 'oov') AND len(coalesce(candidates, [])) = 0) AS cold,
        count_if(flag_id IN (SELECT flag_id FROM m JOIN cases USING (case_id) WHERE verdict = 'should-flag')) AS touching FROM f)
    SELECT CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN tn + fp = 0 THEN 1.0 ELSE tn / (tn + fp) END AS specificity,
      cold / flags AS cold_rate, touching / flags AS flag_precision, tp, fn, tn, fp, flags, cold, touching FROM cc, gg""",
    "chunk_plan": q.WORDS_SQL.replace("WITH c AS", "WITH RECURSIVE c AS")
    + """, f AS (SELECT DISTINCT ON (flag_id) flag_id, transcript_id, list_min(global_indices) AS lo, list_max(global_indices) AS hi FROM flags WHERE len(global_indices) > 0),
    m AS (SELECT *, max(hi) OVER (PARTITION BY transcript_id ORDER BY lo, hi, flag_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
    h AS (SELECT * FROM m WHERE reach IS NULL OR lo > reach),
    x AS (SELECT w.transcript_id, w.global_index AS gi, regexp_matches(w.word, '[.!?]$') AS closes,
            EXISTS (SELECT 1 FROM h WHERE h.transcript_id = w.transcript_id AND h.lo <= w.global_index AND w.global_index < h.hi) AS held FROM w),
    p AS (SELECT transcript_id, max(gi) AS top, list(gi ORDER BY gi) FILTER (NOT held) AS free, coalesce(list(gi ORDER BY gi) FILTER (closes AND NOT held), []) AS ends FROM x GROUP BY transcript_id),
    r AS (SELECT transcript_id, -1 AS chunk_no, 0::BIGINT AS lo, -1::BIGINT AS hi FROM p
      UNION ALL
      SELECT r.transcript_id, chunk_no + 1, r.hi + 1, coalesce(least(list_min(list_filter(ends, lambda e: e >= r.hi + 400)), list_min(list_filter(free, lambda e: e >= r.hi + 800))), top)
      FROM r JOIN p USING (transcript_id) WHERE r.hi < top)
    SELECT transcript_id, chunk_no, lo, hi FROM r WHERE chunk_no >= 0""",
    "rolling_day": """WITH e AS (SELECT *, epoch_us(ts) AS at_us, floor(value * 100)::BIGINT AS cents FROM events)
      SELECT event_id, (sum(coalesce(cents, 0)) OVER (PARTITION BY user_id ORDER BY at_us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW))::BIGINT AS used FROM e""",
    "next_returns": """WITH e AS (SELECT user_id, epoch_us(ts) AS at_us, floor(value * 100)::BIGINT AS cents FROM events),
      n AS (SELECT max(at_us) AS now FROM e), r AS (SELECT e.*, now FROM e, n WHERE at_us > now - 86400000000 AND cents > 0),
      o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_us, cents) AS k FROM r)
      SELECT user_id, cents AS gives, at_us + 86400000000 - now AS wait_us FROM o WHERE k = 1""",
    "day_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "detail_counts": "SELECT coalesce(format, '(none)') AS detail, count(*) AS n FROM transcripts GROUP BY 1",
    "idle_sessions": f"""WITH s AS (SELECT session_id, max(epoch_us(last_activity)) AS last_us FROM transcripts GROUP BY session_id)
      SELECT * FROM s WHERE last_us IS NOT NULL AND epoch_us(TIMESTAMP '{AS_OF}') - last_us >= 86400000000""",
    "session_list": """WITH t AS (SELECT DISTINCT ON (transcript_id) * FROM transcripts)
      SELECT session_id, transcript_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC NULLS LAST, transcript_id) AS place FROM t""",
}

_PLAN = ORACLES["chunk_plan"].rsplit("SELECT", 1)[0] + ", plan AS (SELECT transcript_id, chunk_no, lo, hi FROM r WHERE chunk_no >= 0)"
ORACLES["chunk_texts"] = (
    _PLAN
    + """, b AS (SELECT plan.transcript_id, chunk_no, string_agg(word, ' ' ORDER BY global_index) FILTER (global_index < lo) AS before,
        string_agg(word, ' ' ORDER BY global_index) FILTER (global_index > hi) AS after,
        string_agg('[' || global_index || ']' || word, ' ' ORDER BY global_index) FILTER (global_index BETWEEN lo AND hi) AS numbered
      FROM plan JOIN w ON w.transcript_id = plan.transcript_id AND global_index BETWEEN lo - 40 AND hi + 40 GROUP BY ALL),
    n AS (SELECT plan.transcript_id, chunk_no, count(h.flag_id)::INT AS hints FROM plan LEFT JOIN h ON h.transcript_id = plan.transcript_id AND h.lo BETWEEN plan.lo AND plan.hi GROUP BY ALL)
    SELECT transcript_id, chunk_no, coalesce(before, '') AS before, coalesce(after, '') AS after, numbered, hints FROM b JOIN n USING (transcript_id, chunk_no)"""
)
_SAID = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
ORACLES["stub_verdicts"] = (
    _PLAN
    + f""", v AS (SELECT h.transcript_id, h.lo, h.hi, any_value(g.candidates[1]) AS text, string_agg(word, ' ' ORDER BY global_index) AS stands
      FROM h JOIN (SELECT DISTINCT ON (flag_id) * FROM flags) g USING (flag_id) JOIN plan ON plan.transcript_id = h.transcript_id AND h.lo BETWEEN plan.lo AND plan.hi
      JOIN w ON w.transcript_id = h.transcript_id AND global_index BETWEEN h.lo AND least(h.hi, plan.hi) GROUP BY ALL)
    SELECT transcript_id, lo::BIGINT AS start, hi::BIGINT AS "end", CASE WHEN {_SAID.format('text')} <> {_SAID.format('stands')} THEN text END AS replacement, 0.9::DOUBLE AS confidence, true AS judged FROM v"""
)

ORACLES["splice_origins"] = (
    ORACLES["spliced_cues"]
    .replace("'' AS done FROM", "'' AS done, '' AS log FROM")
    .replace("|| nn.written END\n", """|| nn.written END, CASE WHEN nn.start < done_to THEN log
          ELSE log || CASE WHEN log = '' THEN '' ELSE '; ' END || substr(c.text, nn.start + 1, nn."end" - nn.start) || ' -> ' || nn.written END\n""")
    .replace("arg_max(done, k) AS done FROM", "arg_max(done, k) AS done, arg_max(log, k) AS log FROM")
    .replace("uu AS (SELECT a.cue_id,", "uu AS (SELECT a.cue_id, coalesce(log, '') AS written,")
    .rsplit("SELECT cue_id, text", 1)[0]
    + """, ii AS (SELECT e.cue_id, min(o.cue_id) AS merged_into FROM edits e JOIN edits o ON e.lo = o.lo AND e.hi = o.hi AND e.cut AND NOT o.cut
      JOIN c ec ON ec.cue_id = e.cue_id JOIN c oc ON oc.cue_id = o.cue_id AND oc.transcript_id = ec.transcript_id GROUP BY e.cue_id)
    SELECT uu.cue_id, cut AND coalesce(text, '') = '' AS gone, merged_into, written, coalesce(text, '') AS text FROM uu LEFT JOIN ii USING (cue_id)"""
)
