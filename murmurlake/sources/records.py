"""Readers of token files, term lists, labelled cases, stored flags and logs, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.functions import text as T

FLAG = "struct<span:string,global_indices:array<int>,cue_index:int,start:double,end:double,detector:string,reason:string,candidates:array<string>,confidence:double,context:string>"
CASE = "source string, span string, verdict string, candidate string, context string, kind string, entity boolean"
LEDGER = "at timestamp, session string, words bigint, cost_usd double, transcript_words bigint"


def read_tokens(spark: SparkSession, path: str, tags: DataFrame | None = None) -> DataFrame:
    """Bar-separated token files with a header and no quoting: call_id, pos, token, speaker, start_s, end_s,
    punctuation, entity_types. Empty and non-speech tokens are dropped; malformed times are null.

    ``tags`` (call_id, id, entity_type) resolves the ids of ``wer_tags``.
    """
    raw = spark.read.format("text").option("wholetext", True).load(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*?)(?:\.[^./]+)?$", 1).alias("call_id"), F.split(F.rtrim("value", F.lit("\r\n")), r"\r?\n").alias("lines"))
    head = F.transform(F.split(F.col("lines")[0], r"\|"), lambda c: F.trim(c))
    flat = raw.select("call_id", head.alias("head"), F.posexplode(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("pos", "line"))
    cells = flat.withColumn("v", F.split("line", r"\|", -1))

    def cell(*names: str):
        found = [F.get(F.col("v"), (F.array_position("head", n) - 1).cast("int")) for n in names]
        return F.coalesce(*[F.when(F.array_contains("head", n), f) for n, f in zip(names, found)])

    rows = cells.select(
        "call_id", "pos", cell("token").alias("token"), F.nullif(cell("speaker"), F.lit("")).alias("speaker"), T.lenient_seconds(cell("ts")).alias("start_s"), T.lenient_seconds(cell("endTs", "endts")).alias("end_s"),
        F.coalesce(cell("punctuation"), F.lit("")).alias("punctuation"), F.regexp_extract_all(F.coalesce(cell("wer_tags"), F.lit("")), F.lit(r"'([^']+)'"), F.lit(1)).alias("ids"),
    )
    rows = rows.filter((F.col("token") != "") & ~F.col("token").rlike(r"^(<[^>]*>|\*+)$"))
    if tags is None:
        return rows.drop("ids").withColumn("entity_types", F.array().cast("array<string>"))
    named = rows.select("call_id", "pos", F.explode("ids").alias("id")).join(tags, ["call_id", "id"]).groupBy("call_id", "pos").agg(F.sort_array(F.collect_set("entity_type")).alias("entity_types"))
    return rows.drop("ids").join(named, ["call_id", "pos"], "left").withColumn("entity_types", F.coalesce("entity_types", F.array().cast("array<string>")))


def read_tag_map(spark: SparkSession, path: str) -> DataFrame:
    """call_id, id, entity_type from JSON files ``{"id": {"entity_type": name}}``, one for each call."""
    raw = spark.read.format("text").option("wholetext", True).load(path)
    call = F.regexp_extract(F.col("_metadata.file_path"), r"([^/.]*)[^/]*$", 1)
    return raw.select(call.alias("call_id"), F.explode(F.from_json("value", "map<string,struct<entity_type:string>>")).alias("id", "v")).select("call_id", "id", "v.entity_type")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Column ``term`` from lists with one term a line; text after ``#`` and blank lines are left out."""
    line = F.btrim(F.split("value", "#")[0], F.lit(" \t\r"))
    return spark.read.text(path).select(line.alias("term")).filter(F.col("term") != "")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases from JSON arrays; missing fields are null, a missing ``entity`` is false."""
    rows = spark.read.json(path, schema=CASE, multiLine=True)
    return rows.filter(F.col("span").isNotNull()).withColumn("entity", F.coalesce("entity", F.lit(False)))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Stored transcripts, one row for each flag: id, session_id, flag_no, flag fields, correction, decision."""
    schema = (
        f"id string, session_id string, filename string, created_at string, last_activity string, flags array<{FLAG}>, "
        "corrections array<struct<replacement:string,confidence:double,rationale:string>>, decisions array<struct<status:string,text:string>>"
    )
    rows = spark.read.json(path, schema=schema, multiLine=True).filter(F.col("id").isNotNull())
    rows = rows.withColumn("last_activity", F.coalesce("last_activity", "created_at"))
    lists = {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("flags", "corrections", "decisions")}
    rows = rows.withColumns(lists)
    zipped = F.arrays_zip("flags", "corrections", "decisions")
    flat = rows.select("id", "session_id", F.try_to_timestamp("created_at").alias("created_at"), F.try_to_timestamp("last_activity").alias("last_activity"), F.posexplode(zipped).alias("flag_no", "z"))
    return flat.select("id", "session_id", "created_at", "last_activity", "flag_no", "z.flags.*", F.col("z.corrections").alias("correction"), F.col("z.decisions").alias("decision"))


def parse_ledger(lines: DataFrame, value: str = "value") -> DataFrame:
    """Ledger entries from JSON lines; lines that do not parse are skipped, older ones lack transcript_words."""
    rows = lines.select(F.from_json(value, LEDGER, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    return rows.filter(F.col("at").isNotNull() & F.col("session").isNotNull() & F.col("words").isNotNull()).withColumn("transcript_words", F.coalesce("transcript_words", "words"))


def parse_usage(lines: DataFrame, events: list[str], value: str = "value") -> DataFrame:
    """at, event, detail from lines ``time event [detail]``; other lines and unknown events are skipped."""
    parts = F.split(F.trim(value), r"\s+", 3)
    rows = lines.select(F.try_to_timestamp(F.get(parts, F.lit(0))).alias("at"), F.get(parts, F.lit(1)).alias("event"), F.get(parts, F.lit(2)).alias("detail"))
    return rows.filter(F.col("at").isNotNull() & F.col("event").isin(*events))


def flag_json(flags: DataFrame, out: str = "json") -> DataFrame:
    """Add the ten-field JSON form of a flag; times become seconds."""
    return flags.withColumn(
        out,
        F.to_json(F.struct("span", "global_indices", "cue_index", (F.col("start_us") / 1e6).alias("start"), (F.col("end_us") / 1e6).alias("end"), "detector", "reason", "candidates", "confidence", "context")),
    )


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those with the same keys.

    Of several changes of one key the one with the highest ``version`` (a column of ``changes``) is kept, and
    among equal versions, or without one, the greatest row by its columns in order; so the result does not
    depend on chance.
    """
    order = F.struct(*([F.col(version)] if version else []), *table.columns)
    new = changes.groupBy(*keys).agg(F.max_by(F.struct(*table.columns), order).alias("__row")).select("__row.*")
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated table with a header, every field as text; quoted fields may hold line breaks."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """source, priming_terms, exhaustive from JSON ``{"sources": {name: {"priming_terms": [...]}}}``; every
    source that is named is exhaustive, one without terms has an empty list."""
    raw = spark.read.format("text").option("wholetext", True).load(path)
    named = raw.select(F.explode(F.from_json("value", "sources map<string,struct<priming_terms:array<string>>>")["sources"]).alias("source", "v"))
    return named.select("source", F.coalesce("v.priming_terms", F.array().cast("array<string>")).alias("priming_terms"), F.lit(True).alias("exhaustive"))


DECISION = "span string, model string, replacement string, confidence double, rationale string"


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Remembered decisions (``DECISION``) from JSON ``{span: {model: decision}}``; a missing or garbled file
    gives none, a missing confidence is 0."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], DECISION)
    raw = spark.read.format("text").option("wholetext", True).load(path)
    kind = "map<string,map<string,struct<replacement:string,confidence:double,rationale:string>>>"
    each = raw.select(F.explode(F.from_json("value", kind)).alias("span", "by")).select("span", F.explode("by").alias("model", "d"))
    return each.select("span", "model", "d.replacement", F.coalesce("d.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("d.rationale", F.lit("")).alias("rationale"))


def compose_decisions(decisions: DataFrame) -> DataFrame:
    """One row ``content``: the JSON that ``read_decisions`` reads, keys in order. A cache file is one value."""
    d = F.struct("replacement", "confidence", "rationale")
    per = decisions.groupBy("span").agg(F.array_sort(F.collect_list(F.struct("model", d.alias("d")))).alias("by"))
    spans = F.transform(F.array_sort(F.collect_list(F.struct("span", "by"))), lambda e: F.struct(e["span"], F.map_from_entries(e["by"])))
    return per.agg(F.to_json(F.map_from_entries(spans)).alias("content"))


def with_decision(flags: DataFrame, decisions: DataFrame, model: str) -> DataFrame:
    """Flags with the remembered ``decision`` of ``model`` on their clean span; null where there is none, which
    is what is left to judge."""
    known = decisions.filter(F.col("model") == model).select(F.col("span").alias("__span"), F.struct("replacement", "confidence", "rationale").alias("decision"))
    return flags.withColumn("__span", T.clean(F.col("span"))).join(known, "__span", "left").drop("__span")


def append_ledger(entries: DataFrame, path: str) -> None:
    """Append entries (``LEDGER``) to a ledger of JSON lines."""
    entries.select([c.split()[0] for c in LEDGER.split(", ")]).write.mode("append").json(path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def compact_ledger(spark: SparkSession, path: str, into: str, keep_us: int, now: str) -> DataFrame:
    """Write the entries of the last ``keep_us`` before ``now`` (UTC) to the folder ``into`` and return them; the
    old ledger stays whole until the caller drops it. Lines that do not parse are left behind."""
    recent = parse_ledger(spark.read.text(path)).filter(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("at") < keep_us)
    append_ledger(recent, into)
    return parse_ledger(spark.read.text(into))


#: What a detail of a usage line may look like (fixed value).
DETAIL = r"^[A-Za-z0-9_.-]+$"


def append_usage(rows: DataFrame, path: str, events: list[str]) -> None:
    """Append ``time event [detail]`` lines (columns at, event, detail). Raises ``ValueError`` before anything is
    written if an event is unknown or a detail unsafe."""
    bad = rows.filter(F.col("event").isNull() | ~F.col("event").isin(*events) | F.coalesce(~F.col("detail").rlike(DETAIL), F.lit(False)))
    first = bad.select("event", "detail").limit(1).collect()
    if first:
        raise ValueError(f"unknown event or unsafe detail: {first[0]}")
    rows.select(F.concat_ws(" ", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), "event", "detail").alias("value")).write.mode("append").text(path)


def write_sidecar(outcomes: DataFrame, path: str) -> None:
    """One JSON object for each flag: ``flag`` (its ten fields), ``outcome`` and, where there is one, ``correction``."""
    flag = F.struct("span", "global_indices", "cue_index", (F.col("start_us") / 1e6).alias("start"), (F.col("end_us") / 1e6).alias("end"), "detector", "reason", "candidates", "confidence", "context")
    outcomes.select(flag.alias("flag"), "outcome", *[c for c in ("correction",) if c in outcomes.columns]).write.mode("overwrite").json(path)


def without(table: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``table`` without the rows whose key is in ``gone``; null keys stay."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def find_record(table: DataFrame, key: str, value: str) -> DataFrame:
    """The rows of one key in any session; none if there is no such key. The filter reaches the scan."""
    return table.filter(F.col(key) == value)
