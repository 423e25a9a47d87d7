"""Text functions as column expressions: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation stripped from a token's edges, and a span's edges with blanks added (fixed values).
EDGE = "\"'`.,;:!?()[]{}<>«»•–—…“”‘’"
SPAN_EDGE = EDGE + " \t\n"
#: Words no detector looks at (fixed values).
STOPWORDS = """
a an the and or but if then else of to in on at by for with without from into
over under again further is are was were be been being do does did have has had
i you he she it we they me him her us them my your his its our their this that
these those as so than too very can will just not no nor only own same s t
we're we'll today next week
uh um
""".split()


def tokens(text: Column) -> Column:
    """``array<struct<gap, word>>``: every maximal run of non-blank characters and the blanks before it."""
    gaps = F.regexp_extract_all(text, F.lit(r"(?U)(\s*)(\S+)"), F.lit(1))
    found = F.regexp_extract_all(text, F.lit(r"(?U)(\s*)(\S+)"), F.lit(2))
    return F.arrays_zip(gaps.alias("gap"), found.alias("word"))


def positioned(text: Column) -> Column:
    """``array<struct<word, char_offset>>`` with 0-based code-point offsets."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<word:string,char_offset:int>>").alias("done"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["gap"])
        entry = F.struct(t["word"].alias("word"), begin.alias("char_offset"))
        return F.struct((begin + F.length(t["word"])).alias("at"), F.concat(acc["done"], F.array(entry)).alias("done"))

    return F.aggregate(tokens(text), start, step, lambda acc: acc["done"])


def trim_edges(token: Column) -> Column:
    return F.btrim(token, F.lit(EDGE))


def clean(token: Column) -> Column:
    """Edges trimmed and case folded (the sharp s is what folding adds to lower-casing here)."""
    return F.replace(F.lower(trim_edges(token)), F.lit("ß"), F.lit("ss"))


def is_all_caps(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_wordlike(token: Column) -> Column:
    """Worth a detector's look: two or more characters, a letter, no digit, no short acronym or its plural."""
    core = trim_edges(token)
    single = F.when(F.endswith(core, F.lit("s")), F.left(core, F.length(core) - 1)).otherwise(core)
    acronym = is_all_caps(core) & (F.length(core) <= 4)
    plural = is_all_caps(single) & F.length(single).between(2, 4)
    return (F.length(core) >= 2) & ~core.rlike(r"\p{Nd}") & core.rlike(r"\p{L}") & ~acronym & ~plural


def possessive_base(cleaned: Column) -> Column:
    """What stands before ``'s``, else null."""
    return F.when(cleaned.rlike("['’]s$"), F.left(cleaned, F.length(cleaned) - 2))


def span_text(words: Column) -> Column:
    """Words joined by one blank, outer punctuation left off; kept as they are if nothing else is there."""
    raw = F.array_join(words, " ")
    return F.coalesce(F.nullif(F.btrim(raw, F.lit(SPAN_EDGE)), F.lit("")), raw)


def is_miscased(surface: Column, display: Column) -> Column:
    """A term with capitals inside it is written in another case, but not in capitals throughout."""
    inside = F.substring(display, 2, 1 << 20)
    brand = (F.lower(inside) != inside) & ~is_all_caps(display)
    return brand & (surface != display) & ~is_all_caps(surface)


def ends_sentence(word: Column) -> Column:
    return word.rlike(r"[.!?]$")


def caption_time(us: Column, separator: str = ",") -> Column:
    """``HH:MM:SS,mmm``, milliseconds rounded half up."""
    ms = F.floor((us + 500) / 1000).cast("bigint")
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", F.floor(ms / 3600000).cast("bigint"), F.floor(ms / 60000).cast("bigint") % 60, F.floor(ms / 1000).cast("bigint") % 60, ms % 1000)


def player_time(us: Column, round_up: bool = False) -> Column:
    """``m:ss`` or ``h:mm:ss``, seconds floored or rounded up."""
    s = (F.ceil(us / 1000000) if round_up else F.floor(us / 1000000)).cast("bigint")
    h, m = F.floor(s / 3600).cast("bigint"), F.floor(s / 60).cast("bigint") % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def parse_time(text: Column) -> Column:
    """Microseconds of ``H:M:S.mmm``, ``M:S,mmm`` and the like; null if malformed."""
    parts = F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":")
    seconds = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p.try_cast("double"))
    return F.when(text.rlike(r"^\s*(?:\d+:){1,2}\d{1,2}(?:[.,]\d{1,6})?\s*$"), F.round(seconds * 1000000).cast("bigint"))


def lenient_seconds(text: Column) -> Column:
    """Seconds of a field that may be empty or malformed (then null)."""
    return F.when(text.rlike(r"^\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*$"), F.trim(text).try_cast("double"))


def upload_date(at: Column) -> Column:
    """A UTC time stamp as a page states it: ``4 Oct 2026, 09:05 UTC``; for sessions in UTC."""
    return F.concat(F.date_format(at, "d MMM yyyy, HH:mm"), F.lit(" UTC"))


def wait_text(us: Column) -> Column:
    """A wait, rounded up to the minute: ``1 h 5 min``, ``3 h`` or ``7 min``."""
    m = F.ceil(us / 60000000).cast("bigint")
    h, rest = F.floor(m / 60).cast("bigint"), m % 60
    return F.when(h == 0, F.format_string("%d min", rest)).when(rest == 0, F.format_string("%d h", h)).otherwise(F.format_string("%d h %d min", h, rest))


def highlight(context: Column, span: Column) -> Column:
    """HTML-escaped context with the first occurrence of the span marked."""

    def escape(c: Column) -> Column:
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
            c = F.replace(c, F.lit(raw), F.lit(safe))
        return c

    text, mark = escape(context), escape(span)
    at = F.instr(text, mark)
    marked = F.concat(F.substring(text, F.lit(1), at - 1), F.lit("<mark>"), mark, F.lit("</mark>"), F.substring(text, at + F.length(mark), F.length(text)))
    return F.when((F.length(mark) > 0) & (at > 0), marked).otherwise(text)


def list_terms(raw: Column) -> Column:
    """Terms of a list separated by commas or line breaks, blank ones dropped."""
    return F.filter(F.transform(F.split(raw, "[,\n]"), lambda t: F.btrim(t, F.lit(" \t\r\n"))), lambda t: t != "")


def title_phrases(title: Column) -> Column:
    """Phrases of a title: cut at bars, spaced dashes, colons and commas; first spelling of each kept."""
    parts = F.filter(F.transform(F.split(title, r"\||\s[-–—]\s|:|,"), lambda t: F.trim(t)), lambda t: t != "")
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda kept, t: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(t)), kept).otherwise(F.concat(kept, F.array(t))),
    )


def letters(text: Column) -> Column:
    """Letters and digits only, lower-cased: texts with the same letters differ in layout alone."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))


def align_words(word: Column) -> Column:
    """A word as alignment compares it, none or several: lower case, hyphens cut, marks dropped."""
    plain = F.regexp_replace(F.replace(F.lower(word), F.lit("-"), F.lit(" ")), r"[^\p{L}\p{Nd}_ '.]", "")
    return F.filter(F.transform(F.split(plain, r"\s+"), lambda t: F.btrim(t, F.lit("'."))), lambda t: t != "")


def short_tag(raw: Column) -> Column:
    """A tag of 1 to 32 plain characters, lower-cased; else null."""
    t = F.lower(F.trim(raw))
    return F.when(t.rlike(r"^[a-z0-9_-]{1,32}$"), t)


def video_id(link: Column) -> Column:
    """The 11-character id of a video link (watch, short, shorts, embed, live) or a bare id; else null."""
    t = F.trim(link)
    path = F.regexp_extract(t, r"^(?:https?://)?(?:(?:www|m)\.)?youtube\.com/(?:shorts|embed|live)/([A-Za-z0-9_-]{11})(?:[/?#].*)?$", 1)
    short = F.regexp_extract(t, r"^(?:https?://)?youtu\.be/([A-Za-z0-9_-]{11})(?:[/?#].*)?$", 1)
    watch = F.regexp_extract(t, r"^(?:https?://)?(?:(?:www|m)\.)?youtube\.com/watch\?(?:[^#]*&)?v=([A-Za-z0-9_-]{11})(?:[&#].*)?$", 1)
    bare = F.regexp_extract(t, r"^([A-Za-z0-9_-]{11})$", 1)
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (watch, short, path, bare)])


def watch_link(video: Column, at_us: Column | None = None) -> Column:
    """A link to a video, started one second before ``at_us``."""
    base = F.concat(F.lit("https://www.youtube.com/watch?v="), video)
    if at_us is None:
        return base
    return F.concat(base, F.lit("&t="), F.greatest(F.floor(at_us / 1000000 - 1), F.lit(0)).cast("string"), F.lit("s"))


def oov_confidence(zipf: Column) -> Column:
    return F.when(zipf == 0, F.lit(0.9)).otherwise(F.greatest(F.lit(0.4), F.lit(0.9) - zipf / 3.0))


def clamp_confidence(raw: Column) -> Column:
    """A number from 0 to 1; 0 for what is no number."""
    v = raw.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def without_fence(reply: Column) -> Column:
    """A JSON reply without the code fence around it."""
    return F.regexp_replace(F.trim(reply), r"^```[A-Za-z]*\s*|\s*```$", "")
