"""Ordered speaker turns from cue texts and from token streams.

A text is read once, where it is stored, into segments: what a possible label says, and whether words
follow it. Only these short rows are shuffled, joined with the roster's aliases and put in order, block by
block of an owner's time, so a recording with a third of all rows is spread over many tasks.

Between two word segments whose speakers are both known a turn ends exactly if the speakers differ. Where
labels do not decide (recordings without a roster) ``murmurlake.llm.boundaries`` has trained decisions and
the turns they make.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.llm.canon import canonical, with_canonical
from murmurlake.operators.records import once

#: Words that stand in parentheses behind a name in a label (fixed values).
ROLES = ("host", "guest", "moderator", "interviewer")
_ROLE = re.compile(rf"\s*\((?:{'|'.join(ROLES)})\)", re.IGNORECASE)
_GROUP = re.compile(r"<[^<>\n]*>|\[[^\[\]\n]*\]|\([^()\n]*\)|\*[^\W\d_][^*\n]{0,30}\*")
_NAME = r"(?:[^\W\d_]\. )?[^\W_][\w'’-]*(?:,? [\w'’-]+){0,4}"
_COLON = re.compile(rf"(?:^|>>|(?<!\S)[-–—•](?=\s)|[.!?…\"»”,;]\s)\s*({_NAME})\s?:(?!\d)")
_TIME = re.compile(r"^\d{1,2}(?::\d{2}){1,2}(?:[.,]\d{1,3})?$")
_VOICE = re.compile(r"^v(?:\.\S+)?\s+(.+)$", re.IGNORECASE)
_NUMBERED = re.compile(r"^(?:speaker|spk|s)[ _#-]*0*(\d+)$")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SPACES = re.compile(r"\s+")


def filler_pattern(forms: Sequence[str]) -> re.Pattern:
    """Matches any spelling of the plain forms: every run of a letter may be drawn out, case is ignored."""
    parts = []
    for form in forms:
        runs = re.finditer(r"(.)\1*", form.strip().lower())
        parts.append("".join(re.escape(m.group(1)) + ("{%d,}" % len(m.group()) if m.group(1).isalpha() else "") for m in runs))
    return re.compile(rf"^(?:{'|'.join(p for p in parts if p) or '(?!)'})$")


def is_word(token: str, fillers: re.Pattern) -> bool:
    """False for bare punctuation, time stamps, hesitations; sounds and labels are taken out before."""
    core = _EDGE.sub("", token)
    return bool(core) and not _TIME.match(core) and not fillers.match(core.lower())


def has_words(text: str, fillers: re.Pattern) -> bool:
    return any(is_word(t, fillers) for t in text.split())


def label_key(text: str) -> str:
    """The form in which labels and roster aliases are compared: '#n' for numbered speakers."""
    plain = _SPACES.sub(" ", _ROLE.sub("", text)).strip(" :\n\t").lower()
    number = _NUMBERED.match(plain)
    return f"#{int(number.group(1))}" if number else plain


def _is_sound(inside: str) -> bool:
    """Whether text in parentheses that names nobody is a sound or a time stamp rather than speech."""
    inner = inside.strip()
    return bool(_TIME.match(inner)) or (len(inner.split()) <= 2 and inner == inner.lower() and not re.search(r"[.,!?]", inner))


def segments(text: str, fillers: re.Pattern) -> list[tuple[str | None, bool, bool]]:
    """(label key, words in the label's own text if it names nobody, words after it) in order."""
    text = _ROLE.sub("", canonical(text))
    out: list[list] = [[None, False, False]]

    def plain(piece: str) -> None:
        for line in piece.split("\n"):
            at = 0
            for m in _COLON.finditer(line):
                out[-1][2] |= has_words(line[at : m.start(1)], fillers)
                out.append([label_key(m.group(1)), has_words(m.group(1), fillers), False])
                at = m.end()
            out[-1][2] |= has_words(line[at:], fillers)

    at = 0
    for m in _GROUP.finditer(text):
        plain(text[at : m.start()])
        at = m.end()
        mark, inside = m.group()[0], m.group()[1:-1]
        if mark == "*":
            continue
        voice = _VOICE.match(inside) if mark == "<" else None
        if mark == "<" and not voice:
            continue
        speech = mark == "(" and not _is_sound(inside) and has_words(inside, fillers)
        out.append([label_key(voice.group(1) if voice else inside), speech, False])
    plain(text[at:])
    return [tuple(s) for s in out if s[0] is not None or s[2]]


_SEGMENTS = pa.list_(pa.struct([("key", pa.string()), ("own", pa.bool_()), ("words", pa.bool_())]))
_CLOSED = re.compile(r"[.?!…][\"'”’)\]]*$")
_OPENING = re.compile(r"^\s*(?:>>|[-–—]\s|<v|\[|\()")


def speech(text: str, fillers: re.Pattern) -> list[str]:
    """The words of a cue: labels at its start, sounds, time stamps and hesitations left out."""
    plain = _GROUP.sub(" ", _ROLE.sub("", canonical(text)))
    return [t for line in plain.split("\n") for t in _COLON.sub(" ", line).split() if is_word(t, fillers)]


def features(text: str, fillers: re.Pattern) -> dict:
    """What a text says about where a turn ends, from its speech: number of words, whether it opens with a
    capital and closes a sentence; and whether it opens with a mark or with what could be a label."""
    said = speech(text, fillers)
    first = _EDGE.sub("", said[0]) if said else ""
    return {
        "words": float(len(said)), "closes": float(bool(said and _CLOSED.search(said[-1]))), "opens_capital": float(first[:1].isupper()),
        "marked": float(bool(_OPENING.match(text))), "named": float(bool(_COLON.match(text))),
    }


CUE_FEATURES = ("words", "closes", "opens_capital", "marked", "named")


def _read_texts(forms: list[str], keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fillers = filler_pattern(forms)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [[{"key": k, "own": o, "words": w} for k, o, w in segments(t, fillers)] for t in texts]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(found, _SEGMENTS)], names=[*keep, "segments"])

    return run


def _read_features(forms: list[str], keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fillers = filler_pattern(forms)
        for batch in batches:
            found = [features(t, fillers) for t in batch.column("text").to_pylist()]
            columns = [pa.array([f[c] for f in found], pa.float64()) for c in CUE_FEATURES]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *columns], names=[*keep, *CUE_FEATURES])

    return run


def cue_features(cues: DataFrame, forms: list[str]) -> DataFrame:
    """owner, o1, o2, id, ends and ``CUE_FEATURES`` of every cue with a start and a text, each id once.

    Texts are read where they lie; only the short rows are shuffled, to drop repeated ids.
    """
    keep = ["owner", "o1", "o2", "id", "ends"]
    rows = cues.filter(F.col("o1").isNotNull() & F.col("text").isNotNull()).select(*keep, "text")
    ddl = "owner string, o1 bigint, o2 bigint, id bigint, ends bigint, " + ", ".join(f"{c} double" for c in CUE_FEATURES)
    return once(rows.mapInArrow(_read_features(forms, keep), ddl), "id")


def _token_words(forms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fillers = filler_pattern(forms)
        known: dict[str, bool] = {}
        keep = ["owner", "o1", "o2", "id", "speaker"]
        for batch in batches:
            flags = []
            for t in batch.column("token").to_pylist():
                if t not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[t] = has_words(_GROUP.sub(" ", canonical(t)), fillers)
                flags.append(known[t])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(flags, pa.bool_())], names=[*keep, "words"]).filter(pa.array(flags, pa.bool_()))

    return run


def aliases(roster: DataFrame, owner: str = "owner_id", number: str = "speaker_no", name: str = "display_name") -> DataFrame:
    """owner, key, speaker_no: every way a label may name a speaker; ways that fit two speakers are left out."""
    rows = roster.select(F.col(owner).alias("owner"), F.col(number).alias("speaker_no"), F.col(name).alias("name")).distinct()
    rows = with_canonical(rows, "name", "__n").withColumn("__n", F.lower(F.regexp_replace("__n", r"\s+", " ")))
    parts = F.split("__n", " ")
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    ways = F.array(
        F.concat(F.lit("#"), F.col("speaker_no").cast("string")),
        F.col("__n"),
        F.concat_ws(", ", last, first),
        F.concat(F.left(first, F.lit(1)), F.lit(". "), last),
        first,
        last,
    )
    each = rows.filter(F.col("owner").isNotNull() & F.col("speaker_no").isNotNull()).select("owner", "speaker_no", F.explode(F.array_distinct(F.array_compact(ways))).alias("key"))
    return each.filter(F.col("key") != "").groupBy("owner", "key").agg(F.min("speaker_no").alias("speaker_no"), F.max("speaker_no").alias("__other")).filter(F.col("speaker_no") == F.col("__other")).drop("__other")


_MARK = ["turn_of", "owner", "block", "o1", "o2", "id", "seg", "speaker_no", "spoken"]


def cue_marks(cues: DataFrame, roster: DataFrame, forms: list[str]) -> DataFrame:
    """What the cues of owners with a roster say, in order: labels (``speaker_no``) and words (``spoken``).

    ``cues`` has owner, o1 (start), o2 (place), id and text; rows repeated under an id count once, null
    starts, texts and owners are left out. Texts are read where they lie, so only short rows are shuffled;
    only rows with a possible label meet the roster's names.
    """
    keep = ["owner", "o1", "o2", "id"]
    rows = cues.filter(F.col("o1").isNotNull() & F.col("text").isNotNull() & F.col("owner").isNotNull())
    read = rows.select(*keep, "text").mapInArrow(_read_texts(forms, keep), "owner string, o1 bigint, o2 bigint, id bigint, segments array<struct<key:string,own:boolean,words:boolean>>")
    read = once(read.filter(F.size("segments") > 0), "id").join(roster.select("owner").distinct(), "owner", "left_semi")
    flat = read.select(*keep, F.posexplode("segments").alias("seg", "s")).select(*keep, "seg", "s.key", "s.own", "s.words")
    named = flat.filter(F.col("key").isNotNull()).join(roster, ["owner", "key"], "left")
    bare = flat.filter(F.col("key").isNull()).withColumn("speaker_no", F.lit(None).cast("int"))
    spoken = F.col("words") | (F.col("own") & F.col("speaker_no").isNull())
    both = named.unionByName(bare).withColumns({"turn_of": F.lit("cue"), "block": F.shiftright("o1", 28), "spoken": spoken})
    return both.filter(F.col("spoken") | F.col("speaker_no").isNotNull()).select(*_MARK)


def token_marks(tokens: DataFrame, roster: DataFrame, forms: list[str]) -> DataFrame:
    """The word tokens of owners with a roster, with their speaker where it is known.

    ``tokens`` has owner, o1 (place), o2, id, token and speaker; rows repeated under an id count once. A
    null, blank or unknown speaker leaves ``speaker_no`` null.
    """
    rows = tokens.filter(F.col("token").isNotNull() & F.col("o1").isNotNull() & F.col("owner").isNotNull())
    words = rows.select("owner", "o1", "o2", "id", "speaker", "token").mapInArrow(_token_words(forms), "owner string, o1 bigint, o2 bigint, id bigint, speaker string, words boolean")
    words = with_canonical(once(words, "id"), "speaker", "__s")
    plain = F.lower(F.btrim(F.regexp_replace(F.regexp_replace("__s", rf"(?i)\s*\(({'|'.join(ROLES)})\)", ""), r"\s+", " "), F.lit(" :")))
    number = F.regexp_extract(plain, r"^(?:(?:speaker|spk|s)[ _#-]*)?0*(\d+)$", 1)
    keyed = words.withColumn("key", F.when(number != "", F.concat(F.lit("#"), number)).otherwise(plain))
    named = keyed.filter(F.col("key").isNotNull()).join(roster, ["owner", "key"], "left")
    bare = keyed.filter(F.col("key").isNull()).withColumn("speaker_no", F.lit(None).cast("int"))
    return named.unionByName(bare).withColumns({"turn_of": F.lit("token"), "block": F.shiftright("o1", 10), "seg": F.lit(0), "spoken": F.lit(True)}).select(*_MARK)


def spoken_words(marks: DataFrame) -> DataFrame:
    """Words with their speaker and the number of their turn: turn_of, owner, o1, o2, id, seg, speaker_no, turn_no.

    ``marks`` are read more than once, so give them as a written table. A label holds until the next one;
    words before an owner's first label have no row. Rows meet in blocks of an owner's time: one shuffle
    and one sort. A block is summed up by one short row (its last label, its first and last speaker, its
    changes), these rows alone are put in order per owner, and what holds at a block's start goes back to it.
    """
    key = ["turn_of", "owner"]
    block, order = [*key, "block"], ["o1", "o2", "id", "seg"]
    inside = Window.partitionBy(*block).orderBy(*order)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    local = marks.withColumn("label", F.last("speaker_no", True).over(upto))
    said = F.when(F.col("spoken"), F.col("label"))
    former = F.last(said, True).over(before)
    sums = local.withColumns({"said": said, "inner": (said.isNotNull() & former.isNotNull() & (said != former)).cast("bigint")})
    place = F.struct(*order)
    sums = sums.groupBy(*block).agg(
        F.bool_or(F.col("spoken") & F.col("label").isNull()).alias("leads"), F.max_by("label", F.when(F.col("label").isNotNull(), place)).alias("last_label"),
        F.min_by("said", F.when(F.col("said").isNotNull(), place)).alias("first_said"), F.max_by("said", F.when(F.col("said").isNotNull(), place)).alias("last_said"), F.sum("inner").alias("inner"),
    )
    past = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("held", F.last("last_label", True).over(past)).withColumn("lead", F.when(F.col("leads"), F.col("held")))
    sums = sums.withColumn("until", F.last(F.coalesce("last_said", "lead"), True).over(past))
    opens = F.coalesce("lead", "first_said")
    new = (opens.isNotNull() & ~F.col("until").eqNullSafe(opens)).cast("bigint") + F.coalesce((F.col("lead") != F.col("first_said")).cast("bigint"), F.lit(0)) + F.col("inner")
    sums = sums.withColumn("turns", F.coalesce(F.sum(new).over(past), F.lit(0))).select(*block, "held", "until", "turns")
    words = local.filter("spoken").join(sums, block).withColumn("speaker_no", F.coalesce("label", "held")).filter(F.col("speaker_no").isNotNull())
    fresh = (~F.coalesce(F.lag("speaker_no").over(inside), "until").eqNullSafe(F.col("speaker_no"))).cast("bigint")
    words = words.withColumn("fresh", fresh).withColumn("turn_no", (F.col("turns") + F.sum("fresh").over(upto)).cast("int"))
    return words.select(*key, *order, "speaker_no", "turn_no")


def turns(marks: DataFrame) -> DataFrame:
    """Maximal runs of words of one speaker: turn_of, owner_id, turn_no, speaker_no, first_id, last_id."""
    place = F.struct("o1", "o2", "id", "seg")
    per = spoken_words(marks).groupBy("turn_of", "owner", "turn_no").agg(F.min("speaker_no").alias("speaker_no"), F.min_by("id", place).alias("first_id"), F.max_by("id", place).alias("last_id"))
    return per.select("turn_of", F.col("owner").alias("owner_id"), "turn_no", "speaker_no", "first_id", "last_id")
