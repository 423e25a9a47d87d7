"""One consistent form for texts that look the same.

Two texts look the same here if they differ only in: full-width or normal forms, composed or combining
accents, ligatures or their letters, look-alike letters of other scripts, hyphens of one look, the kind
of single blanks, characters without width, and blanks at the ends. Case, missing accents, superscripts,
the shape of quotes and line breaks are visible and stay.

Most texts need no work. A scan in the JVM finds those with any unstable character: one that the form
replaces, or that is not surely normal by the quick-check properties of normalization (no NFC character, a
combining class, or the second of a composition). Stable text in any script, composed accents included,
passes by. Only the others reach Python, where each run of unstable characters, with the one character
before it as its boundary context (a base letter that an accent may join), is checked, normalised and
spliced back into the rest. Segments repeat endlessly, so their forms are remembered per worker up to a bound.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmurlake.operators.records import once
from murmurlake.operators.scans import join_null_safe
from murmurlake.session import materialise

#: Letters of other scripts and the Latin letters they look like (fixed values, from the Unicode
#: confusables data; only letters that are told apart by neither width nor height).
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    # Greek
    "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j", "ν": "v", "α": "a", "ι": "i",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "Օ": "O", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q",
    # phonetic Latin
    "ɑ": "a", "ɡ": "g", "ɩ": "i",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L",
    "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "Ꭵ": "i",
    # Roman numerals of one letter
    "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
#: Hyphens of the same look as the ASCII one (fixed values).
HYPHENS = "\u2010\u2011\u2043\u02d7\ufe63\uff0d"
REMEMBERED = 200_000
#: Categories of blanks, breaks, controls and formats, and further characters without a look (fixed values).
_INVISIBLE = ("Zs", "Zl", "Zp", "Cc", "Cf")
_IGNORED = frozenset([0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0x180B, 0x180E)])
#: Code points that are neither looked up nor composed, one by one: ideographs, syllables and private use.
_PLAIN = ((0x3400, 0xA000), (0xAC00, 0xF900), (0x20000, 0xE0000), (0xE1000, 0x110000))


def _single(ch: str) -> str:
    """The visible form of one decomposed character."""
    n = ord(ch)
    if 0xFF01 <= n <= 0xFF5E and ch not in HYPHENS:
        return chr(n - 0xFEE0)
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    if ch in HYPHENS:
        return "-"
    kind = unicodedata.category(ch)
    if kind == "Zs" or ch == "\t":
        return " "
    if ch in "\u2028\u2029\x0b\x0c\x85":
        return "\n"
    if kind in ("Cf", "Cc") and ch != "\n":
        return ""
    # default-ignorable characters that are neither controls nor formats
    if n in _IGNORED:
        return ""
    if 0xFB00 <= n <= 0xFB06 or unicodedata.decomposition(ch).startswith("<font>"):
        return unicodedata.normalize("NFKC", ch)
    return ch


def _segment(text: str) -> str:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return unicodedata.normalize("NFC", "".join(map(_single, unicodedata.normalize("NFD", text))))


def _unstable() -> list[list[int]]:
    """The unstable characters as ranges, by rule from the properties of each."""
    decomposition, combining, category = unicodedata.decomposition, unicodedata.combining, unicodedata.category
    # what may compose with the character before it
    seconds = {*map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3))}
    found = []
    for lo, hi in zip((0, *(hi for _, hi in _PLAIN)), (lo for lo, _ in _PLAIN)):
        for n in range(lo, min(hi, 0x110000)):
            c = chr(n)
            parts = decomposition(c)
            if parts and parts[0] != "<" and " " in parts:
                seconds.add(chr(int(parts.split()[1], 16)))
            # only what has one of these properties can have another form than itself
            if combining(c) or ((parts or c in LOOKALIKES or c in HYPHENS or category(c) in _INVISIBLE or n in _IGNORED) and _segment(c) != c):
                found.append(n)
    found = sorted({*found, *map(ord, seconds)})
    runs: list[list[int]] = []
    for n in found:
        if runs and n == runs[-1][1] + 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    return runs


_RUNS = _unstable()
#: Texts with any unstable character, as the JVM writes it; visible ASCII is told apart first, as that is cheap.
UNSTABLE = r"[\x{0}-\x{9}\x{b}-\x{1f}\x{7f}-\x{10ffff}&&[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _RUNS) + "]]"
# the ranges of the basic plane alone become a bitmap; the others are looked at behind a cheap test
_BASIC = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in _RUNS if b <= 0xFFFF)
_OTHER = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _RUNS if a > 0xFFFF)
_SEGMENT = re.compile(f"(?:\r\n|[{_BASIC}]|(?=[\U00010000-\U0010ffff])[{_OTHER}])+")


_FORMS: dict[str, str] = {}


def _remembered(seg: str) -> str:
    form = _FORMS.get(seg)
    if form is None:
        if len(_FORMS) >= REMEMBERED:
            _FORMS.clear()
        form = _segment(seg)
        if len(seg) <= 64:
            _FORMS[seg] = form
    return form


def canonical(text: str) -> str:
    """The form of one text, blanks at the ends included."""
    if text.isascii() and text.isprintable():
        return text
    parts, at = [], 0
    for m in _SEGMENT.finditer(text):
        # with the character before it
        lo = max(m.start() - 1, at)
        parts += [text[at:lo], _remembered(text[lo : m.end()])]
        at = m.end()
    if not parts:
        return text
    spliced = "".join([*parts, text[at:]])
    # a removed character may have stood between a letter and its accent, or between carriage return and feed
    return spliced if unicodedata.is_normalized("NFC", spliced) else unicodedata.normalize("NFC", spliced)


def _canonical_batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: None if t is None else canonical(t))


def with_canonical(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the canonical form of ``text``; null stays null, an invisible text becomes empty.

    Repeated rows, very long texts and other columns of any name need no care: the form depends on the
    text alone.
    """
    t: Column = F.col(text)
    unstable = F.when(t.rlike(UNSTABLE), t)
    worked = df.withColumn("__work", F.pandas_udf(_canonical_batches, T.StringType(), F.PandasUDFType.SCALAR_ITER)(unstable))
    return worked.withColumn(out, F.btrim(F.coalesce("__work", t), F.lit(" \n"))).drop("__work")


def lookalike_pairs(df: DataFrame, scope: list[str], record: str, text: str) -> DataFrame:
    """Pairs of records of one scope whose texts look the same but differ: scope, id_a < id_b.

    ``df`` holds each record once. Records are first folded into classes of equal texts; only forms with
    two or more different texts go on, and pairs are built between the classes of a form, so equal texts,
    however often they occur, never meet. Null and empty texts and null ids take no part; null scopes
    form one scope.
    """
    src = df.select(*scope, F.col(record).alias("__id"), F.col(text).alias("__text")).filter(F.col("__id").isNotNull() & (F.length("__text") > 0))
    rows = with_canonical(src, "__text", "__form")
    key = [*scope, "__form"]
    # counted map-side first: a form that fills a third of the table is one row per task
    several = rows.groupBy(*key).agg(F.min("__text").alias("__lo"), F.max("__text").alias("__hi")).filter(F.col("__lo") != F.col("__hi")).select(*key)
    same = F.lit(True)
    known = several.select(*[F.col(c).alias(f"__k_{c}") for c in key])
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    # read four times below, and a small part of all rows: written once
    members = materialise(rows.join(known, same, "left_semi"))
    classes = members.groupBy(*key, "__text").agg(F.count("*").alias("__n"))
    a = classes.select(*key, F.col("__text").alias("__ta"))
    b = classes.select(*[F.col(c).alias(f"__k_{c}") for c in key], F.col("__text").alias("__tb"))
    pairs = a.join(b, same & (F.col("__ta") < F.col("__tb"))).select(*key, "__ta", "__tb")
    left = members.select(*[F.col(c).alias(f"__k_{c}") for c in key], F.col("__id").alias("__ia"), F.col("__text").alias("__xa"))
    half = pairs.join(left, same & (F.col("__ta") == F.col("__xa"))).select(*key, "__tb", "__ia")
    right = members.select(*[F.col(c).alias(f"__k_{c}") for c in key], F.col("__id").alias("__ib"), F.col("__text").alias("__xb"))
    whole = half.join(right, same & (F.col("__tb") == F.col("__xb")))
    return whole.select(*scope, F.least("__ia", "__ib").alias("id_a"), F.greatest("__ia", "__ib").alias("id_b"))


def lookalike_classes(df: DataFrame, scope: list[str], record: str, text: str) -> DataFrame:
    """Every record that looks like another with a different text: scope, id, class_id (the least id of its
    form), links (records of the form with another text). The pairs of a class need not be written out:
    any two members with different texts are one. Nulls and empty texts as in ``lookalike_pairs``.
    """
    src = df.select(*scope, F.col(record).alias("id"), F.col(text).alias("__text")).filter(F.col("id").isNotNull() & (F.length("__text") > 0))
    rows = materialise(with_canonical(src, "__text", "__form"))
    key = [*scope, "__form"]
    texts = rows.groupBy(*key, "__text").agg(F.count("*").alias("__n"), F.min("id").alias("__least"))
    forms = texts.groupBy(*key).agg(F.sum("__n").alias("__all"), F.min("__least").alias("class_id"), F.count("*").alias("__texts")).filter("__texts > 1")
    texts = join_null_safe(texts, forms.drop("__texts"), key, "inner").withColumn("links", F.col("__all") - F.col("__n")).select(*key, "__text", "class_id", "links")
    return join_null_safe(rows, texts, [*key, "__text"], "inner").select(*scope, "id", "class_id", "links")


def records_of(df: DataFrame, record: str, columns: list[str]) -> DataFrame:
    return once(df.select(record, *columns), record)
