"""Pages of repeated keywords, bare links and product tags.

One pass over the texts takes from each page, with no shuffle of text:

* the frequencies of its terms as a histogram (how many terms occur k times), from which SQL windows fit
  the page's rank-frequency curve: slope, residual, and divergence of the curve from that of pages of the
  same language and comparable length;
* a digest of its lines, where links, tags or repeated words could fill half of the characters. Any other
  page is prose (or code, or data) and vouches for its word pairs: they are folded as hashes. A page that
  could be spam vouches for nothing, so a spam page stays spam however often it was copied;
* of pages that could be spam, the word pairs that they repeat.

A page is scored by its curve (slope, residual and divergence as deviations from the median of its language
and length octave, in quartile deviations, so that spam does not shift what it is measured by) and by
``foreign``, the divergence in the head of its pair curve: the share of its word pairs that it repeats and
that no prose has. It is extreme if one of the four is. An exact check of extreme pages follows: more than
half of the characters must lie in lines of bare links, of tags and product marks, or of keywords. A keyword
line consists of words the page repeats, put together in ways that hardly any prose has.

A pair is familiar if at least ``FAMILIAR_SHARE`` of all pages have it as prose; the share is the same for
any number of pages. At most ``mean number of pairs per page / FAMILIAR_SHARE`` pairs can be familiar;
whether they are broadcast is left to adaptive execution, which knows their size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.llm.encode import slices
from murmurlake.session import materialise, scratch_table

#: A pair of words is familiar if at least this share of all pages has it.
FAMILIAR_SHARE = 0.0008
#: ... and a line is a keyword line if less than this share of its pairs is familiar
FAMILIAR_PAIRS = 0.25
#: and at least this share of its words occurs at least REPEATED times on the page.
REPEATED_WORDS = 0.5
REPEATED = 3
#: A curve is extreme if it lies this many quartile deviations off its cell's median (slope: to either
#: side), or if this share of the page's word pairs is repeated and foreign to prose.
DEVIATIONS = 3.0
FOREIGN = 0.04
#: The least deviations a cell is taken to have, so that a cell of equal pages has a scale.
LEAST = {"slope": 0.02, "residual": 0.01, "divergence": 0.02}
#: Octaves of ranks that curves are compared by; the last one takes all further ranks.
BINS = 16
#: The share of characters beyond which a page is spam.
HALF = 0.5
#: Words a bare link may have as its title.
TITLE_WORDS = 4

_CJK = "\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"
_W = rf"(?:[{_CJK}]+|[^\W\d_{_CJK}]+)"
WORD = re.compile(_W)
URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]|]+")
_LINK_MARKUP = re.compile(r"<a\s+href=|</?a>|\[/?url=?|rel=\w+|href=|target=\S+")
_STRUCTURE = re.compile(r"[{}]|\":|=\s*\"|\w\(")
_EXPLAINED = re.compile(r"#\d|[。！？]")
_TAG_LINE = re.compile(r">>.*<<|^[-*]?\s*tags?\s*:|^(?:#\w[\w-]*[\s,]*)+$", re.IGNORECASE)
_META = re.compile(r"<meta[^>]*keywords[^>]*content=\"([^\"]*)\"", re.IGNORECASE)
_TAGS = re.compile(r"<[^<>]*>|\[/?url[^\]]*\]")
_MARKER = re.compile(r"^\s*(?:#+|//+|/\*+|\*+/?|--+|<!--|;+|%+|>+|[-+•]|\d+[.):](?=\s)|\"\"\"|')?\s*")
_CODE = re.compile(r"[=(){}\[\]\\]|\w:\s|->|::|\d\d:\d\d")
_DIGITS = re.compile(r"\d+")
_IDEOGRAPH = re.compile(rf"[{_CJK}]")


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs from the unsigned hashes of their words; the second is 0 for a word alone."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def line_pairs(hashes: list[int]) -> np.ndarray:
    """Pair hashes of the words of a line, or of its only word."""
    h = np.array(hashes, dtype=np.uint64)
    return mix(h[:-1], h[1:]) if len(h) > 1 else mix(h, np.zeros_like(h))


def line_kind(line: str) -> tuple[str, list[str]]:
    """'link', 'tag', 'other', or 'words' with the words of a line that has nothing but words."""
    if "://" in line or "www." in line:
        urls = URL.findall(line)
        rest = _LINK_MARKUP.sub(" ", URL.sub(" ", line))
        if _STRUCTURE.search(rest):
            return "other", []
        n = len(urls)
        bare = len(WORD.findall(rest)) <= TITLE_WORDS * n and len(_IDEOGRAPH.findall(rest)) <= 14 * n and not _EXPLAINED.search(rest)
        return ("link" if bare else "other"), []
    if (">>" in line or line[0] in "#-*tT") and _TAG_LINE.search(line):
        return "tag", []
    if "<" in line:
        meta = _META.search(line)
        line = meta.group(1) if meta else _TAGS.sub(" ", line)
    body = line[_MARKER.match(line).end() :]
    if _CODE.search(body):
        return "other", []
    words = WORD.findall(body.lower())
    if not words or len(_DIGITS.findall(body)) > len(words):
        return "other", []
    return "words", words


def digest(text: str, repeated: set[str]) -> tuple[int, int, list[tuple[int, list[str]]]] | None:
    """(characters, sure spam characters, keyword-line candidates) or None if half cannot be reached.

    Every line is looked at, until the lines left over could not make up half even if all of them were spam.
    """
    stripped = [line for line in map(str.strip, text.splitlines()) if line]
    total = left = sum(map(len, stripped))
    half = HALF * total
    sure = maybe = 0
    lines = []
    for line in stripped:
        if sure + maybe + left <= half:
            return None
        size = len(line)
        left -= size
        kind, words = line_kind(line)
        if kind == "words":
            if sum(map(repeated.__contains__, words)) >= REPEATED_WORDS * len(words):
                maybe += size
                lines.append((size, words))
        elif kind != "other":
            sure += size
    return (total, sure, lines) if sure + maybe > half else None


_PAGE = pa.schema(
    [
        ("page", pa.int64()),
        ("doc_id", pa.int64()),
        ("lang", pa.string()),
        ("tokens", pa.int64()),
        ("freqs", pa.list_(pa.int32())),
        ("terms", pa.list_(pa.int32())),
        ("chars", pa.int64()),
        ("sure", pa.int64()),
        ("lines", pa.list_(pa.struct([("size", pa.int32()), ("pairs", pa.list_(pa.int64()))]))),
        ("heads", pa.list_(pa.int64())),
        ("times", pa.list_(pa.int32())),
        ("hashes", pa.list_(pa.int64())),
        ("pages", pa.list_(pa.int32())),
    ]
)
#: Pair hashes that a worker folds at a time before it hands them on.
FOLD_PAIRS = 1_000_000


class _Fold:
    """Pair hashes of prose pages with the number of pages each was seen on, folded as they come."""

    def __init__(self) -> None:
        self.hashes, self.pages, self.fresh, self.n = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, pairs: np.ndarray) -> bool:
        """Take pairs, each once for every page; True if it is time to hand on."""
        self.fresh.append(pairs)
        self.n += len(pairs)
        if self.n >= FOLD_PAIRS:
            self._merge()
        return len(self.hashes) >= FOLD_PAIRS

    def _merge(self) -> None:
        every = np.concatenate([self.hashes, *self.fresh])
        weight = np.concatenate([self.pages, np.ones(len(every) - len(self.hashes), np.int64)])
        self.hashes, at = np.unique(every, return_inverse=True)
        self.pages = np.bincount(at, weight, len(self.hashes)).astype(np.int64)
        self.fresh, self.n = [], 0

    def row(self) -> pa.RecordBatch:
        self._merge()
        found = {"hashes": [self.hashes.view(np.int64)], "pages": [self.pages.astype(np.int32)]}
        out = pa.RecordBatch.from_arrays([pa.array(found.get(f.name, [None]), f.type) for f in _PAGE], schema=_PAGE)
        self.__init__()
        return out


def _lists(page: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """One list for each of ``n`` pages; ``page`` is sorted."""
    offsets = np.searchsorted(page, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold = _Fold()
    for batch in slices(batches):
        n = batch.num_rows
        texts = batch.column("text").to_pylist()
        found = [WORD.findall(t.lower()) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, n)
        coded = pa.array(list(chain.from_iterable(found)), pa.large_string()).dictionary_encode()
        ids, vocabulary = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        hashes = np.fromiter(map(word_hash, vocabulary), np.uint64, len(vocabulary))
        hash_of = dict(zip(vocabulary, hashes.tolist()))
        page = np.repeat(np.arange(n), sizes)
        # occurrences of every term of every page, then terms by occurrences
        term, times = np.unique(page * max(1, len(vocabulary)) + ids, return_counts=True)
        owner, word = np.divmod(term, max(1, len(vocabulary)))
        step = int(times.max(initial=0)) + 1
        level, terms = np.unique(owner * step + (step - 1 - times), return_counts=True)
        curve_page, freqs = np.divmod(level, step)
        often = times >= REPEATED
        bounds = np.searchsorted(owner[often], np.arange(n + 1))
        repeated = [vocabulary[w] for w in word[often].tolist()]
        judged = [digest(t, set(repeated[bounds[i] : bounds[i + 1]])) for i, t in enumerate(texts)]
        open_ = np.fromiter((j is not None for j in judged), bool, n)
        # every pair of every page with its occurrences; ideographs have no blanks between words, so their runs count alone
        h = hashes[ids]
        same = page[1:] == page[:-1]
        pairs, pair_page = mix(h[:-1][same], h[1:][same]), page[1:][same]
        alone = np.fromiter((bool(_IDEOGRAPH.match(w)) for w in vocabulary), bool, len(vocabulary))[ids]
        pairs, pair_page = np.concatenate([pairs, mix(h[alone], np.zeros_like(h[alone]))]), np.concatenate([pair_page, page[alone]])
        _, first, seen = np.unique(pairs ^ (pair_page.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), return_index=True, return_counts=True)
        first_page = pair_page[first]
        head = open_[first_page] & (seen >= 2)
        by_page = np.flatnonzero(head)[np.argsort(first_page[head], kind="stable")]
        lines = [None if j is None else [{"size": s, "pairs": line_pairs([hash_of.get(w) or word_hash(w) for w in ws]).view(np.int64)} for s, ws in j[2]] for j in judged]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page"), batch.column("doc_id"), batch.column("lang"), pa.array(sizes),
                _lists(curve_page, step - 1 - freqs, n, pa.int32()), _lists(curve_page, terms, n, pa.int32()),
                pa.array([j and j[0] for j in judged], pa.int64()), pa.array([j and j[1] for j in judged], pa.int64()), pa.array(lines, _PAGE.field("lines").type),
                _lists(first_page[by_page], pairs[first[by_page]].view(np.int64), n, pa.int64()), _lists(first_page[by_page], seen[by_page], n, pa.int32()),
                pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())),
            ],
            schema=_PAGE,
        )
        if fold.add(pairs[first[~open_[first_page]]]):
            yield fold.row()
    yield fold.row()


_DDL = (
    "page bigint, doc_id bigint, lang string, tokens bigint, freqs array<int>, terms array<int>, chars bigint, sure bigint, "
    "lines array<struct<size:int,pairs:array<bigint>>>, heads array<bigint>, times array<int>, hashes array<bigint>, pages array<int>"
)


def scan_pages(df: DataFrame, doc: str, text: str, lang: str) -> DataFrame:
    """The one pass over the texts, written to the shared folder: page rows, numbered by ``page``, and rows of
    folded word pairs (``page`` is null).

    Pages with a null or empty text or a null id have no row.
    """
    src = df.select(F.col(doc).cast("bigint").alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.col(text).alias("text"))
    src = src.filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)).withColumn("page", F.monotonically_increasing_id())
    path = scratch_table(df.sparkSession, "spam-pages")
    src.mapInArrow(_scan, _DDL).write.parquet(path)
    return df.sparkSession.read.schema(_DDL).parquet(path)


def curves(scanned: DataFrame) -> DataFrame:
    """Per page: slope and residual of its rank-frequency curve (logarithms, ties at their mean rank), the
    divergence of its token shares over rank octaves from the median page of its language and length octave,
    and each of the three in quartile deviations from the cell's median (``slope_off``, ...).

    A page's ranks, sums and shares take one shuffle; everything else is over one short row a page.
    """
    groups = scanned.filter(F.col("tokens") > 0).select(
        "page", "doc_id", "lang", "tokens", F.floor(F.log2("tokens")).alias("octave"), F.inline(F.arrays_zip(F.col("freqs").alias("n"), F.col("terms").alias("m")))
    )
    upto = Window.partitionBy("page").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = groups.withColumn("rank", F.sum("m").over(upto) - (F.col("m") - 1) / 2).withColumns({"x": F.ln("rank"), "y": F.ln("n")})
    m, x, y = F.col("m"), F.col("x"), F.col("y")
    octave = F.least(F.floor(F.log2("rank")), F.lit(BINS - 1))
    fit = ranked.groupBy("page", "doc_id", "lang", "tokens", "octave").agg(
        F.sum(m).alias("w"), F.sum(m * x).alias("sx"), F.sum(m * y).alias("sy"), F.sum(m * x * x).alias("sxx"), F.sum(m * x * y).alias("sxy"), F.sum(m * y * y).alias("syy"),
        *[F.sum(F.when(octave == i, F.col("n") * m).otherwise(0)).alias(f"b{i}") for i in range(BINS)],
    )
    vx, vy, vxy = (F.col(s) - F.col(a) * F.col(b) / F.col("w") for s, a, b in (("sxx", "sx", "sx"), ("syy", "sy", "sy"), ("sxy", "sx", "sy")))
    fit = fit.withColumn("slope", F.when(vx > 1e-9, vxy / vx).otherwise(F.lit(0.0)))
    fit = fit.withColumn("residual", F.sqrt(F.greatest(F.lit(0.0), (vy - F.col("slope") * vxy) / F.col("w"))))
    fit = materialise(fit.select("page", "doc_id", "lang", "octave", "slope", "residual", F.array(*[F.col(f"b{i}") / F.col("tokens") for i in range(BINS)]).alias("shares")))
    cell = ["lang", "octave"]

    def quartiles(c: str):
        return F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"{c}_q")

    # one row a cell, written so that its size is known
    typical = materialise(fit.groupBy(*cell).agg(F.array(*[F.percentile_approx(F.col("shares")[i], 0.5, 1000) for i in range(BINS)]).alias("q"), quartiles("slope"), quartiles("residual")))
    # what the medians leave at 0 keeps a small share
    typical = typical.withColumn("q", F.transform("q", lambda v: v + 1e-3)).withColumn("__sum", F.aggregate("q", F.lit(0.0), lambda acc, v: acc + v))
    gap = F.zip_with("shares", "q", lambda p, q: F.when(p > 0, p * F.ln(p * F.col("__sum") / q)).otherwise(F.lit(0.0)))
    out = fit.join(typical, cell).withColumn("divergence", F.aggregate(gap, F.lit(0.0), lambda acc, v: acc + v)).drop("q", "__sum", "shares")
    out = out.join(materialise(out.groupBy(*cell).agg(quartiles("divergence"))), cell)
    for c, least in LEAST.items():
        q = F.col(f"{c}_q")
        out = out.withColumn(f"{c}_off", (F.col(c) - q[1]) / F.greatest((q[2] - q[0]) / 2, F.lit(least)))
    return out.drop(*[f"{c}_q" for c in LEAST])


def familiar_pairs(scanned: DataFrame, share: float = FAMILIAR_SHARE) -> DataFrame:
    """Hashes of the word pairs that at least ``share`` of all pages have as prose."""
    pages = scanned.filter(F.col("page").isNotNull()).agg(F.count("*")).scalar()
    each = scanned.filter(F.col("page").isNull()).select(F.inline(F.arrays_zip(F.col("hashes").alias("pair"), F.col("pages").alias("k"))))
    return each.groupBy("pair").agg(F.sum("k").alias("k")).filter(F.col("k") >= share * pages).select("pair")


def line_shares(scanned: DataFrame) -> DataFrame:
    """Of every page that could be spam: ``share``, of its characters in spam lines, and ``foreign``, of its
    word pairs that it repeats and that are not familiar."""
    pages = scanned.filter(F.col("chars").isNotNull())
    lines = pages.select("page", F.posexplode("lines").alias("line", "l")).select("page", "line", "l.size", F.lit(1).alias("k"), F.explode("l.pairs").alias("pair"))
    heads = pages.select("page", F.lit(-1).alias("line"), F.lit(0).alias("size"), F.inline(F.arrays_zip(F.col("times").alias("k"), F.col("heads").alias("pair"))))
    known = familiar_pairs(scanned).withColumn("known", F.lit(1))
    judged = lines.unionByName(heads).join(known, "pair", "left").groupBy("page", "line").agg(F.first("size").alias("size"), F.sum("k").alias("pairs"), F.sum(F.col("k") * F.col("known")).alias("known"))
    new = F.col("pairs") - F.coalesce("known", F.lit(0))
    keyed = F.when((F.col("line") >= 0) & (F.col("pairs") - new < FAMILIAR_PAIRS * F.col("pairs")), F.col("size"))
    per = judged.groupBy("page").agg(F.sum(keyed).alias("keyed"), F.sum(F.when(F.col("line") < 0, new)).alias("new"))
    share = (F.col("sure") + F.coalesce("keyed", F.lit(0))) / F.col("chars")
    return pages.select("page", "chars", "sure", "tokens").join(per, "page", "left").select("page", share.alias("share"), F.coalesce(F.try_divide("new", F.col("tokens") - 1), F.lit(0.0)).alias("foreign"))


def scored(scanned: DataFrame) -> DataFrame:
    """``curves`` with ``foreign``, ``share`` (both null for a page that cannot be spam) and ``is_extreme``.

    A page without any word has no curve to be ordinary: it is extreme.
    """
    odd = F.abs("slope_off") >= DEVIATIONS
    for c in ("residual", "divergence"):
        odd = odd | (F.col(f"{c}_off") >= DEVIATIONS)
    odd = odd | (F.coalesce("foreign", F.lit(0.0)) >= FOREIGN)
    wordless = scanned.filter("tokens = 0").select("page", "doc_id", "lang")
    both = curves(scanned).unionByName(wordless, allowMissingColumns=True).join(line_shares(scanned), "page", "left")
    return both.withColumn("is_extreme", F.coalesce(odd, F.lit(True)))


def find_spam(df: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Ids of spam pages: an extreme score, and more than half of the characters in spam lines.

    Null and empty texts are no spam; a null language is a language of its own; rows repeated under one id
    are judged one by one and come out once. Other columns, whatever their names, are ignored.
    """
    spam = scored(scan_pages(df, doc, text, lang)).filter(F.col("is_extreme") & (F.col("share") > HALF))
    return spam.select(F.col("doc_id").alias(doc)).distinct()
