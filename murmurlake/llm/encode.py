"""Encoding of a corpus with a public byte-level BPE vocabulary, by tree concatenation.

Most texts are short and are encoded where they are read: no shuffle, Arrow batches in and out. A text
longer than ``spread_chars`` is cut into parts, the parts become rows that are spread over the cluster and
encoded independently, and each text's parts are put together again in order. Inside a part, unsplit
text longer than ``leaf_chars`` is bisected, its halves are encoded, and every join is repaired.

Why the result equals encoding the text in one go:

* The split pattern is matched left to right without memory and looks one character ahead only in white
  space, so a cut at the end of one of the pattern's own pieces changes no piece if that piece does not end
  with white space, and pieces are encoded separately.
* Where one piece is itself too long the cut falls inside it. A sequence of byte-level BPE tokens is the
  encoding of its bytes exactly if every two neighbours are the encoding of their own bytes. Around such a
  join a window of tokens is encoded again and widened until its first and last token equal the ones that
  were there, so every neighbouring pair is again one that an encoding produced.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The published split pattern of the byte_bpe vocabularies (fixed value).
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the tokenizer's pattern engine has it (the Unicode property White_Space).
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF_CHARS = 1024
SPREAD_CHARS = 16384

_ENCODINGS: dict[str, object] = {}


class PieceEncoder:
    """A vocabulary with exact encoding of whole texts, pieces and joins."""

    def __init__(self, vocabulary: str, leaf_chars: int = LEAF_CHARS):
        import re

        import regex
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.leaf = leaf_chars
        spelled = SPLIT_PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{L}\p{N}" + _BLANK[1:]).replace(r"\s", _BLANK).replace(r"\S", "[^" + _BLANK[1:])
        self.pattern = regex.compile(spelled)
        self.blank = re.compile(_BLANK)
        self.long_stretch = re.compile(r"\S{%d}|\s{%d}" % (leaf_chars + 1, leaf_chars + 1))

    def encode(self, text: str) -> list[int]:
        """The ids of ``text``."""
        if len(text) <= self.leaf or not self.long_stretch.search(text):
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for begin, end, single in self.spans(text, self.leaf):
            ids += self.tree(text[begin:end].encode()) if single else self.encoding.encode_ordinary(text[begin:end])
        return ids

    def spans(self, text: str, size: int) -> Iterator[tuple[int, int, bool]]:
        """Consecutive spans of ``text`` that can be encoded separately; the flag marks a single piece.

        Other spans are closed by the first piece that reaches ``size`` and does not end with white space.
        """
        flat = before = 0
        for m in self.pattern.finditer(text):
            start, end = m.span()
            blank = self.blank.match(text, end - 1)
            if end - start > size:
                if start > flat:
                    # a blank piece right before is a span of its own: at a text's end it would grow
                    if self.blank.match(text, start - 1) and before > flat:
                        yield flat, before, False
                        flat = before
                    yield flat, start, bool(self.blank.match(text, start - 1))
                yield start, end, True
                flat = end
            elif end - flat >= size and not blank:
                yield flat, end, False
                flat = end
            before = start
        if flat < len(text):
            yield flat, len(text), False

    def tree(self, piece: bytes) -> list[int]:
        """The ids of one unsplit piece: both halves, then the join."""
        if len(piece) <= self.leaf:
            return self.encoding.encode_single_piece(piece) if hasattr(self.encoding, "encode_single_piece") else self.encoding._encode_single_piece(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Concatenate two encodings of one piece's halves; the window at the join grows until it agrees."""
        width = 1
        while True:
            a, b = left[-width:], right[:width]
            window = self.encoding._encode_single_piece(b"".join(self.bytes_of[t] for t in [*a, *b]))
            left_agrees = width >= len(left) or (window and window[0] == a[0])
            right_agrees = width >= len(right) or (window and window[-1] == b[-1])
            if left_agrees and right_agrees:
                return left[:-width] + window + right[width:]
            width *= 2

    def parts(self, text: str, size: int) -> Iterator[tuple[bytes, bool]]:
        """Cut ``text`` into parts of about ``size``; the flag says that the part goes on inside a piece."""
        for begin, end, single in self.spans(text, size):
            body = text[begin:end].encode()
            if single and len(body) > size:
                for i in range(0, len(body), size):
                    yield body[i : i + size], i > 0
            else:
                yield body, False


def piece_encoder(vocabulary: str, leaf_chars: int) -> PieceEncoder:
    key = f"{vocabulary}|{leaf_chars}"
    if key not in _ENCODINGS:
        _ENCODINGS[key] = PieceEncoder(vocabulary, leaf_chars)
    return _ENCODINGS[key]


#: Texts that a worker holds as Python strings at a time.
HELD_TEXTS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = HELD_TEXTS) -> Iterator[pa.RecordBatch]:
    """Smaller batches without copying, so that long texts and their results do not pile up in a worker."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _lists(rows: list[list[int]]) -> pa.Array:
    import numpy as np

    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.empty(int(offsets[-1]), dtype=np.int32)
    for i, r in enumerate(rows):
        values[offsets[i] : offsets[i + 1]] = r
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _encode_whole(vocabulary: str, leaf: int, counts_only: bool, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(vocabulary, leaf)
        for batch in slices(batches):
            ids = [encoder.encode(t) if t else [] for t in batch.column("__text").to_pylist()]
            out = pa.array([len(x) for x in ids], type=pa.int64()) if counts_only else _lists(ids)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], out], names=[*keys, "__out"])

    return run


def _cut(vocabulary: str, leaf: int, size: int, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(vocabulary, leaf)
        for batch in batches:
            kept = [batch.column(k) for k in [*keys, "__row"]]
            for i, text in enumerate(batch.column("__text").to_pylist()):
                cut = list(encoder.parts(text, size))
                follows = [f for _, f in cut[1:]] + [False]
                for at in range(0, len(cut), 64):
                    some = cut[at : at + 64]
                    index = pa.array([i] * len(some), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[c.take(index) for c in kept],
                            pa.array(range(at, at + len(some)), pa.int32()),
                            pa.array([b for b, _ in some], pa.binary()),
                            pa.array([f for _, f in some], pa.bool_()),
                            pa.array(follows[at : at + 64], pa.bool_()),
                        ],
                        names=[*keys, "__row", "part", "body", "inside", "more"],
                    )

    return run


def _encode_parts(vocabulary: str, leaf: int, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(vocabulary, leaf)
        for batch in slices(batches):
            bodies, inside, more = (batch.column(c).to_pylist() for c in ("body", "inside", "more"))
            # a part of a piece that was cut is bytes of that piece alone; any other is text
            ids = [encoder.tree(b) if i or m else encoder.encode(b.decode()) for b, i, m in zip(bodies, inside, more)]
            kept = [*keys, "__row", "part", "inside"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], _lists(ids)], names=[*kept, "ids"])

    return run


def _join_parts(vocabulary: str, leaf: int, counts_only: bool, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(vocabulary, leaf)
        for batch in batches:
            out = []
            for parts in batch.column("__parts").to_pylist():
                done: list[int] = []
                piece: list[int] = []
                for p in parts:
                    if p["inside"]:
                        piece = encoder.join(piece, p["ids"])
                    else:
                        done += piece
                        piece = p["ids"]
                out.append(done + piece)
            value = pa.array([len(x) for x in out], type=pa.int64()) if counts_only else _lists(out)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], value], names=[*keys, "__out"])

    return run


def encode_texts(
    df: DataFrame,
    text: str,
    keep: list[str],
    out: str = "ids",
    vocabulary: str = DEFAULT_VOCABULARY,
    leaf_chars: int = LEAF_CHARS,
    spread_chars: int = SPREAD_CHARS,
    counts_only: bool = False,
) -> DataFrame:
    """``keep`` columns of every row with the token ids of its text, or only their number.

    Null and empty texts give an empty list (0 tokens). Rows are kept as they are: repeated rows stay
    repeated, an empty table gives an empty result. Special-token strings inside a text are ordinary text.
    Texts longer than ``spread_chars`` are cut, spread over the cluster and joined exactly. ``vocabulary``
    is a path that every executor can read. ``keep`` columns may have any names, also ``text`` or ``out``'s.
    """
    if out in keep:
        raise ValueError(f"the result column {out!r} clashes with a kept column")
    k = [f"__k{i}" for i in range(len(keep))]
    src = df.select(*[F.col(c).alias(a) for c, a in zip(keep, k)], F.col(text).alias("__text"))
    fields = ", ".join(f"{a} {src.schema[a].dataType.simpleString()}" for a in k)
    kind = "bigint" if counts_only else "array<int>"
    is_long = F.coalesce(F.length("__text") > spread_chars, F.lit(False))
    schema = f"{fields}, __out {kind}" if k else f"__out {kind}"
    short = src.filter(~is_long).mapInArrow(_encode_whole(vocabulary, leaf_chars, counts_only, k), schema)
    long = src.filter(is_long).withColumn("__row", F.monotonically_increasing_id())
    head = f"{fields}, __row bigint" if k else "__row bigint"
    parts = long.mapInArrow(_cut(vocabulary, leaf_chars, spread_chars, k), f"{head}, part int, body binary, inside boolean, more boolean")
    coded = parts.repartition("__row", "part").mapInArrow(_encode_parts(vocabulary, leaf_chars, k), f"{head}, part int, inside boolean, ids array<int>")
    whole = coded.groupBy("__row").agg(*[F.first(a).alias(a) for a in k], F.array_sort(F.collect_list(F.struct("part", "inside", "ids"))).alias("__parts"))
    joined = whole.drop("__row").mapInArrow(_join_parts(vocabulary, leaf_chars, counts_only, k), schema)
    both = short.unionByName(joined)
    return both.select(*[F.col(a).alias(c) for a, c in zip(k, keep)], F.col("__out").alias(out))
