"""Cutting oversized word lists at natural boundaries, with overlap.

Two plans share the boundary strengths (2 sentence end, 1 clause end, 0 neither):

* ``cut_by_bisection``: cut at the strongest boundary nearest the midpoint, and go on with every half that
  still exceeds the limit less the overlap; then give every piece but the first its overlap.
* ``cut_longest``: each piece runs as far as it can: to the last sentence end within the limit, else the
  last clause end, else the limit. Where one piece ends decides where the next begins, so this result is
  a chain from the left and bisection at midpoints cannot give it.

Items are independent: the cuts are found where the rows are read, in Arrow batches with vectorised
boundary tests, and only piece positions are shuffled to drop repeated items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Left off a word's end before its last character is looked at, and the closing characters (fixed values).
CLOSERS = "\"')]}”’»"
SENTENCE = ".?!…"
CLAUSE = ",;:"

LIMIT = 200
OVERLAP = 20


def strengths(words: pa.Array) -> np.ndarray:
    """2 for words that close a sentence, 1 for a clause, 0 for others and nulls."""
    last = pc.utf8_slice_codeunits(pc.utf8_rtrim(pc.fill_null(words, ""), characters=CLOSERS), start=-1)
    sentence = pc.is_in(last, value_set=pa.array(list(SENTENCE)))
    clause = pc.is_in(last, value_set=pa.array(list(CLAUSE)))
    return np.where(sentence.to_numpy(zero_copy_only=False), 2, np.where(clause.to_numpy(zero_copy_only=False), 1, 0)).astype(np.int8)


def cut_longest(strength: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Inclusive (first, last) positions of the pieces of one item, overlap included."""
    n = len(strength)
    at = {level: np.flatnonzero(strength == level) for level in (2, 1)}
    pieces: list[tuple[int, int]] = []
    start, end = 0, -1
    while n - start > limit:
        # a cut leaves more than the overlap and goes beyond the former piece
        lowest, highest = max(start + overlap, end + 1), start + limit - 1
        cut = highest
        for level in (2, 1):
            i = int(np.searchsorted(at[level], highest, side="right")) - 1
            if i >= 0 and at[level][i] >= lowest:
                cut = int(at[level][i])
                break
        pieces.append((start, cut))
        start, end = cut + 1 - overlap, cut
    pieces.append((start, n - 1))
    return pieces


def cut_by_bisection(strength: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Inclusive (first, last) positions of the pieces of one item, overlap included.

    A boundary counts as near the midpoint if it lies in the middle half, so the depth is logarithmic. Ties
    in distance go to the earlier boundary.
    """
    room = limit - overlap
    cores: list[tuple[int, int]] = []
    todo = [(0, len(strength) - 1)]
    while todo:
        lo, hi = todo.pop()
        size = hi - lo + 1
        if size <= room or (lo == 0 and size <= limit and hi == len(strength) - 1):
            cores.append((lo, hi))
            continue
        middle = lo + size // 2 - 1
        quarter = max(1, size // 4)
        a, b = max(lo, middle - quarter), min(hi - 1, middle + quarter)
        near = strength[a : b + 1]
        best = np.flatnonzero(near == near.max()) + a if near.max() > 0 else np.array([middle])
        cut = int(best[np.argmin(np.abs(best - middle))])
        todo += [(cut + 1, hi), (lo, cut)]
    return [(max(0, lo - overlap) if lo else 0, hi) for lo, hi in cores]


def _cutter(cut: Callable, limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten()
            strength = strengths(values.field("word"))
            gi = pc.fill_null(values.field("gi"), -1).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(sizes)])
            ids, no, first, last, lo, hi = [], [], [], [], [], []
            for i, request in enumerate(batch.column("__id").to_pylist()):
                mine, places = strength[at[i] : at[i + 1]], gi[at[i] : at[i + 1]]
                for k, (a, b) in enumerate(cut(mine, limit, overlap)):
                    ids.append(request)
                    no.append(k + 1)
                    lo.append(a)
                    hi.append(b)
                    first.append(int(places[a]))
                    last.append(int(places[b]))
            kind = batch.schema.field("__id").type
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), *[pa.array(c, pa.int32()) for c in (no, first, last, lo, hi)]],
                names=["__id", "piece_no", "first_gi", "last_gi", "first_at", "last_at"],
            )

    return run


def cut_items(df: DataFrame, item: str, words: str = "words", limit: int = LIMIT, overlap: int = OVERLAP, method: str = "longest") -> DataFrame:
    """Pieces of every item with more than ``limit`` words: item, piece_no, first_gi, last_gi, first_at, last_at.

    ``words`` is ``array<struct<gi:int, word:string>>`` in order; ``first_at`` and ``last_at`` are 0-based
    places in it. Items with a null, empty or short list have no rows; null words close nothing; repeated
    rows of an item give its pieces once; items with a null id are left out.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    cut = {"longest": cut_longest, "bisection": cut_by_bisection}[method]
    big = df.select(F.col(item).alias("__id"), F.col(words).alias("words")).filter(F.col("__id").isNotNull() & (F.size("words") > limit))
    kind = big.schema["__id"].dataType.simpleString()
    out = big.mapInArrow(_cutter(cut, limit, overlap), f"__id {kind}, piece_no int, first_gi int, last_gi int, first_at int, last_at int")
    return out.distinct().withColumnRenamed("__id", item)


def with_surroundings(pieces: DataFrame, df: DataFrame, item: str, width: int) -> DataFrame:
    """Add ``text``, ``before`` and ``after`` to pieces: the words right around each piece.

    The first piece keeps the item's own ``before``, the last its ``after``; inside the item they are the up
    to ``width`` words before the piece and after it.
    """
    rows = df.select(F.col(item), "words", "before", "after").dropDuplicates([item])
    word = F.transform("words", lambda w: F.coalesce(w["word"], F.lit("")))
    size = F.col("last_at") - F.col("first_at") + 1
    lead = F.greatest(F.col("first_at") - width, F.lit(0))
    before = F.array_join(F.slice("__w", lead + 1, F.col("first_at") - lead), " ")
    after = F.array_join(F.slice("__w", F.col("last_at") + 2, F.lit(width)), " ")
    joined = pieces.join(rows, item).withColumn("__w", word)
    return joined.select(
        *pieces.columns,
        F.array_join(F.slice("__w", F.col("first_at") + 1, size), " ").alias("text"),
        F.when(F.col("first_at") == 0, F.col("before")).otherwise(before).alias("before"),
        F.when(F.col("last_at") == F.size("__w") - 1, F.col("after")).otherwise(after).alias("after"),
    )
