"""An edited cue text as word edits of the original: what was replaced by what, and where."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_WORD = re.compile(r"\S+")


def word_edits(old: str, new: str) -> list[tuple[int, int, str]]:
    """(start, end, written) on ``old``'s characters, in order, half-open, never touching.

    Writing them all gives ``new`` but for blanks: words are compared, the blanks between kept words stay.
    An insertion takes the word before it along (the word after it at the text's start), so every edit has
    a word to stand on.
    """
    a, b = list(_WORD.finditer(old)), list(_WORD.finditer(new))
    if not a:
        return [(0, len(old), new)] if b else []
    spans: list[list[int]] = []
    for tag, i0, i1, j0, j1 in difflib.SequenceMatcher(None, [m.group() for m in a], [m.group() for m in b], autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        if i0 == i1:
            if i0:
                i0, j0 = i0 - 1, j0 - 1
            else:
                i1, j1 = i1 + 1, j1 + 1
        if spans and spans[-1][1] >= i0:
            spans[-1][1], spans[-1][3] = max(i1, spans[-1][1]), max(j1, spans[-1][3])
        else:
            spans.append([i0, i1, j0, j1])
    return [(a[i0].start(), a[i1 - 1].end(), new[b[j0].start() : b[j1 - 1].end()] if j1 > j0 else "") for i0, i1, j0, j1 in spans]


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, written in edits:
        out += [text[at:start], written]
        at = end
    return "".join([*out, text[at:]])


EDITS = "id bigint, edit_no int, start int, end int, written string"


def edits_of(df: DataFrame, record: str, old: str, new: str) -> DataFrame:
    """id, edit_no, start, end, written for every edited record; unchanged ones and nulls have no row."""
    rows = df.selectExpr(f"CAST(`{record}` AS BIGINT) AS id", f"`{old}` AS old", f"`{new}` AS new").filter("old IS NOT NULL AND new IS NOT NULL AND old <> new")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(i, n, *e) for i, o, w in zip(pdf["id"], pdf["old"], pdf["new"]) for n, e in enumerate(word_edits(o, w))]
            yield pd.DataFrame(out, columns=["id", "edit_no", "start", "end", "written"])

    return rows.mapInPandas(run, EDITS)
