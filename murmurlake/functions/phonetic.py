"""Sound codes and string similarity.

Both run in Python, in Arrow batches, and only ever over distinct words or distinct pairs: words follow
Zipf's law, so that is a small part of all tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler(a: str, b: str) -> float:
    """Similarity by the published formula: prefixes of up to 4 count 0.1 each if the Jaro value is above 0.7."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    matched = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                matched.append(ch)
                break
    m = len(matched)
    if not m:
        return 0.0
    other = [ch for ch, f in zip(b, free) if not f]
    swaps = sum(x != y for x, y in zip(matched, other)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


_VOWELS = frozenset("AEIOUY")
_GERMANIC = ("VAN ", "VON ", "SCH")
#: Letters whose code depends on nothing but themselves and doubling (fixed values).
_PLAIN = {"B": "P", "F": "F", "K": "K", "L": "L", "M": "M", "N": "N", "Q": "K", "R": "R", "V": "F", "Ç": "S", "Ñ": "N"}


class _Coder:
    """One word on its way to its two codes (Lawrence Philips' Double Metaphone, 2000)."""

    def __init__(self, word: str):
        self.w = word
        self.n = len(word)
        self.one: list[str] = []
        self.two: list[str] = []
        self.slavic = any(x in word for x in ("W", "K", "CZ", "WITZ"))

    def at(self, i: int, *options: str) -> bool:
        return i >= 0 and any(self.w.startswith(o, i) for o in options if i + len(o) <= self.n)

    def ch(self, i: int) -> str:
        return self.w[i] if 0 <= i < self.n else ""

    def add(self, one: str, two: str | None = None) -> None:
        self.one.append(one)
        self.two.append(one if two is None else two)

    def run(self) -> tuple[str, str]:
        i = 0
        if self.at(0, "GN", "KN", "PN", "WR", "PS"):
            i = 1
        if self.ch(0) == "X":
            self.add("S")
            i = 1
        while i < self.n:
            c = self.ch(i)
            if c in _VOWELS:
                if i == 0:
                    self.add("A")
                i += 1
            elif c in _PLAIN:
                self.add(*self.doubled_l(i) if c == "L" else (_PLAIN[c],))
                i += 2 if self.ch(i + 1) == c and c != "Ç" else 1
                if c == "M" and self.at(i - 2, "UMB") and (i == self.n - 1 or self.at(i + 1, "ER")):
                    i += 1
            else:
                step = getattr(self, f"on_{c.lower()}", None) if c.isascii() else None
                i += step(i) if step else 1
        return "".join(self.one), "".join(self.two)

    def doubled_l(self, i: int) -> tuple[str, ...]:
        spanish = (i == self.n - 3 and self.at(i - 1, "ILLO", "ILLA", "ALLE")) or ((self.w.endswith(("AS", "OS", "A", "O"))) and self.at(i - 1, "ALLE"))
        return ("L", "") if self.ch(i + 1) == "L" and spanish else ("L",)

    def on_c(self, i: int) -> int:
        if i > 1 and self.ch(i - 2) not in _VOWELS and self.at(i - 1, "ACH") and self.ch(i + 2) != "I" and (self.ch(i + 2) != "E" or self.at(i - 2, "BACHER", "MACHER")):
            self.add("K")
            return 2
        if i == 0 and self.at(i, "CAESAR"):
            self.add("S")
            return 2
        if self.at(i, "CHIA"):
            self.add("K")
            return 2
        if self.at(i, "CH"):
            if i > 0 and self.at(i, "CHAE"):
                self.add("K", "X")
            elif i == 0 and self.at(i + 1, "HARAC", "HARIS", "HOR", "HYM", "HIA", "HEM") and not self.at(0, "CHORE"):
                self.add("K")
            elif self.at(0, *_GERMANIC) or self.at(i - 2, "ORCHES", "ARCHIT", "ORCHID") or self.at(i + 2, "T", "S") or ((self.at(i - 1, "A", "O", "U", "E") or i == 0) and (self.at(i + 2, "L", "R", "N", "M", "B", "H", "F", "V", "W") or i + 2 >= self.n)):
                self.add("K")
            elif i > 0:
                self.add("K") if self.at(0, "MC") else self.add("X", "K")
            else:
                self.add("X")
            return 2
        if self.at(i, "CZ") and not self.at(i - 2, "WICZ"):
            self.add("S", "X")
            return 2
        if self.at(i + 1, "CIA"):
            self.add("X")
            return 3
        if self.at(i, "CC") and not (i == 1 and self.ch(0) == "M"):
            if self.at(i + 2, "I", "E", "H") and not self.at(i + 2, "HU"):
                self.add("KS") if (i == 1 and self.ch(0) == "A") or self.at(i - 1, "UCCEE", "UCCES") else self.add("X")
                return 3
            self.add("K")
            return 2
        if self.at(i, "CK", "CG", "CQ"):
            self.add("K")
            return 2
        if self.at(i, "CI", "CE", "CY"):
            self.add("S", "X") if self.at(i, "CIO", "CIE", "CIA") else self.add("S")
            return 2
        self.add("K")
        if self.at(i + 1, " C", " Q", " G"):
            return 3
        return 2 if self.at(i + 1, "C", "K", "Q") and not self.at(i + 1, "CE", "CI") else 1

    def on_d(self, i: int) -> int:
        if self.at(i, "DG"):
            if self.at(i + 2, "I", "E", "Y"):
                self.add("J")
                return 3
            self.add("TK")
            return 2
        self.add("T")
        return 2 if self.at(i, "DT", "DD") else 1

    def on_g(self, i: int) -> int:
        nxt = self.ch(i + 1)
        if nxt == "H":
            if i > 0 and self.ch(i - 1) not in _VOWELS:
                self.add("K")
            elif i == 0:
                self.add("J") if self.ch(2) == "I" else self.add("K")
            elif self.at(i - 2, "B", "H", "D") or self.at(i - 3, "B", "H", "D") or self.at(i - 4, "B", "H"):
                pass
            elif i > 2 and self.ch(i - 1) == "U" and self.at(i - 3, "C", "G", "L", "R", "T"):
                self.add("F")
            elif i > 0 and self.ch(i - 1) != "I":
                self.add("K")
            return 2
        if nxt == "N":
            if i == 1 and self.ch(0) in _VOWELS and not self.slavic:
                self.add("KN", "N")
            elif not self.at(i + 2, "EY") and self.ch(i + 1) != "Y" and not self.slavic:
                self.add("N", "KN")
            else:
                self.add("KN")
            return 2
        if self.at(i + 1, "LI") and not self.slavic:
            self.add("KL", "L")
            return 2
        if i == 0 and (nxt == "Y" or self.at(1, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
            self.add("K", "J")
            return 2
        if (self.at(i + 1, "ER") or nxt == "Y") and not self.at(0, "DANGER", "RANGER", "MANGER") and not self.at(i - 1, "E", "I", "RGY", "OGY"):
            self.add("K", "J")
            return 2
        if nxt in ("E", "I", "Y") or self.at(i - 1, "AGGI", "OGGI"):
            if self.at(0, *_GERMANIC) or self.at(i + 1, "ET"):
                self.add("K")
            elif self.w.endswith("IER") and i + 4 == self.n:
                self.add("J")
            else:
                self.add("J", "K")
            return 2
        self.add("K")
        return 2 if nxt == "G" else 1

    def on_h(self, i: int) -> int:
        if (i == 0 or self.ch(i - 1) in _VOWELS) and self.ch(i + 1) in _VOWELS and self.ch(i + 1):
            self.add("H")
            return 2
        return 1

    def on_j(self, i: int) -> int:
        if self.at(i, "JOSE") or self.at(0, "SAN "):
            self.add("H") if (i == 0 and self.ch(i + 4) in ("", " ")) or self.at(0, "SAN ") else self.add("J", "H")
            return 1
        if i == 0:
            self.add("J", "A")
        elif self.ch(i - 1) in _VOWELS and not self.slavic and self.ch(i + 1) in ("A", "O"):
            self.add("J", "H")
        elif i == self.n - 1:
            self.add("J", "")
        elif not self.at(i + 1, "L", "T", "K", "S", "N", "M", "B", "Z") and not self.at(i - 1, "S", "K", "L"):
            self.add("J")
        return 2 if self.ch(i + 1) == "J" else 1

    def on_p(self, i: int) -> int:
        if self.ch(i + 1) == "H":
            self.add("F")
            return 2
        self.add("P")
        return 2 if self.ch(i + 1) in ("P", "B") and self.ch(i + 1) else 1

    def on_s(self, i: int) -> int:
        if self.at(i - 1, "ISL", "YSL"):
            return 1
        if i == 0 and self.at(0, "SUGAR"):
            self.add("X", "S")
            return 1
        if self.at(i, "SH"):
            self.add("S") if self.at(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else self.add("X")
            return 2
        if self.at(i, "SIO", "SIA"):
            self.add("S") if self.slavic else self.add("S", "X")
            return 3
        if (i == 0 and self.at(1, "M", "N", "L", "W")) or self.ch(i + 1) == "Z":
            self.add("S", "X")
            return 2 if self.ch(i + 1) == "Z" else 1
        if self.at(i, "SC"):
            if self.ch(i + 2) == "H":
                if self.at(i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                    self.add("X", "SK") if self.at(i + 3, "ER", "EN") else self.add("SK")
                elif i == 0 and self.ch(3) not in _VOWELS and self.ch(3) != "W":
                    self.add("X", "S")
                else:
                    self.add("X")
                return 3
            self.add("S" if self.at(i + 2, "I", "E", "Y") else "SK")
            return 3
        self.add("", "S") if i == self.n - 1 and self.at(i - 2, "AI", "OI") else self.add("S")
        return 2 if self.ch(i + 1) in ("S", "Z") and self.ch(i + 1) else 1

    def on_t(self, i: int) -> int:
        if self.at(i, "TION", "TIA", "TCH"):
            self.add("X")
            return 3
        if self.at(i, "TH", "TTH"):
            self.add("T") if self.at(i + 2, "OM", "AM") or self.at(0, *_GERMANIC) else self.add("0", "T")
            return 2
        self.add("T")
        return 2 if self.ch(i + 1) in ("T", "D") and self.ch(i + 1) else 1

    def on_w(self, i: int) -> int:
        if self.at(i, "WR"):
            self.add("R")
            return 2
        if i == 0 and (self.ch(1) in _VOWELS and self.ch(1) or self.at(0, "WH")):
            self.add("A", "F") if self.ch(1) in _VOWELS else self.add("A")
            return 1
        if (i == self.n - 1 and self.ch(i - 1) in _VOWELS) or self.at(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or self.at(0, "SCH"):
            self.add("", "F")
            return 1
        if self.at(i, "WICZ", "WITZ"):
            self.add("TS", "FX")
            return 4
        return 1

    def on_x(self, i: int) -> int:
        if not (i == self.n - 1 and (self.at(i - 3, "IAU", "EAU") or self.at(i - 2, "AU", "OU"))):
            self.add("KS")
        return 2 if self.ch(i + 1) in ("C", "X") and self.ch(i + 1) else 1

    def on_z(self, i: int) -> int:
        if self.ch(i + 1) == "H":
            self.add("J")
            return 2
        foreign = self.at(i + 1, "ZO", "ZI", "ZA") or (self.slavic and i > 0 and self.ch(i - 1) != "T")
        self.add("S", "TS") if foreign else self.add("S")
        return 2 if self.ch(i + 1) == "Z" else 1


def sound_codes(word: str) -> list[str]:
    """Primary and secondary code, without empty or equal ones. Accents of letters are left off first."""
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    letters = "".join(c for c in plain.upper() if c.isalpha() or c == " ")
    one, two = _Coder(letters).run() if letters else ("", "")
    return [c for c in dict.fromkeys((one, two)) if c]


def _codes(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in words:
        yield s.map(lambda w: [] if w is None else sound_codes(w))


def _similar(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([jaro_winkler(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def codes_of(word: Column) -> Column:
    return F.pandas_udf(_codes, T.ArrayType(T.StringType()), F.PandasUDFType.SCALAR_ITER)(word)


def similarity(a: Column, b: Column) -> Column:
    return F.pandas_udf(_similar, T.DoubleType(), F.PandasUDFType.SCALAR_ITER)(a, b)


def with_codes(df: DataFrame, word: str) -> DataFrame:
    """Explode every row by the codes of its word: adds ``code``; words without a code have no row."""
    return df.withColumn("code", F.explode(codes_of(F.col(word))))
