"""Transliteration and script repair. Ordered replacements are Columns; Devanagari, whose vowels are implied, needs a kernel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: IAST to SLP1, longer letters first.
IAST_SLP1 = {"kh": "K", "gh": "G", "ch": "C", "jh": "J", "ṭh": "W", "ḍh": "Q", "th": "T", "dh": "D", "ph": "P", "bh": "B", "ai": "E", "au": "O", "ā": "A", "ī": "I", "ū": "U", "ṛ": "f", "ṝ": "F", "ḷ": "x", "ḹ": "X", "ṃ": "M", "ḥ": "H", "ṅ": "N", "ñ": "Y", "ṭ": "w", "ḍ": "q", "ṇ": "R", "ś": "S", "ṣ": "z"}

#: Devanagari vowels, vowel signs, consonants and marks in IAST.
VOWELS = dict(zip("अआइईउऊऋॠऌएऐओऔ", "a ā i ī u ū ṛ ṝ ḷ e ai o au".split(), strict=True))
SIGNS = dict(zip("ािीुूृॄॢेैोौ", "ā i ī u ū ṛ ṝ ḷ e ai o au".split(), strict=True))
CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह", "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h".split(), strict=True))
MARKS = {"ं": "ṃ", "ः": "ḥ", "ँ": "m̐", "ऽ": "'", "।": ".", "॥": ".."}
VIRAMA = "्"

#: Cyrillic letters that look like Latin ones.
LOOKALIKES = ("асеорхуАВСЕНКМОРТХ", "aceopxyABCEHKMOPTX")


def iast_to_slp1(c: Column) -> Column:
    for a, b in IAST_SLP1.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def slp1_to_iast(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for a, b in IAST_SLP1.items() for x in (b, a)))
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


def slp1_text(text: str) -> str:
    """iast_to_slp1 of a query."""
    for a, b in IAST_SLP1.items():
        text = text.replace(a, b)
    return text


def iast_text(text: str) -> str:
    """slp1_to_iast of a query."""
    back = {b: a for a, b in IAST_SLP1.items()}
    return "".join(back.get(c, c) for c in text)


def deva_text(text: str) -> str:
    """A consonant carries a unless a sign or the virama follows."""
    out, pending = [], False
    for c in text:
        if c in CONSONANTS:
            out += ["a"] * pending + [CONSONANTS[c]]
            pending = True
        elif c in SIGNS:
            out.append(SIGNS[c])
            pending = False
        elif c == VIRAMA:
            pending = False
        else:
            out += ["a"] * pending + [VOWELS.get(c) or MARKS.get(c) or c]
            pending = False
    return "".join(out + ["a"] * pending)


@F.pandas_udf(T.StringType())
def deva_to_iast(s: pd.Series) -> pd.Series:
    return s.map(deva_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def encoding(c: Column) -> Column:
    """devanagari, iast or slp1."""
    return F.when(c.rlike("[ऀ-ॿ]"), "devanagari").when(c.rlike("[āīūṛṝḷḹṃḥṅñṭḍṇśṣ]"), "iast").otherwise("slp1")


def unmix(token: Column) -> Column:
    """Look-alikes inside a token that mixes scripts go to the script of most of its letters; other tokens stay."""
    cyrillic, latin = F.regexp_count(token, F.lit(r"\p{IsCyrillic}")), F.regexp_count(token, F.lit(r"\p{IsLatin}"))
    fixed = F.when(cyrillic > latin, F.translate(token, LOOKALIKES[1], LOOKALIKES[0])).otherwise(F.translate(token, LOOKALIKES[0], LOOKALIKES[1]))
    return F.when((cyrillic > 0) & (latin > 0), fixed).otherwise(token)


def plural_ru(n: Column, one: str, few: str, many: str) -> Column:
    """The Russian form of a counted noun."""
    return F.when((n % 100).between(11, 14), many).when(n % 10 == 1, one).when((n % 10).between(2, 4), few).otherwise(many)


def zero_pad(c: Column) -> Column:
    """S.C.V[-V] to S.CCC.VVV[-VVV]."""
    parts = F.split(c, r"\.")
    last = F.array_join(F.transform(F.split(F.get(parts, 2), "-"), lambda x: F.lpad(x, 3, "0")), "-")
    return F.concat_ws(".", F.get(parts, 0), F.lpad(F.get(parts, 1), 3, "0"), last)
