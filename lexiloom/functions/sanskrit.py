"""Match keys of romanised Sanskrit and of its SLP1 spelling, as Columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scripts import iast_to_slp1

#: The letters of romanised Sanskrit beyond a to z.
IAST = "āīūṛṝḷḹṅñṭḍṇśṣṃḥ"
#: Nasals that a skeleton writes as m, and letters that it leaves out because they change where words meet.
NASALS, UNSTABLE = "ṅñṇnṃ", "aāiīuūṛṝḷḹeoḥyv"
#: Long vowels and their short ones; stops, nasals and sibilants and what stands for their class in a folded word.
LONG, SHORT = "āīūṝḹ", "aiuṛḷ"
CLASSED, CLASSES = "gcjdḍṭbṅñṇmśṣ", "kkktttpnnnnss"
#: The letters of SLP1 with the avagraha and the nasal sign.
SLP1 = "aAiIuUfFxXeEoOMHkKgGNcCjJYwWqQRtTdDnpPbBmyrlvSzshL'~"
#: Accented vowels of the Veda without their accents, then combining accents.
ACCENTED, UNACCENTED, ACCENTS = "áàéèíìóòúù", "aaeeiioouu", "̀́"
#: Classes of part-of-speech tags.
NOMINAL, VERBAL = ("NOUN", "PROPN", "ADJ", "PRON", "DET", "NUM"), ("VERB", "AUX")


def composed(c: Column) -> Column:
    """Letters of romanised Sanskrit that are written with combining marks, as one code point each. A text without a mark costs a look for one."""
    out = c
    for letter in IAST + IAST.upper():
        out = F.replace(out, F.lit(unicodedata.normalize("NFD", letter)), F.lit(letter))
    return F.when(c.rlike(r"\p{Mn}"), out).otherwise(c)


def _lowered(c: Column) -> Column:
    return F.replace(F.lower(composed(F.coalesce(c, F.lit("")))), F.lit("ṁ"), F.lit("ṃ"))


def norm_iast(c: Column) -> Column:
    """The key of a line: its letters, lower case; '' for null."""
    return F.regexp_replace(_lowered(c), f"[^a-z{IAST}]", "")


def norm_spaced(c: Column) -> Column:
    """As norm_iast, with single blanks between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(_lowered(c), f"[^a-z{IAST} ]", ""), " +", " "))


def skeleton(key: Column) -> Column:
    """What changes where words meet taken out of a key: nasals as one, no vowels, visarga, y and v."""
    return F.regexp_replace(F.translate(key, NASALS, "m" * len(NASALS)), f"[{UNSTABLE}]", "")


def half_verses(c: Column) -> Column:
    """Lines between dandas, those without a letter left out."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[।॥]+"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: F.length(norm_iast(x)) > 0)


def clean_lemma(c: Column) -> Column:
    """A lemma in SLP1; null where it is empty or holds a character that no lemma has."""
    lemma = F.trim(composed(c))
    return F.when(lemma.rlike(f"^[a-zA-Z{IAST}' -]+$"), iast_to_slp1(F.lower(lemma)))


def fold_sandhi(c: Column) -> Column:
    """A word's key that does not change where it meets another: short vowels, one letter for each class of stops, final o as as."""
    low = F.translate(F.lower(composed(F.coalesce(c, F.lit("")))), LONG + "ḥṃṁ", SHORT + "smm")
    letters = F.regexp_replace(low, "[^a-zṛḷṅñṭḍṇśṣ']", "")
    return F.translate(F.regexp_replace(letters, "o$", "as"), CLASSED, CLASSES)


def seam(c: Column) -> Column:
    """Like vowels that meet become one."""
    return F.regexp_replace(c, r"([aiu])\1+", "$1")


def join_key(slp1: Column) -> Column:
    """A word in SLP1 as it stands before sandhi: anusvara as m, visarga as s."""
    return F.translate(F.coalesce(slp1, F.lit("")), "MH", "ms")


def clean_slp1(c: Column) -> Column:
    """Only letters of SLP1; all else separates words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), f"[^{SLP1}]", " "), " +", " "))


def strip_accents(c: Column) -> Column:
    return F.translate(F.replace(c, F.lit("r̥"), F.lit("ṛ")), ACCENTED + ACCENTS, UNACCENTED)


def coarse_pos(upos: Column) -> Column:
    return F.when(upos.isin(*NOMINAL), "nominal").when(upos.isin(*VERBAL), "verbal").otherwise("indecl")


def agree(a: Column, b: Column) -> Column:
    """Whether two features are equal; null where one is missing."""
    return F.when((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != ""), a == b)
