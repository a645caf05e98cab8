"""The five dictionaries of the corpus: entries from lines, lookups in any script, letters, counts and search by gloss."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scripts as S
from ..functions import text as X
from . import lexicon

#: The dictionaries by slug, in the order of the page that lists them.
WORKS = ("frish", "kochergina", "kossovich", "knauer", "slovar-smirnova")
#: Roman numbers of homonyms at the head of a gloss, and abbreviated parts of speech.
HOMONYM = r"^(?:I{1,3}|IV|V|VI{1,3}|IX|X)\b"
PARTS = r"\b(?:m\.|f\.|n\.|mf\.|mn\.|fn\.|adj\.|adv\.|pron\.|num\.|pp\.|caus\.|desid\.|intens\.|pass\.|v\.)(?=\w)"
#: Heads of lines without tabs.
CIRCLED = r"^(°?[ऀ-ॿ]+)\s*(?:([IVX]+)\s+)?(?:/\s*/)?/([^/]+)/\s*(.*)$"
NUMBERED = r"^([0-9]+)\s+([ऀ-ॿ]+)\s+/([^/]+)/\s+/([^/]+)/\s+/([^/]+)/\s*(.*)$"

FIELDS = ("deva", "iast", "slp1", "cyr", "homonym", "gloss", "raw")


def strip_slashes(c: Column) -> Column:
    """'/a-/ /an-/' as 'a- an-'."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "/"), lambda x: F.trim(x)), lambda x: x != ""), " ")


def first_headword(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(c, "/"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.get(parts, 0), F.trim(c))


def pos_tags(c: Column) -> Column:
    """The distinct part-of-speech marks of a gloss, sorted. A mark ends in a dot with a letter or digit behind it."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PARTS), 0)))


def parse(lines: DataFrame) -> DataFrame:
    """(work, canonical_id, line_num, line_text, line_html) with the entry's deva, iast, slp1, cyr, homonym, gloss, raw and pos.

    frish and knauer have five cells by tab, slovar-smirnova too with other meaning; kochergina and kossovich have heads with
    slashes; a line that its work's shape does not fit is kept in raw. Where only Devanagari is given, iast follows from it."""
    cells, text, markup, work = F.split("line_text", "\t"), F.col("line_text"), F.coalesce("line_html", F.lit("")), F.col("work")
    tabbed = F.size(cells) >= 5
    numbered, circled = markup.rlike(NUMBERED), markup.rlike(CIRCLED)
    none = F.lit("")

    def cell(k: int) -> Column:
        return F.coalesce(F.get(cells, k), none)

    def entry(**given: Column) -> Column:
        return F.struct(*(given.get(k, none).alias(k) for k in FIELDS))

    def group(pattern: str, k: int) -> Column:
        return F.regexp_extract(markup, pattern, k)

    deva_first = {"deva": cell(0), "iast": cell(1), "slp1": strip_slashes(cell(2)), "cyr": cell(3), "gloss": cell(4)}
    raw = entry(raw=text)
    one_head = F.when(circled, entry(deva=group(CIRCLED, 1), homonym=group(CIRCLED, 2), iast=group(CIRCLED, 3), gloss=group(CIRCLED, 4))).otherwise(entry(raw=F.when(F.coalesce(text, none) != "", text).otherwise(markup)))
    parsed = (
        F.when((work == "frish") & tabbed, entry(**deva_first, homonym=F.regexp_extract(cell(4), HOMONYM, 0)))
        .when((work == "knauer") & tabbed, entry(**deva_first))
        .when((work == "slovar-smirnova") & tabbed, entry(cyr=cell(0), iast=cell(1), gloss=cell(4)))
        .when((work == "kossovich") & numbered, entry(homonym=group(NUMBERED, 1), deva=group(NUMBERED, 2), iast=group(NUMBERED, 3), slp1=group(NUMBERED, 4), cyr=group(NUMBERED, 5), gloss=group(NUMBERED, 6)))
        .when(work.isin("kochergina", "kossovich"), one_head)
        .otherwise(raw)
    )
    rows = lines.withColumn("e", parsed).select("work", "canonical_id", "line_num", "e.*")
    romanised = F.when((F.col("iast") == "") & (F.col("deva") != ""), S.deva_to_iast(strip_slashes(F.col("deva")))).otherwise(F.col("iast"))
    return rows.withColumn("pos", pos_tags(F.col("gloss"))).withColumn("iast", romanised)


def entry_slug(entries: DataFrame) -> Column:
    """An entry's address: its headword in SLP1, of the Cyrillic column if there is no other, x if there is none."""
    word = F.coalesce(*(F.when(strip_slashes(entries[k]) != "", strip_slashes(entries[k])) for k in ("iast", "cyr")), F.lit(""))
    return F.when(word != "", S.iast_to_slp1(word)).otherwise("x")


def query_keys(query: str) -> dict[str, str]:
    """A query in Devanagari, SLP1 (ASCII) or romanised letters as keys raw, iast and slp1."""
    q = query.strip()
    if not q:
        return {"raw": q}
    if any("ऀ" <= c <= "ॿ" for c in q):
        iast = S.deva_text(q)
        return {"raw": q, "iast": iast, "slp1": S.slp1_text(iast)}
    if re.fullmatch(r"[A-Za-z0-9~^'\\-]+", q):
        return {"raw": q, "slp1": q, "iast": S.iast_text(q)}
    return {"raw": q, "iast": q, "slp1": S.slp1_text(q)}


def _tokens(cell: Column) -> Column:
    return F.split(F.lower(strip_slashes(cell)), " ")


def lookup(entries: DataFrame, query: str) -> DataFrame:
    """Entries whose whole cell, or a word of it, is the query in SLP1, romanised or Devanagari; case does not matter but in Devanagari."""
    keys = query_keys(query)
    tests = [(strip_slashes(F.col(k)) != "") & ((F.lower(strip_slashes(F.col(k))) == keys[k].lower()) | F.array_contains(_tokens(F.col(k)), keys[k].lower())) for k in ("slp1", "iast") if keys.get(k)]
    if any("ऀ" <= c <= "ॿ" for c in keys["raw"]):
        tests.append(F.array_contains(F.split(strip_slashes(F.col("deva")), " "), keys["raw"]))
    return entries.where(lexicon.any_of(tests)) if tests else entries.limit(0)


def prefix(entries: DataFrame, query: str, limit: int = 40) -> DataFrame:
    """The first entries of each dictionary, in its order, whose cell or a word of it begins with the query."""
    keys = query_keys(query)
    want = (keys.get("slp1") or keys.get("iast") or keys["raw"]).lower()
    if not want:
        return entries.limit(0)
    slp1 = strip_slashes(F.col("slp1"))
    have = F.lower(F.when(slp1 != "", slp1).otherwise(strip_slashes(F.col("iast"))))
    hit = have.startswith(want) | F.exists(F.split(have, " "), lambda x: x.startswith(want))
    return entries.where(hit).withColumn("n", F.row_number().over(Window.partitionBy("work").orderBy("line_num", "canonical_id"))).where(F.col("n") <= limit)


def letters(entries: DataFrame) -> DataFrame:
    """(work, letter, entries, letter_rank): entries by the first letter of their romanised or Cyrillic head, in the order of the alphabet."""
    word = F.trim(F.lower(F.coalesce(F.when(F.col("iast") != "", F.col("iast")), F.col("cyr"), F.lit(""))))
    known = lexicon.bucket(word)
    letter = F.when(word == "", "?").when(known != "#", known).otherwise(F.substring(word, 1, 1))
    position = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for k, x in enumerate(lexicon.ALPHABET) for v in (x, k))), F.col("letter")), F.lit(len(lexicon.ALPHABET)))
    return entries.groupBy("work", letter.alias("letter")).agg(F.count("*").alias("entries")).withColumn("letter_rank", position)


def by_gloss(lines: DataFrame, query: str, limit: int = 60) -> DataFrame:
    """Entries of lines that hold the query as a phrase, in the order of dictionary and line."""
    phrase = X.norm_literal(query)
    if not phrase:
        return parse(lines.limit(0))
    hits = lines.where(X.norm(F.col("line_text")).contains(f" {phrase} ")).orderBy("work", "line_num", "canonical_id").limit(limit)
    return parse(hits)


def counts(lines: DataFrame) -> DataFrame:
    """(work, entries) of the dictionaries; 0 for one without lines is left to the page that lists them all."""
    return lines.where(F.col("work").isin(*WORKS)).groupBy("work").agg(F.count("*").alias("entries"))
