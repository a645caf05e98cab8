"""Text functions as Columns: normalisation, scripts, HTML, slugs, natural order. All stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def single_mark_letters() -> tuple[str, str]:
    """Lower-case Latin letters that carry exactly one mark, and their bare letters; letters with two marks are not folded."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(parts) == 2 and parts[0].isascii() and parts[0].isalpha():
            pairs.append((c, parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = single_mark_letters()
SEPARATORS = r"[^\p{L}\p{N}\p{Co}]+"


def fold(c: Column) -> Column:
    return F.translate(c, FOLD_FROM, FOLD_TO)


def norm(c: Column, fold_diacritics: bool = True) -> Column:
    """' tok tok ' of lower-cased text, so that a prefix is contains(' tok') and a whole token contains(' tok ')."""
    low = F.lower(c)
    words = F.regexp_replace(fold(low) if fold_diacritics else low, SEPARATORS, " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def norm_literal(text: str, fold_diacritics: bool = True) -> str:
    """What norm makes of a query piece, without the outer blanks."""
    import regex

    low = text.lower()
    if fold_diacritics:
        low = low.translate(str.maketrans(FOLD_FROM, FOLD_TO))
    return regex.sub(r"[^\p{L}\p{N}\p{Co}]+", " ", low).strip()


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0)


def strip_html(c: Column) -> Column:
    """Line breaks to blanks, small print dropped, tags dropped, blanks squeezed."""
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", " ")
    c = F.regexp_replace(c, r"(?is)<small[^>]*>.*?</small>", "")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def plain(c: Column) -> Column:
    """Tags to blanks, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


def fingerprint(c: Column) -> Column:
    """SHA-256 of the plain text; empty for blank text."""
    p = plain(F.coalesce(c, F.lit("")))
    return F.when(F.length(p) > 0, F.sha2(p, 256)).otherwise(F.lit(""))


def has_script(c: Column, name: str) -> Column:
    return c.rlike(rf"\p{{Is{name}}}")


#: The letters that mark romanised Sanskrit.
IAST_LETTERS = "āīūṛṝḷḹṃḥṅñṭḍṇśṣ"


def detect_script(c: Column) -> Column:
    """devanagari, iast, cyrillic or mixed, first that applies."""
    return F.when(has_script(c, "Devanagari"), "devanagari").when(c.rlike(f"[{IAST_LETTERS}]"), "iast").when(has_script(c, "Cyrillic"), "cyrillic").otherwise("mixed")


#: Transliteration of Cyrillic letters for slugs.
CYRILLIC = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya"}


def transliterate(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in CYRILLIC.items() for x in kv))
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")


def slug(c: Column) -> Column:
    """Extension of a corpus file dropped, transliterated, lower, runs of other characters but underscores to '-', trimmed."""
    base = F.regexp_replace(c, r"(?i)\.(html?|txt|xml)$", "")
    return F.regexp_replace(F.regexp_replace(transliterate(F.lower(base)), r"[^a-z0-9_]+", "-"), r"^-+|-+$", "")


def unique_slugs(files: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """(id, slug): the first file of a slug by id has it bare, the n-th the n-th number that is free; an empty slug is 'source'. A numbered
    slug that another file has of its own stays with that file, so that the result does not depend on the order of the two."""
    own = slug(F.col(name_col))
    rows = files.select(F.col(id_col).alias("id"), F.when(own != "", own).otherwise("source").alias("base"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("id"))
    rows = rows.withColumn("n", n)
    taken = rows.select(F.col("base").alias("slug")).distinct()
    # Of a base, the numbers that are other files' own slugs are left out: the n-th of its files takes the n-th number that is free.
    parts = taken.select(F.regexp_extract("slug", r"^(.*)-([0-9]+)$", 1).alias("base"), F.regexp_extract("slug", r"^(.*)-([0-9]+)$", 2).try_cast("int").alias("used")).where("base != '' and used >= 2")
    used = parts.groupBy("base").agg(F.sort_array(F.collect_set("used")).alias("used"))
    free = F.aggregate(F.coalesce("used", F.array().cast("array<int>")), F.col("n"), lambda k, u: F.when(u <= k, k + 1).otherwise(k))
    return rows.join(used, "base", "left").select("id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), free.cast("string"))).alias("slug"))


def natural_key(c: Column, width: int = 10) -> Column:
    """Runs of digits padded, so that text order is natural order."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"[0-9]+|[^0-9]+"), 0), lambda x: F.when(x.rlike("^[0-9]+$"), F.lpad(x, width, "0")).otherwise(x)), "")


def letter_suffix(n: Column) -> Column:
    """Suffix of the n-th duplicate, from 0: none, b, c, ... z; beyond that none is left and the result is null."""
    return F.when(n == 0, F.lit("")).when(n <= 25, F.chr((n + 97).cast("long")))


def running_suffix(n: Column) -> Column:
    """Suffix of the n-th duplicate, from 0: none, b, c, ... z, and on through the code points after z."""
    return F.when(n == 0, F.lit("")).otherwise(F.decode(F.unhex(F.lpad(F.hex((n + 97).cast("long")), 8, "0")), "UTF-32"))


def kwic(text: Column, terms: list[str], width: int = 40) -> Column:
    """Around the first term, in query order, that occurs: `width` characters on either side, ellipses where cut."""
    head = F.when(F.length(text) > 80, F.concat(F.substring(text, 1, 80), F.lit("…"))).otherwise(text)
    if not terms:
        return F.substring(text, 1, 80)
    out = head
    for term in reversed(terms):
        at = F.locate(term.lower(), F.lower(text))
        start = F.greatest(F.lit(1), at - width)
        stop = at + len(term) + width
        cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substr(text, start, stop - start), F.when(stop <= F.length(text), "…").otherwise(""))
        out = F.when(at > 0, cut).otherwise(out)
    return F.when(F.length(text) == 0, F.lit("")).otherwise(out)


def kwic_parts(text: Column, terms: list[str], width: int = 40) -> Column:
    """Struct (before, match, after) around the first term, in query order, that occurs; ellipses where the text is cut. Without a term
    or a hit, the text's head is in `after`; an empty text gives empty parts."""

    def parts(before: Column, match: Column, after: Column) -> Column:
        return F.struct(before.alias("before"), match.alias("match"), after.alias("after"))

    none = F.lit("")
    head = F.substring(text, 1, 2 * width)
    if not terms:
        return F.when(F.length(text) > 0, parts(none, none, head)).otherwise(parts(none, none, none))
    out = parts(none, none, F.concat(head, F.when(F.length(text) > 2 * width, "…").otherwise("")))
    for term in reversed(terms):
        at, n = F.locate(term.lower(), F.lower(text)), len(term)
        start, stop = F.greatest(F.lit(1), at - width), at + n + width
        before = F.concat(F.when(start > 1, "…").otherwise(""), F.substr(text, start, at - start))
        after = F.concat(F.substr(text, at + n, F.lit(width)), F.when(stop <= F.length(text), "…").otherwise(""))
        out = F.when(at > 0, parts(before, F.substr(text, at, F.lit(n)), after)).otherwise(out)
    return F.when(F.length(text) > 0, out).otherwise(parts(none, none, none))


def request_hash(*parts: Column) -> Column:
    """SHA-256 of fields joined by bars; null fields are left out."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)
