"""Corpus HTML as Columns: plain text, anchors, language blocks, authors, entities."""

from __future__ import annotations

import html

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sanskrit import strip_accents

#: The class names of the corpus format and what marks a line of its frame.
SANSKRIT = r'(?is)<div\s+class=["\']chapter_block\s+iast["\']\s*>(.*?)</div>'
TRANSLATION = r'(?is)<div\s+class=["\']chapter_block\s+translation["\']\s*>(.*?)</div>'
BLOCK_ID = r'class=["\']citation_block["\'][^>]*\sid=["\']([^"\']+)["\']'
RANGE_TITLE = r'class=["\']range["\'][^>]*\stitle=["\']([^"\']+)["\']'
CHAPTER_TITLE = r'(?s)<div\s+class=["\']chapter_title["\'][^>]*>(.*?)</div>'
COMMENT = r'<div\s+class=["\']comment_item["\']\s+id=["\']([^"\']+)["\']\s*>'
NOTE_ANCHOR = r"(?s)<a\s[^>]*class=['\"]comment_sub['\"][^>]*>.*?</a>"
END_OF_CHAPTER = r'(?is)<span\s+class=["\']endchapter["\']>.*'
FRAME = r"(?i)^\s*</?(?:html|head|body)[^>]*>\s*$"
AUTHORS = (r'(?s)<span\s+class=["\']translation_author["\']\s*>(.*?)</span>', r'(?s)<span\s+class=["\']iast_author["\']\s*>(.*?)</span>')

#: Named references that texts use; the ampersand is undone last.
NAMED = ("lt", "gt", "quot", "apos", "nbsp", "ndash", "mdash", "laquo", "raquo", "hellip", "amp")


def remove_tags(c: Column) -> Column:
    """Line breaks to blanks, accents of the Veda off, small print and tags dropped, runs of blanks squeezed."""
    c = strip_accents(F.regexp_replace(c, "(?i)<br>", " "))
    c = F.regexp_replace(F.regexp_replace(c, "(?i)<small>.*?</small>", ""), "<[^>]*>", "")
    return F.regexp_replace(F.regexp_replace(c, "  +", " "), r"^\s+|\s+$", "")


def _numbered(c: Column, pattern: str, code) -> Column:
    """References by number: the text between them with the characters they name."""
    between, codes = F.split(c, pattern.replace("(", "(?:"), -1), F.regexp_extract_all(c, F.lit(pattern), 1)
    named = F.transform(codes, lambda x: F.decode(F.unhex(F.lpad(F.hex(code(x)), 8, "0")), "UTF-32"))
    return F.array_join(F.zip_with(between, named, lambda t, n: F.concat(t, F.coalesce(n, F.lit("")))), "")


def unescape(c: Column) -> Column:
    """Character references to characters; those of a text without one cost a look for '&'."""
    out = _numbered(_numbered(c, "&#([0-9]{1,6});", lambda x: x.cast("long")), "&#[xX]([0-9A-Fa-f]{1,5});", lambda x: F.conv(x, 16, 10).cast("long"))
    for name in NAMED:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(html.unescape(f"&{name};")))
    return F.when(c.contains("&"), out).otherwise(c)


def searchable(c: Column) -> Column:
    """The text that is searched: no note anchors, no tags, references undone."""
    return unescape(remove_tags(F.regexp_replace(c, NOTE_ANCHOR, "")))


def _found(c: Column, pattern: str) -> Column:
    got = F.regexp_extract(c, pattern, 1)
    return F.when(got != "", got)


def link_id(c: Column) -> Column:
    """A line's anchor: its block's id; else chapter and verse at the end of its range title, '' if the title has none; else any id; ''."""
    title = _found(c, RANGE_TITLE)
    verse = r"([0-9]+)\.\s*([0-9]+(?:-[0-9]+)?)\s*$"
    of_title = F.when(title.rlike(verse), F.concat(F.regexp_extract(title, verse, 1), F.lit("."), F.regexp_extract(title, verse, 2))).otherwise("")
    return F.coalesce(_found(c, BLOCK_ID), F.when(title.isNotNull(), of_title), _found(c, r'id=["\']([^"\']+)["\']'), F.lit(""))


def block(c: Column, which: str) -> Column:
    """The inner HTML of a line's first block of a side, up to the end-of-chapter mark; '' if it has none."""
    return F.trim(F.regexp_replace(F.regexp_extract(c, which, 1), END_OF_CHAPTER, ""))


def normalize_lang(raw: str | None) -> str | None:
    """ru or sa; anything else asks for no filter."""
    asked = (raw or "").strip().lower()
    return asked if asked in ("ru", "sa") else None


def only_language(c: Column, lang: str | None) -> Column:
    """A line without the blocks of the other language; unchanged for no language."""
    other = {"sa": "translation", "ru": "iast"}.get(lang or "")
    return F.regexp_replace(c, rf'(?is)<div class="chapter_block {other}">.*?</div>', "") if other else c


def is_parallel(c: Column) -> Column:
    """Whether a line has a Sanskrit block of its own."""
    return F.coalesce(c.rlike(r'(?is)<div class="chapter_block iast">.*?</div>'), F.lit(False))


def author(c: Column) -> Column:
    """The speaker named in a block: of the translation, without a closing mark, else of the Sanskrit; null if none."""
    own = F.rtrim(F.regexp_replace(remove_tags(F.regexp_extract(c, AUTHORS[0], 1)), "[$:]+$", ""))
    return F.coalesce(F.when(own != "", own), F.when(c.rlike(AUTHORS[1]), remove_tags(F.regexp_extract(c, AUTHORS[1], 1))))


def without_author(c: Column) -> Column:
    for pattern in AUTHORS:
        head = F.regexp_extract(c, f"(?s)^(.*?){pattern[4:]}", 1)
        c = F.when(c.rlike(pattern), F.concat(head, F.substr(c, F.length(head) + F.length(F.regexp_extract(c, pattern, 0)) + 1))).otherwise(c)
    return c


def comment_target(anchor: Column) -> Column:
    """What a comment's anchor names: chapter.verse with the quarter's letter, c.N for a chapter (verse 0, a lettered chapter, chapter_NC), else null."""
    tidy = F.regexp_replace(anchor, r"[;,*):\-\s]+$", "")
    exact = r"^comment_([0-9]+)_([0-9]+)([a-z]?)$"
    numbered = r"^comment_([0-9]+)_([0-9]+)(?:_[0-9]+|\.[0-9]+)$"
    ranged = r"^comment_([0-9]+)_([0-9]+)([a-z]?)[-‒–—]\S+$"
    broad = r"^comment_([0-9]+)_([0-9]+)([a-zA-Zа-яёА-ЯЁ]?)"
    lettered, chapter = r"^comment_([a-z])_[0-9]+$", r"^chapter_([0-9]+)[Cc]$"

    def verse(a: Column, p: str, quarter: bool) -> Column:
        at = F.concat_ws(".", F.regexp_extract(a, p, 1), F.regexp_extract(a, p, 2))
        whole = F.concat(F.lit("c."), F.regexp_extract(a, p, 1))
        return F.when(a.rlike(p), F.when(F.regexp_extract(a, p, 2) == "0", whole).otherwise(F.concat(at, F.regexp_extract(a, p, 3)) if quarter else at))

    def tried(a: Column) -> list[Column]:
        named = [F.when(a.rlike(p), F.concat(F.lit("c."), F.regexp_extract(a, p, 1))) for p in (lettered, chapter)]
        return [verse(a, exact, True), verse(a, numbered, False), verse(a, ranged, True), *named]

    return F.coalesce(*tried(anchor), *tried(tidy), verse(anchor, broad, True))
