"""Catalogues of works: titles and their parts, groups, dates, rights, crawled listings, selections and reports.

Rules come as parameters in order; the first that fits wins.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEAR = r"\(([0-9]{4})\)"
UNCLASSIFIED = "(unclassified)"


# -- titles and metadata ----------------------------------------------------------------------------------


def author_of(work: Column, authors: list[str]) -> Column:
    """The author among `authors` that a work's part of a title begins with ('Author. Work'), else the first of its later segments
    that is an author's name, its year aside; ''. Longer names come first."""
    c = F.trim(work)
    names = sorted(authors, key=len, reverse=True)
    first = [F.when(c.startswith(f"{a}. "), F.lit(a)) for a in names]
    segments = F.transform(F.split(c, r"\. "), lambda x: F.trim(F.regexp_replace(x, YEAR, "")))
    later = F.filter(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), lambda x: x.isin(*names)) if names else F.array().cast("array<string>")
    return F.coalesce(*first, F.get(later, 0), F.lit(""))


def parse_title(title: Column, authors: list[str]) -> Column:
    """Struct (name, translator, year, author) of '[Author. ]Work[ (Year)][; Translator]'; parts that are missing are ''."""
    t = F.coalesce(title, F.lit(""))
    work = F.substring_index(t, ";", 1)
    translator = F.when(t.contains(";"), F.trim(F.substr(t, F.length(work) + 2))).otherwise("")
    return F.struct(F.trim(t).alias("name"), translator.alias("translator"), F.regexp_extract(work, YEAR, 1).alias("year"), author_of(work, authors).alias("author"))


def rights(year: Column, last_free: int = 1929) -> Column:
    """public-domain for editions up to a year, else in-copyright; an unknown year is in copyright."""
    return F.when(year <= last_free, "public-domain").otherwise("in-copyright")


def provenance(imprint: Column) -> Column:
    known = F.coalesce(imprint, F.lit("")) != ""
    return F.when(known, F.concat(F.lit("print edition: "), imprint)).otherwise("print edition unknown")


def by_rules(c: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    """The value of the first rule (pattern, value) that matches."""
    return reduce(lambda rest, rule: F.when(c.rlike(rule[0]), F.lit(rule[1])).otherwise(rest), reversed(rules), otherwise)


def dated(works: DataFrame, names: DataFrame, periods: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(group_name, members, date, period, method) of works (slug, title, manual_date, period).

    Works of one group are one row with their slugs in order. A date is that of the folded title among `names` (key, date,
    period), else the work's own, else that of its period among `periods` (period, date), else there is none."""
    g = works.withColumn("group_name", by_rules(F.col("slug"), rules, F.col("slug")))
    lead = F.min_by(F.struct("title", "manual_date", F.col("period").alias("own")), "slug")
    rows = g.groupBy("group_name").agg(F.array_sort(F.collect_set("slug")).alias("members"), lead.alias("w")).select("group_name", "members", "w.*", F.regexp_replace(F.lower("w.title"), "[^a-z0-9]", "").alias("key"))
    known = names.groupBy("key").agg(F.min(F.struct("date", "period")).alias("n"))
    usual = periods.select(F.col("period").alias("own"), F.col("date").alias("usual"))
    met = rows.join(known, "key", "left").join(usual, "own", "left")
    method = F.when(F.col("n").isNotNull(), "name").when(F.col("manual_date").isNotNull(), "manual").when(F.col("usual").isNotNull(), "period").otherwise("unresolved")
    return met.select("group_name", F.array_join("members", ",").alias("members"), F.coalesce("n.date", "manual_date", "usual").alias("date"), F.coalesce("n.period", "own").alias("period"), method.alias("method"))


def dated_by_hint(titles: DataFrame, names: DataFrame, hints: list[tuple[str, str]]) -> DataFrame:
    """(slug, date, key): the date of the first hint (part of a folded title, name's key) that a title holds and that is a known name."""
    folded = F.regexp_replace(F.lower("title"), "[^a-z0-9]", "")
    found = F.array_compact(F.array(*(F.when(F.col("t").contains(re.sub("[^a-z0-9]", "", h.lower())), F.struct(F.lit(k).alias("n"), F.lit(key).alias("key"))) for k, (h, key) in enumerate(hints))))
    known = names.groupBy("key").agg(F.min("date").alias("date"))
    hits = titles.withColumn("t", folded).select("slug", F.explode_outer(found).alias("h")).select("slug", "h.n", "h.key").join(known, "key", "left")
    best = F.min(F.when(F.col("date").isNotNull(), F.struct("n", "date", "key"))).alias("b")
    return hits.groupBy("slug").agg(best).select("slug", "b.date", "b.key")


# -- listings -----------------------------------------------------------------------------------------------


def section_rows(pages: DataFrame, row: str, heading: str = r"(?is)<h3[^>]*>(.*?)</h3>") -> DataFrame:
    """(page_id, group, pos, cells): rows of listing pages (page_id, html) by the pattern `row`, whose groups are the cells; a row's
    group is the heading before it."""
    cut = F.split(F.col("html"), r"(?i)(?=<h3[ >])")
    parts = pages.select("page_id", F.posexplode(cut).alias("k", "part"))
    title = F.trim(F.regexp_extract("part", heading, 1))
    groups = re.compile(row).groups
    found = F.regexp_extract_all("part", F.lit(row), 0)
    rows = parts.select("page_id", "k", F.when(F.col("part").rlike(heading), title).otherwise(UNCLASSIFIED).alias("group"), F.posexplode(found).alias("pos", "hit"))
    return rows.select("page_id", "group", F.struct("k", "pos").alias("at"), F.array(*(F.regexp_extract("hit", row, g + 1) for g in range(groups))).alias("cells"))


def merged_listing(rows: DataFrame) -> DataFrame:
    """(slug, sections, group_name, ...): rows (slug, section, group_name, title, words) of one work as one: its sections, the first
    group that is a real one, the first title, the largest count of words."""
    group = F.min(F.when(F.col("group_name") != UNCLASSIFIED, F.col("group_name")))
    return rows.groupBy("slug").agg(F.array_sort(F.collect_set("section")).alias("sections"), F.coalesce(group, F.lit(UNCLASSIFIED)).alias("group_name"), F.min("title").alias("title"), F.max("words").alias("words"))


def shard_of(c: Column, n: int) -> Column:
    """md5 of the text as a number, modulo n, from 0. The remainder is taken in three parts, as the number has 128 bits."""
    digest = F.md5(F.coalesce(c, F.lit("")))
    rest = F.lit(0).cast("long")
    for k in range(0, 32, 8):
        part = F.conv(F.substring(digest, k + 1, 8), 16, 10).cast("long")
        rest = F.pmod(rest * (2**32 % n) + part % n, F.lit(n))
    return rest


def select(records: DataFrame, slugs: list[str] | None = None, sections: list[str] | None = None, languages: list[str] | None = None, english: bool | None = None, least_words: int | None = None, shard: tuple[int, int] | None = None, limit: int | None = None) -> DataFrame:
    """Records (slug, sections, source_lang, has_english, words) that meet every condition asked for; a missing field fails its
    condition. shard is (k of 1 to n, n); a limit takes the first by slug."""
    tests = []
    if slugs:
        tests.append(F.col("slug").isin(*slugs))
    if sections:
        tests.append(F.arrays_overlap("sections", F.array(*map(F.lit, sections))))
    if languages:
        tests.append(F.col("source_lang").isin(*languages))
    if english is not None:
        tests.append(F.coalesce(F.col("has_english"), F.lit(False)) == english)
    if least_words:
        tests.append(F.coalesce(F.col("words"), F.lit(0)) >= least_words)
    if shard:
        tests.append(shard_of(F.col("slug"), shard[1]) == shard[0] - 1)
    for t in tests:
        records = records.where(F.coalesce(t, F.lit(False)))
    return records.orderBy("slug").limit(limit) if limit else records


def pending(records: DataFrame, done: DataFrame, key: str = "slug") -> DataFrame:
    """Records whose key is not among those done: what a crawl that is taken up again has to fetch."""
    return records.join(done.select(key).distinct(), key, "left_anti")


def share_table(records: DataFrame, by: str, missing: str = "?") -> DataFrame:
    """(value, entries, share): records by a column with their percentage of all."""
    counts = records.groupBy(F.coalesce(F.col(by).cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("entries"))
    whole = counts.agg(F.sum("entries").alias("whole"))
    return counts.crossJoin(whole).select("value", "entries", (F.col("entries") * 100.0 / F.col("whole")).alias("share"))  # one row


def progress_rate(samples: DataFrame, goal: int) -> DataFrame:
    """(done, per_minute, minutes_left) of samples (at seconds, n): from the first to the last; no rate if nothing moved."""
    ends = samples.agg(F.min(F.struct("at", "n")).alias("a"), F.max(F.struct("at", "n")).alias("b"))
    rate = F.try_divide((F.col("b.n") - F.col("a.n")) * 60.0, F.col("b.at") - F.col("a.at"))
    return ends.select(F.col("b.n").alias("done"), rate.alias("per_minute"), F.try_divide(F.lit(float(goal)) - F.col("b.n"), F.when(rate > 0, rate)).alias("minutes_left"))


# -- addresses ------------------------------------------------------------------------------------------------


def path_segment(c: Column) -> Column:
    """A query as one part of a path: blanks single, no slashes or marks that end a path."""
    return F.trim(F.regexp_replace(F.translate(F.trim(c), "/?#", "   "), r"\s+", " "))


def search_url(base: str, query: Column, mode: str = "plain", case_sensitive: bool = False, whole_word: bool = False, slugs: list[str] | None = None, aliases: dict[str, str] | None = None) -> Column:
    """The address of a search: a readable path if it has no options and at most one source, else a query string, its sources sorted."""
    q = path_segment(query)
    options = [*([("mode", mode)] if mode and mode != "plain" else []), *([("cs", "1")] if case_sensitive else []), *([("ww", "1")] if whole_word else [])]
    root = base.rstrip("/")
    if options or len(slugs or []) > 1:
        asked = [*options, *([("src", ",".join(sorted(slugs)))] if slugs else [])]
        from urllib.parse import urlencode

        return F.concat(F.lit(f"{root}/search?q="), F.url_encode(F.coalesce(F.nullif(F.lower(q), F.lit("")), F.trim(query))), F.lit("&" + urlencode(asked)))
    head = f"/s/{(aliases or {}).get(slugs[0], slugs[0])}/" if slugs else "/s/"
    return F.when(q == "", F.lit(f"{root}/search")).otherwise(F.concat(F.lit(root + head), F.substring(q, 1, 1000)))


def compare_url(file: Column, link: Column, works: dict[str, tuple[str, int, int]]) -> Column:
    """The comparison page of a hit, null if its file is in none or its anchor is no verse of it.

    works: file to (work, what its chapters are ahead of the work's, chapters of the work). Of a range, the first verse."""
    verse = r"^([0-9]+)\.([0-9]+)(?:-[0-9]+)?$"
    out = F.lit(None).cast("string")
    for name, (work, ahead, chapters) in works.items():
        chapter = F.regexp_extract(link, verse, 1).try_cast("int") - ahead
        ok = (file == name) & link.rlike(verse) & chapter.between(1, chapters) & (F.regexp_extract(link, verse, 2).try_cast("int") >= 1)
        out = F.when(ok, F.concat(F.lit(f"/compare/{work}/"), chapter.cast("string"), F.lit("."), F.regexp_extract(link, verse, 2).try_cast("int").cast("string"))).otherwise(out)
    return out


def split_sides(c: Column) -> tuple[Column, Column]:
    """The Sanskrit blocks of a line, joined, and the line without them."""
    pattern = r'(?is)<div class="chapter_block iast">.*?</div>'
    return F.array_join(F.regexp_extract_all(c, F.lit(pattern), 0), ""), F.regexp_replace(c, pattern, "")


def census(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per page: counts of the corpus format's marks, and a guess at its structure: verse if over a quarter of its ids are verses."""
    c = F.col(html_col)
    ids = F.regexp_extract_all(c, F.lit(r'id=["\']([^"\']+)["\']'), 1)
    verses = F.size(F.filter(ids, lambda x: x.rlike(r"^[0-9]+(\.[0-9]+)+(-[0-9]+)?$")))
    marks = {"blocks": "citation_block", "sanskrit": r"chapter_block\s+iast", "translations": r"chapter_block\s+translation", "comments": "comment_item", "titles": "chapter_title", "breaks": "(?i)<br", "small": "(?i)<small"}
    counted = [F.regexp_count(c, F.lit(p)).alias(f"n_{k}") for k, p in marks.items()]
    structure = F.when(F.size(ids) == 0, "prose").when(verses > 0.25 * F.size(ids), "verse").otherwise("prose")
    return pages.select(id_col, *counted, F.size(ids).alias("n_ids"), F.size(F.array_distinct(ids)).alias("n_distinct_ids"), verses.alias("n_verse_ids"), structure.alias("structure"))

