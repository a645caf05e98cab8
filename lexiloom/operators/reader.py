"""The reader: a source's passages in order, one language if asked, its chapters and addresses."""

from __future__ import annotations

from urllib.parse import quote, urlencode

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup as M


def merge_segments(lines: DataFrame) -> DataFrame:
    """Segment rows to passage rows, by source and anchor: the sides as blocks, then the comments, in the order of the lines.

    lines: source_slug, line_num, link_id, chapter, line_html, line_text, canonical_id, which ends in #sa, #ru or holds #comm.
    A passage with neither side nor comment keeps its first line as it is. One combining aggregate; comments of one passage
    are gathered, as they make up one cell of the result."""
    cid = F.coalesce("canonical_id", F.lit(""))
    kind = F.when(cid.endswith("#sa"), "sa").when(cid.endswith("#ru"), "ru").when(cid.contains("#comm"), "comm")
    rows = lines.withColumn("kind", kind).withColumn("anchor", F.coalesce(F.when(F.col("link_id") != "", F.col("link_id")), F.col("line_num").cast("string")))
    at = F.struct(F.col("line_num").alias("n"), cid.alias("c"), F.coalesce("line_html", F.lit("")).alias("html"), "line_text", "chapter", "link_id")
    last = {k: F.max(F.when(F.col("kind") == k, at)) for k in ("sa", "ru")}
    first_ru = F.min(F.when((F.col("kind") == "ru") & (F.coalesce("line_text", F.lit("")) != ""), at))
    by = rows.groupBy("source_slug", "anchor").agg(F.min(at).alias("first"), last["sa"].alias("sa"), last["ru"].alias("ru"), first_ru.alias("ru_first"), F.sort_array(F.collect_list(F.when(F.col("kind") == "comm", at))).alias("comm"))

    def side(k: str, name: str):
        h = F.col(f"{k}.html")
        return F.when(h != "", F.concat(F.lit(f'<div class="chapter_block {name}">'), h, F.lit("</div>"))).otherwise("")

    inner = F.concat(F.coalesce(side("sa", "iast"), F.lit("")), F.coalesce(side("ru", "translation"), F.lit("")))
    content = F.when(inner != "", F.concat(F.lit('<div class="chapter_content">'), inner, F.lit("</div>"))).otherwise("")
    items = F.array_join(F.transform("comm", lambda x: F.concat(F.lit('<div class="comment_item">'), x["html"], F.lit("</div>"))), "")
    comments = F.when(F.size("comm") > 0, F.concat(F.lit('<div class="comments">'), items, F.lit("</div>"))).otherwise("")
    whole = F.concat(content, comments)
    base = F.split_part("first.c", F.lit("#"), F.lit(1))
    text = F.coalesce(F.when(F.coalesce("sa.line_text", F.lit("")) != "", F.col("sa.line_text")), "ru_first.line_text", F.lit(""))
    return by.select(
        "source_slug", F.col("first.n").alias("line_num"), F.coalesce("first.link_id", F.lit("")).alias("link_id"), F.col("sa.chapter").alias("chapter"), F.when(whole != "", whole).otherwise(F.col("first.html")).alias("line_html"), text.alias("line_text"),
        F.when(base != "", base).alias("canonical_id"),
    )


def parallel_sources(lines: DataFrame, sample: int = 10) -> DataFrame:
    """(source_slug, parallel): whether one of a source's first lines has a Sanskrit block; the sample is the feature."""
    first = Window.partitionBy("source_slug").orderBy("line_num", "canonical_id")
    return lines.withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample).groupBy("source_slug").agg(F.bool_or(M.is_parallel(F.col("line_html"))).alias("parallel"))


def read_source(lines: DataFrame, slug: str, lang: str | None = None) -> DataFrame:
    """The passages of a source in order, in one language if that is asked and the source is parallel."""
    mine = lines.where(F.col("source_slug") == slug)
    asked = M.normalize_lang(lang)
    if asked:
        mine = mine.join(F.broadcast(parallel_sources(mine)), "source_slug")  # one row
        mine = mine.withColumn("line_html", F.when(F.col("parallel"), M.only_language(F.col("line_html"), asked)).otherwise(F.col("line_html"))).drop("parallel")
    return mine.orderBy("line_num", "canonical_id")


def chapters(lines: DataFrame) -> DataFrame:
    """(source_slug, name, line_num, link_id): where each chapter first appears; its name is the column, else the heading in the line."""
    heading = F.trim(F.regexp_replace(F.regexp_extract(F.coalesce("line_html", F.lit("")), M.CHAPTER_TITLE, 1), "<[^>]+>", ""))
    own = F.trim(F.coalesce("chapter", F.lit("")))
    named = lines.withColumn("name", F.when(own != "", own).otherwise(heading)).where("name != ''")
    first = F.min(F.struct("line_num", F.coalesce("link_id", F.lit("")).alias("link_id")))
    return named.groupBy("source_slug", "name").agg(first.alias("f")).select("source_slug", "name", "f.line_num", "f.link_id")


def variant_url(base: str, slug: str, highlight: str | None = None, lang: str | None = None) -> str:
    """A source's address; highlight comes before lang, so that equal pages have equal addresses."""
    asked = [(k, v) for k, v in (("highlight", highlight), ("lang", lang)) if v]
    return f"{base.rstrip('/')}/sources/{quote(slug)}" + (f"?{urlencode(asked)}" if asked else "")


def alternates(base: str, slug: str, parallel: bool, highlight: str | None = None) -> list[dict[str, str]]:
    """Addresses of a page's language variants; none where the variants would be the same page."""
    return [{"hreflang": k, "url": variant_url(base, slug, highlight, lang)} for k, lang in (("x-default", None), ("ru", "ru"), ("sa", "sa"))] if parallel else []


def sources_list(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """The dimension with each source's number of lines, 0 where it has none, in its order."""
    counts = lines.groupBy(F.col("source_slug").alias("slug")).agg(F.count("*").alias("n_lines"))
    return sources.join(counts, "slug", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0))).orderBy("sort_order")


def resolve_filter(sources: DataFrame, tokens: list[str]) -> DataFrame:
    """Sources that the tokens name, by slug, else by number; if they name none, all sources."""
    named = [t.strip() for t in tokens if t.strip()]
    by_slug = sources.where(F.col("slug").isin(named)) if named else sources.limit(0)
    numbers = [int(t) for t in named if t.isdigit()]
    by_id = sources.where(F.col("source_id").isin(numbers) & ~F.col("slug").isin(named)) if numbers else sources.limit(0)
    slugs_that_are_numbers = by_slug.select(F.col("slug").alias("s"))
    by_id = by_id.join(slugs_that_are_numbers, by_id["source_id"].cast("string") == F.col("s"), "left_anti")
    found = by_slug.unionByName(by_id).distinct()
    return found if not found.isEmpty() else sources
