"""Passages: pivots of segments by group, units, natural order, merging, numbering and carried headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivot(segments: DataFrame) -> DataFrame:
    """One row per group: last sa and ru text by seq, whether each side is declared, commentary count. One combining aggregate."""
    sa, ru = F.col("seg") == "sa", F.col("seg") == "ru"

    def last(side: Column) -> Column:
        return F.max(F.when(side, F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))["text"]

    return segments.groupBy("group_id").agg(last(sa).alias("sa_text"), last(ru).alias("ru_text"), F.count_if(F.col("seg").startswith("comm")).alias("n_comm"))


def classify(segments: DataFrame) -> DataFrame:
    """pair, mono_ru, mono_sa or none, and empty_side where a declared side is blank."""
    sa, ru = F.length(F.trim("sa_text")) > 0, F.length(F.trim("ru_text")) > 0
    has_sa, has_ru = F.coalesce(sa, F.lit(False)), F.coalesce(ru, F.lit(False))
    kind = F.when(has_sa & has_ru, "pair").when(has_ru & F.col("sa_text").isNull(), "mono_ru").when(has_sa & F.col("ru_text").isNull(), "mono_sa").otherwise("none")
    blank = (F.col("sa_text").isNotNull() & ~has_sa) | (F.col("ru_text").isNotNull() & ~has_ru)
    return pivot(segments).select("group_id", kind.alias("kind"), blank.alias("empty_side"), "n_comm", "sa_text", "ru_text")


def units(segments: DataFrame, side: str, sentinel: str = "{no rus data}") -> DataFrame:
    """Groups with a non-blank side of their own, translated or not; the sentinel is no text."""
    col = f"{side}_text"
    return pivot(segments).where((F.length(F.trim(col)) > 0) & (F.col(col) != sentinel)).select("group_id", F.col(col).alias("text"))


def merge(segments: DataFrame) -> DataFrame:
    """Passage rows for the reader: text is the last sa side, else the first ru; least seq; number of segments."""
    sa, ru = F.col("seg") == "sa", F.col("seg") == "ru"
    text = F.coalesce(F.max_by(F.when(sa, F.col("text")), F.when(sa, F.col("seq"))), F.min_by(F.when(ru, F.col("text")), F.when(ru, F.col("seq"))))
    return segments.groupBy("group_id").agg(text.alias("text"), F.min("seq").alias("first_seq"), F.count("*").alias("n_segments"))


def parity(segments: DataFrame) -> DataFrame:
    """Groups that do not have exactly one sa and one ru."""
    by = segments.groupBy("group_id").agg(F.count_if(F.col("seg") == "sa").alias("n_sa"), F.count_if(F.col("seg") == "ru").alias("n_ru"))
    return by.where("n_sa <> 1 or n_ru <> 1")


def chapter_toc(lines: DataFrame) -> DataFrame:
    """First appearance of each chapter in each source."""
    return lines.groupBy("source_slug", "chapter").agg(F.min("line_num").alias("first_line"), F.count("*").alias("n_lines"))


def carry_heading(lines: DataFrame, group: str = "page_id", heading: str = r"<h1[^>]*>([^<]*)") -> DataFrame:
    """Each line with the last heading at or before it."""
    own = F.regexp_extract("line", heading, 1)
    seen = F.last(F.when(own != "", own), ignorenulls=True).over(Window.partitionBy(group).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("chapter", seen)


def paragraph_ids(lines: DataFrame, group: str = "page_id", heading: str = r"<h[12][ >]") -> DataFrame:
    """Ids c{n}.p{m}: chapters count headings, paragraphs count within a chapter."""
    order = Window.partitionBy(group).orderBy("line_no")
    at = lines.withColumn("chapter_no", F.sum(F.col("line").rlike(heading).cast("int")).over(order))
    p = at.where(F.col("line").rlike("<p[ >]"))
    ordinal = F.row_number().over(Window.partitionBy(group, "chapter_no").orderBy("line_no"))
    return p.withColumn("passage", F.concat(F.lit("c"), F.col("chapter_no").cast("string"), F.lit(".p"), ordinal.cast("string")))


def nth_duplicate(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Number of rows with the same keys before this one."""
    return df.withColumn("dup", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def adjacent(segments: DataFrame, wanted: str = "ru") -> DataFrame:
    """The text of the next segment of the group, only if it is of the wanted side."""
    order = Window.partitionBy("group_id").orderBy("seq")
    return segments.withColumn("translation", F.when(F.lead("seg").over(order) == wanted, F.lead("text").over(order)))
