"""Documents out of canonical records: citation blocks, corpus HTML, and text files with a header and a footer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .export import xml_escape


def citation_blocks(records: DataFrame, title: str = "", credit: str = "") -> DataFrame:
    """(work, group, passage, chapter, first_seq, block): one citation block per group of records (work, group, passage, seg, seq, chapter,
    html, author, annotates): its range mark, the two sides with their speakers, the comments in order. A group's comments make up one
    cell of the result."""
    def side(seg: str) -> Column:
        return F.min(F.when(F.col("seg") == seg, F.struct("seq", "html", "author")))

    comment = F.when(F.col("seg").startswith("comm"), F.struct("seq", F.coalesce("annotates", F.lit("")).alias("annotates"), F.col("seg").alias("name"), "html"))
    by = records.groupBy("work", "group").agg(F.min(F.struct("seq", "passage", "chapter")).alias("first"), side("sa").alias("sa"), side("ru").alias("ru"), F.sort_array(F.collect_list(comment)).alias("notes"))
    passage = F.col("first.passage")
    verse = F.regexp_replace(F.element_at(F.split(passage, r"\."), -1), r"^0+(?=.)", "")

    def block(name: str, css: str, speaker: str, colon: str) -> Column:
        own = F.when(F.col(f"{name}.author").isNotNull(), F.concat(F.lit(f'<span class="{speaker}">'), xml_escape(F.col(f"{name}.author")), F.lit(f"{colon}<br></span>"))).otherwise("")
        return F.when(F.col(name).isNotNull(), F.concat(F.lit(f'<div class="chapter_block {css}">'), own, F.col(f"{name}.html"), F.lit("</div>"))).otherwise("")

    sides = F.concat(block("sa", "iast", "iast_author", ""), block("ru", "translation", "translation_author", ":"))
    at = r"^([0-9]+)\.([0-9]+)"

    def note(x: Column) -> Column:
        number = F.regexp_replace(x["name"], "^comm", "")
        anchor = F.when(x["annotates"].rlike(at), F.concat(F.lit("comment_"), F.regexp_extract(x["annotates"], at, 1), F.lit("_"), F.regexp_extract(x["annotates"], at, 2), F.lit("_"), number)).otherwise(F.concat(F.lit("comment_"), number))
        return F.concat(F.lit('<div class="comment_item" id="'), anchor, F.lit('">'), x["html"], F.lit("</div>"))

    mark = F.concat(F.lit(f'<div class="range" title="{title} '), xml_escape(F.coalesce(F.col("first.chapter"), F.lit(""))), F.lit(". "), verse, F.lit(f'" id="{title} ({credit}): '), verse, F.lit('">'), verse, F.lit("</div>"))
    content = F.when(sides != "", F.concat(F.lit('<div class="chapter_content">'), sides, F.lit("</div>"))).otherwise("")
    notes = F.when(F.size("notes") > 0, F.concat(F.lit('<div class="comments">'), F.array_join(F.transform("notes", note), ""), F.lit("</div>"))).otherwise("")
    whole = F.concat(F.lit('<div class="citation_block" id="'), passage, F.lit('">'), mark, content, notes, F.lit("</div>"))
    return by.select("work", "group", passage.alias("passage"), F.col("first.chapter").alias("chapter"), F.col("first.seq").alias("first_seq"), whole.alias("block"))


def document_lines(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """(work, natural, part, line): the lines of each work's document in the order of natural and part: the title as a comment, blocks in the
    natural order of their passages, a heading before the first block of a chapter, and the end.

    titles: (work, title). A heading is known from the block before it, over narrow rows of a work."""
    rows = blocks.withColumn("natural", F.concat(F.lit("m"), X.natural_key(F.col("passage")), F.lit(" "), F.lpad(F.col("first_seq").cast("string"), 12, "0")))
    order = Window.partitionBy("work").orderBy("natural")
    before = F.lag(F.struct(F.coalesce("chapter", F.lit("")).alias("chapter"))).over(order)
    heads = rows.select("work", "natural", F.coalesce("chapter", F.lit("")).alias("chapter"), before.alias("before")).where(F.col("before").isNull() | (F.col("before.chapter") != F.col("chapter"))).where("chapter <> ''")
    heading = F.concat(F.lit('<div class="chapter_title" id="'), "chapter", F.lit('">'), "chapter", F.lit("</div>"))
    first = titles.select("work", F.lit("a").alias("natural"), F.lit(0).alias("part"), F.concat(F.lit("<!-- "), "title", F.lit(" --!>")).alias("line"))
    last = titles.select("work", F.lit("z").alias("natural"), F.lit(0).alias("part"), F.lit("</body></html>").alias("line"))
    inner = rows.select("work", "natural", F.lit(1).alias("part"), F.col("block").alias("line")).unionByName(heads.select("work", "natural", F.lit(0).alias("part"), heading.alias("line")))
    return first.unionByName(inner).unionByName(last)


def write_documents(lines: DataFrame, folder: str) -> None:
    """A text file in a folder work=... for each work; a work's lines are written by one task, in order, and spill while they are sorted."""
    ordered = lines.repartition("work").sortWithinPartitions("work", "natural", "part")
    ordered.select("work", F.col("line").alias("value")).write.mode("overwrite").partitionBy("work").text(folder)


def write_lines(rows: DataFrame, order: list[str], line: str, path: str, header: str, footer: str = "") -> None:
    """Rows in order as lines of text parts, behind a header and before a footer."""
    spark = rows.sparkSession
    body = rows.select(F.lit(1).alias("__k"), *order, F.col(line).alias("value"))
    ends = spark.createDataFrame([(0, header), *([(2, footer)] if footer else [])], "__k int, value string")
    body.unionByName(ends, allowMissingColumns=True).orderBy("__k", *order).select("value").write.mode("overwrite").text(path)
