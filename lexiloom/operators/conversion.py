"""Corpus HTML and dictionary lines to canonical segment records.

Lines come as (work, line_no, line). A work's order is kept by windows over its own lines, whose rows are narrowed to what the
order needs before they meet; numbers of duplicates come from windows over works and passages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import sanskrit as K
from ..functions import scripts as S
from ..functions import text as X

RECORD = ("id", "work", "passage", "seg", "group", "lang", "script", "text", "html", "slp1", "structure", "chapter", "annotates", "author", "dhruva", "needs_review", "line_no", "seg_no")
#: Roman numbers of the books of the long epic, in its range titles.
ROMAN = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII".split()
#: Shapes of dictionary lines without five cells.
CIRCLE = r"^°(.+?)\s+/([^/]+)/\s+(.*)$"
HEADED = r"^[0-9]+\s+(\S+)\s+/([^/]+)/\s+/([^/]+)/\s+/([^/]+)/\s+(.*)$"
CELLS = r"^/([^/]*)/\t/([^/]*)/\t/([^/]*)/\t/([^/]*)/\t(.*)$"


def source_titles(lines: DataFrame) -> DataFrame:
    """(work, title): the comment on a work's first line, without its marks."""
    first = lines.groupBy("work").agg(F.min(F.struct("line_no", "line"))["line"].alias("line"))
    return first.select("work", F.regexp_replace(F.regexp_replace(F.trim("line"), r"\s*--[>!]+$", ""), r"^<!--\s*", "").alias("title"))


def corpus_lines(lines: DataFrame) -> DataFrame:
    """(work, line_num, line_html, line_text, link_id, chapter) of a work's lines after its title; blank and frame lines go.

    The chapter is the last H1 heading at or before the line."""
    body = lines.withColumn("line_html", F.trim("line")).where(f"line_no > 0 and line_html != '' and not line_html rlike r'{M.FRAME}'")
    own = F.when(F.col("line_html").rlike(r"(?i)<H1>.*?</H1>"), M.remove_tags(F.regexp_extract("line_html", r"(?i)<H1>(.*?)</H1>", 1)))
    upto = Window.partitionBy("work").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    text = M.remove_tags(F.regexp_replace("line_html", r'(?i)<span class="endchapter">.*', ""))
    return body.select("work", F.col("line_no").alias("line_num"), "line_html", text.alias("line_text"), M.link_id(F.col("line_html")).alias("link_id"), F.coalesce(F.last(own, ignorenulls=True).over(upto), F.lit("")).alias("chapter"))


def titled_passage(title: Column, work: Column) -> Column:
    """The passage that a range title ends in: chapter.verse, with the book before it in the long epic; null if there is none."""
    three, two = r"\b([IVX]+)\.\s*([0-9]+)\.\s*([0-9]+(?:-[0-9]+)?)\s*$", r"([0-9]+)\.\s*([0-9]+(?:-[0-9]+)?)\s*$"
    numbers = F.create_map(*(F.lit(x) for k, r in enumerate(ROMAN) for x in (r, str(k + 1))))
    book = F.try_element_at(numbers, F.regexp_extract(title, three, 1))
    full = F.when(work.contains("mahabharata") & title.rlike(three) & book.isNotNull(), F.concat_ws(".", book, F.regexp_extract(title, three, 2), F.regexp_extract(title, three, 3)))
    return F.coalesce(full, F.when(title.rlike(two), F.concat_ws(".", F.regexp_extract(title, two, 1), F.regexp_extract(title, two, 2))))


def sniff(lines: DataFrame) -> DataFrame:
    """(work, path): clean where a work's first citation block has an id, else range."""
    blocks = lines.where(F.col("line").rlike("class=[\"']citation_block[\"']"))
    return blocks.groupBy("work").agg(F.min(F.struct("line_no", F.col("line").rlike(M.BLOCK_ID).alias("id")))["id"].alias("c")).select("work", F.when(F.col("c"), "clean").otherwise("range").alias("path"))


def comment_items(c: Column) -> Column:
    """Array of (anchor, html): comment items of a line; a div inside an item belongs to it.

    A fold over the pieces that begin with a div's start or end tag keeps the depth inside the open item."""
    pieces = F.split(c, r"(?=<div\b)|(?=</div>)")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("anchor"), F.lit("").alias("html"), F.array().cast("array<struct<anchor:string,html:string>>").alias("done"))

    def step(s: Column, p: Column) -> Column:
        opens, ends, begins = p.startswith("<div"), p.startswith("</div>"), p.rlike(f"^{M.COMMENT}")
        fresh, closing = (s["depth"] == 0) & begins, (s["depth"] == 1) & ends
        depth = F.when(fresh, 1).when(s["depth"] == 0, 0).when(opens, s["depth"] + 1).when(ends, s["depth"] - 1).otherwise(s["depth"])
        anchor = F.when(fresh, F.regexp_extract(p, M.COMMENT, 1)).otherwise(s["anchor"])
        inner = F.when(fresh, F.regexp_replace(p, f"^{M.COMMENT}", "")).when((s["depth"] > 0) & ~closing, F.concat(s["html"], p)).otherwise("")
        done = F.when(closing, F.concat(s["done"], F.array(F.struct(s["anchor"].alias("anchor"), s["html"].alias("html"))))).otherwise(s["done"])
        return F.struct(depth.alias("depth"), anchor.alias("anchor"), inner.alias("html"), done.alias("done"))

    return F.aggregate(pieces, start, step, lambda s: s["done"])


def verse_records(lines: DataFrame, after_z: str = "number") -> DataFrame:
    """Records of verse works: of each citation block its Sanskrit and Russian side, if they have text, and its comments.

    A passage met again gets a letter. From the 27th on it gets a number of its own, from the sequence of the work that also
    numbers comments whose anchor names nothing; with `after_z` "running" the letters run on through the code points, as in the
    reference's older exporter. A comment belongs to the verse that its anchor names if the work has it with text, else to that
    without the quarter's letter, else to the block it stands in."""
    if after_z not in ("number", "running"):
        raise ValueError(f"after_z is number or running, not {after_z}")
    paths = sniff(lines)
    blocks = lines.where(F.col("line").contains("citation_block") & (F.col("line_no") > 0)).join(paths, "work")  # one small row a work
    raw = F.when(F.col("path") == "clean", F.nullif(F.regexp_extract("line", M.BLOCK_ID, 1), F.lit(""))).otherwise(titled_passage(F.nullif(F.regexp_extract("line", M.RANGE_TITLE, 1), F.lit("")), F.col("work")))
    heading = F.trim(F.regexp_replace(F.regexp_extract("line", M.CHAPTER_TITLE, 1), "<[^>]+>", ""))
    before = Window.partitionBy("work").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marks = lines.where(F.col("line").rlike(M.CHAPTER_TITLE)).select("work", "line_no", heading.alias("own"))
    at = blocks.select("work", "line_no", raw.alias("raw"), F.col("line")).where("raw is not null")
    # Headings are carried over narrow rows: places of blocks and headings, without their text.
    places = at.select("work", "line_no").withColumn("own", F.lit(None).cast("string")).unionByName(marks)
    carried = places.withColumn("chapter", F.last("own", ignorenulls=True).over(before)).where("own is null").select("work", "line_no", F.coalesce("chapter", F.lit("")).alias("chapter"))
    n = F.row_number().over(Window.partitionBy("work", "raw").orderBy("line_no")) - 1
    unnamed = F.size(F.filter(comment_items(F.col("line")), lambda x: M.comment_target(x["anchor"]).isNull()))
    numbered = at.select("work", "line_no", "raw", unnamed.alias("unnamed")).withColumn("dup", n).withColumn("over", ((F.col("dup") > 25) & F.lit(after_z == "number")).cast("int"))
    taken = F.coalesce(F.sum(F.col("unnamed") + F.col("over")).over(Window.partitionBy("work").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = numbered.withColumn("taken", taken + F.col("over"))  # numbers of the work up to this block's own
    suffix = X.letter_suffix(F.col("dup")) if after_z == "number" else X.running_suffix(F.col("dup"))
    minted = numbered.select("work", "line_no", "raw", "taken", F.when(F.col("over") == 1, F.concat(F.lit("p"), F.col("taken").cast("string"))).otherwise(F.concat("raw", suffix)).alias("passage"))
    rows = at.drop("raw").join(minted, ["work", "line_no"]).join(carried, ["work", "line_no"])
    line = F.col("line")
    sides = rows.select("*", M.block(line, M.SANSKRIT).alias("sa"), M.block(line, M.TRANSLATION).alias("ru"))
    sides = sides.select("*", M.searchable(M.without_author(F.col("sa"))).alias("sa_text"), M.searchable(M.without_author(F.col("ru"))).alias("ru_text"), comment_items(line).alias("items"))
    has = (M.searchable(F.col("sa")) != "") | (M.searchable(F.col("ru")) != "")
    known = sides.where(has).select("work", F.col("raw").alias("hit")).distinct()

    def record(seg: Column, passage: Column, group: Column, text: Column, html: Column, lang: str, script: str, slp1: Column, own: Column, dhruva: Column, seg_no: Column) -> Column:
        return F.struct(
            seg.alias("seg"), passage.alias("passage"), F.concat("work", F.lit(":"), group).alias("group"), F.lit(lang).alias("lang"), F.lit(script).alias("script"), text.alias("text"), html.alias("html"), slp1.alias("slp1"), own.alias("author"), dhruva.alias("dhruva"), seg_no.alias("seg_no")
        )

    p, none = F.col("passage"), F.lit(None).cast("string")
    sa = F.when(M.searchable(F.col("sa")) != "", record(F.lit("sa"), p, p, K.strip_accents(F.col("sa_text")), F.trim(M.without_author(F.col("sa"))), "sa", "iast", S.iast_to_slp1(K.strip_accents(F.col("sa_text"))), M.author(F.col("sa")), F.col("sa").contains("॥dhruva॥"), F.lit(0)))
    ru = F.when(M.searchable(F.col("ru")) != "", record(F.lit("ru"), p, p, F.col("ru_text"), F.trim(M.without_author(F.col("ru"))), "ru", "cyrillic", none, M.author(F.col("ru")), F.col("ru").rlike("<span\\s+class=[\"']translation_dhruva[\"']"), F.lit(1)))
    own = sides.withColumn("r", F.explode(F.array_compact(F.array(sa, ru)))).select("work", "line_no", "chapter", "r.*")
    own = own.withColumn("id", F.concat("work", F.lit(":"), "passage", F.lit("#"), "seg")).withColumn("annotates", none).withColumn("needs_review", F.lit(False))

    # Comments: the anchor's verse, with the epic's book before it, is looked for among the work's verses, then without its letter.
    book = F.regexp_extract("work", "^0*([0-9]+)_mahabharata", 1)
    target = M.comment_target(F.col("item.anchor"))
    notes = sides.select("work", "line_no", "chapter", "passage", "taken", F.posexplode("items").alias("k", "item")).withColumn("target", F.when((book != "") & target.rlike(r"^[0-9]+\.[0-9]"), F.concat_ws(".", book, target)).otherwise(target))
    notes = notes.withColumn("bare", F.when(F.col("target").rlike(r"\p{L}$"), F.regexp_replace("target", r"\p{L}$", "")))
    for name in ("target", "bare"):
        hit = known.withColumnRenamed("hit", name).withColumn(f"{name}_known", F.lit(True))
        notes = notes.join(hit, ["work", name], "left")
    lost = F.concat(F.lit("c."), F.when(F.col("chapter") == "", "0").otherwise(F.col("chapter")), F.lit(".p"), (F.col("taken") + F.row_number().over(Window.partitionBy("work", "line_no", F.col("target").isNull()).orderBy("k"))).cast("string"))
    notes = notes.withColumn("annotates", F.when(F.col("target").isNull(), lost).when(F.col("target_known"), F.col("target")).when(F.col("bare_known"), F.col("bare")).otherwise(F.col("passage")))
    m = F.row_number().over(Window.partitionBy("work", "annotates").orderBy("line_no", "k"))
    notes = notes.withColumn("m", m).select(
        "work", "line_no", "chapter", F.concat(F.lit("comm"), "m").alias("seg"), F.concat("annotates", F.lit(".comm"), "m").alias("passage"), F.concat("work", F.lit(":"), "annotates").alias("group"), F.lit("ru").alias("lang"), F.lit("cyrillic").alias("script"),
        M.searchable(F.col("item.html")).alias("text"), F.trim("item.html").alias("html"), none.alias("slp1"), none.alias("author"), F.lit(False).alias("dhruva"), (F.col("k") + 2).alias("seg_no"), F.concat("work", F.lit(":"), "annotates", F.lit(".comm"), "m").alias("id"), "annotates",
        F.col("target").isNull().alias("needs_review"),
    )
    return own.unionByName(notes).withColumn("structure", F.lit("verse")).select(*RECORD)


def dictionary_records(lines: DataFrame) -> DataFrame:
    """(work, entry, headword, iast, slp1, cyr, gloss, kind): entries e1, e2, ... of dictionary works in the order of their lines."""
    body = lines.where((F.trim("line") != "") & (F.col("line_no") > 0))
    c = F.col("line")

    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(c, pattern, k)

    kind = F.when(c.rlike(CELLS), "cells").when(c.rlike(CIRCLE), "circle").when(c.rlike(HEADED), "headed").when(c.rlike("/[^/]+/"), "slashed").otherwise("plain")
    iast = F.when(F.col("kind") == "cells", part(CELLS, 2)).when(F.col("kind") == "circle", part(CIRCLE, 2)).when(F.col("kind") == "headed", part(HEADED, 2)).when(F.col("kind") == "slashed", part("/([^/]+)/", 1)).otherwise("")
    slp1 = F.when(F.col("kind") == "cells", part(CELLS, 3)).otherwise(S.iast_to_slp1(F.col("iast")))
    headword = F.when(F.col("kind") == "cells", part(CELLS, 1)).when(F.col("kind") == "circle", part(CIRCLE, 1)).when(F.col("kind") == "headed", part(HEADED, 1)).otherwise("")
    cyr = F.when(F.col("kind") == "cells", part(CELLS, 4)).when(F.col("kind") == "headed", part(HEADED, 4)).otherwise("")
    gloss = F.when(F.col("kind") == "cells", part(CELLS, 5)).when(F.col("kind") == "circle", part(CIRCLE, 3)).when(F.col("kind") == "headed", part(HEADED, 5)).otherwise(c)
    rows = body.withColumn("kind", kind).withColumn("iast", iast)
    order = F.row_number().over(Window.partitionBy("work").orderBy("line_no"))
    return rows.select("work", F.concat(F.lit("e"), order.cast("string")).alias("entry"), headword.alias("headword"), "iast", slp1.alias("slp1"), cyr.alias("cyr"), gloss.alias("gloss"), "kind")


def prose_records(lines: DataFrame) -> DataFrame:
    """(work, passage, chapter, text): paragraphs c{n}.p{m}, chapters counting headings (H1 or a chapter title); before any heading p{m}."""
    body = lines.where((F.col("line_no") > 0) & (F.trim("line") != "") & ~F.col("line").rlike(M.FRAME))
    is_heading = F.col("line").rlike(r"(?i)<H1\b") | F.col("line").rlike(M.CHAPTER_TITLE)
    rows = body.select("work", "line_no", is_heading.alias("heading"), M.searchable(F.col("line")).alias("text")).withColumn("chapter", F.sum(F.col("heading").cast("int")).over(Window.partitionBy("work").orderBy("line_no")))
    m =F.row_number().over(Window.partitionBy("work", "chapter").orderBy("line_no"))
    passage = F.when(F.col("chapter") > 0, F.concat(F.lit("c"), F.col("chapter").cast("string"), F.lit(".p"), m.cast("string"))).otherwise(F.concat(F.lit("p"), m.cast("string")))
    return rows.where("not heading and text != ''").select("work", passage.alias("passage"), F.col("chapter").cast("int").alias("chapter"), "text")
