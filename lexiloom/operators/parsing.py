"""Line-oriented sources: verses that end in a mark, articles, glossaries, indexes, rule files, TEI; and the words in them.

Lines come as (work, line_no, line). What a parser carries from line to line is a running count or a last value over a work's
lines; only texts that make up one cell of the result are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scripts as S

#: What a word is, and what ends a sentence before the next.
CYRILLIC_WORD, SENTENCE_END = r"[а-яА-ЯёЁ]+(?:-[а-яА-ЯёЁ]+)*", r"[.!?…»\"]$"
#: Marks and headings of the sources.
VERSE_MARK = r"//\s*sokss_([0-9]+),([0-9]+)\.([0-9]+)(?:\s*\([^)]*\))?\s*//"
WAVE, BOOK = r"^##\s*([0-9]+)\.([0-9]+)\.?", r"(?i)^КНИГА\s+"
ARTICLE = r"(?i)^(?:<H1>)?Махабхарата\s+([0-9]+(?:-[0-9]+)?)\.\s+(.+?)(?:</H1>)?\s*$"
PAGE_MARK = r"^\s*-[0-9]+-\s*$"
GLOSS = r"^([А-ЯЁ][А-Яа-яёЁIVXLC\-\s]{0,80}?)(?:\s*\(([^)]{1,80})\))?\s*[–—\-−]\s+(.+)$"
LABEL = r"^(\S.{0,80}?)\s*[–—]\s+(.+)$"
TEI_MARK = r"//\s*([A-Za-z]+)_([0-9]+)\.([0-9]+)\s*//\s*$"
#: Feminine ordinals from first to nineteenth, of the tens, and the cardinal tens that stand before a unit.
UNITS = "первая вторая третья четвертая пятая шестая седьмая восьмая девятая десятая одиннадцатая двенадцатая тринадцатая четырнадцатая пятнадцатая шестнадцатая семнадцатая восемнадцатая девятнадцатая".split()
TENS, BEFORE = "двадцатая тридцатая сороковая пятидесятая шестидесятая семидесятая восьмидесятая девяностая".split(), "двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split()
#: Cyrillic letters and the Latin ones that look like them; Russian letters only the other way; jers that scholars write in Latin words.
TO_LATIN = ("аеорсухіѕјһАВЕКМНОРСТХІЈЅҮ", "aeopcyxisjhABEKMHOPCTXIJSY")
TO_CYRILLIC, JERS = ("aceopxyACBEHKMOPTX", "асеорхуАСВЕНКМОРТХ"), "ьЪъ"

#: In how many shares the entries of one glossary name are joined.
SHARES = 8


def _joined(rows: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """(keys, text): texts of a key in order with single blanks between."""
    by = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("xs"))
    return by.select(*keys, F.trim(F.regexp_replace(F.array_join(F.transform("xs", lambda x: x["text"]), " "), r"\s+", " ")).alias("text"))


# -- words ------------------------------------------------------------------------------------------------


def words_in_place(docs: DataFrame, id_col: str, text_col: str = "text", word: str = CYRILLIC_WORD) -> DataFrame:
    """(id, k, surface, start from 0, sentence_initial): words with their place; the first of a text, and those behind the end of a
    sentence, begin one."""
    c = F.col(text_col)
    pieces = F.arrays_zip(F.regexp_extract_all(c, F.lit(word), 0).alias("surface"), F.slice(F.split(c, word, -1), 1, F.size(F.regexp_extract_all(c, F.lit(word), 0))).alias("gap"))
    rows = docs.select(id_col, F.posexplode(pieces).alias("k", "p")).select(id_col, "k", "p.surface", "p.gap")
    upto = Window.partitionBy(id_col).orderBy("k")
    start = F.sum(F.length("gap") + F.length("surface")).over(upto) - F.length("surface")
    first = (F.col("k") == 0) | F.regexp_replace("gap", r"\s+$", "").rlike(SENTENCE_END)
    return rows.select(id_col, "k", "surface", start.alias("start"), first.alias("sentence_initial"))


def trusted_names(words: DataFrame, foreign: DataFrame, russian: DataFrame, exceptions: DataFrame) -> DataFrame:
    """words with `trusted`: a capital that does not begin a sentence is; any other word is if it is neither foreign nor, unless it is
    an exception, a Russian word. The three lists are tables of one column `form`; forms are looked up once each."""
    forms = words.select(F.lower("surface").alias("form")).distinct()
    for name, table in (("foreign", foreign), ("russian", russian), ("exception", exceptions)):
        forms = forms.join(table.select("form").distinct().withColumn(f"is_{name}", F.lit(True)), "form", "left")
    plain = ~F.coalesce("is_foreign", F.lit(False)) & (~F.coalesce("is_russian", F.lit(False)) | F.coalesce("is_exception", F.lit(False)))
    forms = forms.select("form", plain.alias("plain"))
    capital = F.col("surface").rlike(r"^\p{Lu}") & ~F.col("sentence_initial")
    return words.withColumn("form", F.lower("surface")).join(forms, "form").withColumn("trusted", capital | F.col("plain")).drop("form", "plain")


# -- verses and prose -------------------------------------------------------------------------------------


def marked_verses(lines: DataFrame) -> DataFrame:
    """(work, lambaka, taranga, sloka, iast, slp1): the lines up to a verse's mark are the verse; headers and what has no mark behind it go."""
    body = lines.where(~F.col("line").rlike("^[%#]") & (F.rtrim("line") != "")).withColumn("mark", F.regexp_extract("line", VERSE_MARK, 0))
    ends = (F.col("mark") != "").cast("int")
    upto = Window.partitionBy("work").orderBy("line_no")
    rows = body.withColumn("verse", F.sum(ends).over(upto) - ends).withColumn("text", F.rtrim(F.when(F.col("mark") != "", F.regexp_extract("line", rf"^(.*?){VERSE_MARK}", 1)).otherwise(F.col("line"))))
    marks = rows.where("mark <> ''").select("work", "verse", *(F.regexp_extract("mark", VERSE_MARK, k + 1).cast("int").alias(n) for k, n in enumerate(("lambaka", "taranga", "sloka"))))
    texts = _joined(rows, ["work", "verse"]).withColumn("iast", F.regexp_replace("text", r"[/ ]+$", ""))
    return marks.join(texts, ["work", "verse"]).where("iast <> ''").select("work", "lambaka", "taranga", "sloka", "iast", S.iast_to_slp1(F.col("iast")).alias("slp1"))


def numbered_prose(lines: DataFrame) -> DataFrame:
    """(work, lambaka, taranga, idx, text): prose lines numbered from 1, under the wave that the last header named (0 before any); the book
    is that of the work's first wave header."""
    c = F.trim("line")
    rows = lines.where(c != "").select("work", "line_no", c.alias("text")).withColumn("wave", F.when(F.col("text").rlike(WAVE), F.regexp_extract("text", WAVE, 2).cast("int")))
    upto = Window.partitionBy("work").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    book = rows.where("wave is not null").groupBy("work").agg(F.min(F.struct("line_no", F.regexp_extract("text", WAVE, 1).cast("int").alias("b")))["b"].alias("lambaka"))
    carried = rows.withColumn("taranga", F.coalesce(F.last("wave", ignorenulls=True).over(upto), F.lit(0))).where(~F.col("text").rlike(BOOK) & ~F.col("text").startswith("#"))
    return carried.withColumn("idx", F.row_number().over(Window.partitionBy("work").orderBy("line_no"))).join(book, "work", "left").select("work", F.coalesce("lambaka", F.lit(0)).alias("lambaka"), "taranga", "idx", "text")


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, kind verse or prose, text) of TEI files in document order: stanzas, and the prose of paragraphs without the stanzas in
    them. A file is parsed in one task."""
    import pyarrow as pa

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xml.etree.ElementTree as ET

        def spoken(e) -> str:
            return " ".join(x.strip() for x in e.itertext() if x.strip())

        def walk(e, out: list) -> None:
            name = e.tag.rpartition("}")[2]
            if name == "lg":
                out.append(("verse", " ".join(filter(None, (spoken(x) for x in e.iter() if x.tag.rpartition("}")[2] == "l")))))
                return
            if name == "p":
                own = [e.text or "", *(x for child in e for x in ("" if child.tag.rpartition("}")[2] == "lg" else spoken(child), child.tail or ""))]
                out.append(("prose", " ".join(x.strip() for x in own if x.strip())))
            for child in e:
                walk(child, out)

        for b in batches:
            for file, content in zip(b.column(0), b.column(1), strict=True):
                found: list = []
                for body in (x for x in ET.fromstring(content.as_py()).iter() if x.tag.rpartition("}")[2] == "body"):
                    walk(body, found)
                    break
                found = [x for x in found if x[1]]
                kinds, texts = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(found), pa.string()), pa.array(range(1, len(found) + 1), pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["file", "seq", "kind", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(kernel, "file string, seq long, kind string, text string")


def tei_passages(units: DataFrame) -> DataFrame:
    """(file, seq, kind, passage, chapter, text, needs_review): a stanza with a citation mark has its chapter and verse; other units are
    paragraphs of the chapter that the last mark named, 0 before any; a stanza without a mark is to be reviewed."""
    rows = units.withColumn("mark", F.when(F.col("kind") == "verse", F.regexp_extract("text", TEI_MARK, 0)).otherwise(""))
    marked = F.col("mark") != ""
    upto = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("chapter", F.coalesce(F.last(F.when(marked, F.regexp_extract("mark", TEI_MARK, 2)), ignorenulls=True).over(upto), F.lit("0"))).withColumn("marked", marked)
    n = F.row_number().over(Window.partitionBy("file", "chapter", "marked").orderBy("seq"))
    passage = F.when(F.col("marked"), F.concat_ws(".", "chapter", F.regexp_extract("mark", TEI_MARK, 3))).otherwise(F.concat(F.lit("c"), "chapter", F.lit(".p"), n.cast("string")))
    return rows.select("file", "seq", "kind", passage.alias("passage"), "chapter", F.trim(F.regexp_replace("text", TEI_MARK, "")).alias("text"), ((F.col("kind") == "verse") & ~F.col("marked")).alias("needs_review"))


# -- articles, glossaries, indexes --------------------------------------------------------------------------


def articles(lines: DataFrame, heading: str = ARTICLE) -> DataFrame:
    """(work, article, paragraph, volume, title, text): what follows a heading up to the next, cut at blank lines. A page mark is no line,
    and the blank lines about it cut nothing."""
    c = F.trim("line")
    kind = F.when(c.rlike(heading), "head").when(c == "", "blank").when(c.rlike(PAGE_MARK), "mark").otherwise("text")
    upto = Window.partitionBy("work").orderBy("line_no")
    rows = lines.select("work", "line_no", c.alias("text"), kind.alias("kind"))
    rows = rows.select("*", *(F.sum((F.col("kind") == k).cast("int")).over(upto).alias(f"n_{k}") for k in ("head", "blank", "mark")))
    heads = rows.where("kind = 'head'").select("work", F.col("n_head").alias("article"), F.regexp_extract("text", heading, 1).alias("volume"), F.trim(F.regexp_extract("text", heading, 2)).alias("title"))
    body = rows.where("kind = 'text' and n_head > 0").withColumn("article", F.col("n_head"))
    order = Window.partitionBy("work", "article").orderBy("line_no")
    before = F.lag(F.struct("n_blank", "n_mark")).over(order)
    cut = body.withColumn("before", before).withColumn("new", (F.col("before").isNull() | ((F.col("n_blank") > F.col("before.n_blank")) & (F.col("n_mark") == F.col("before.n_mark")))).cast("int"))
    numbered = cut.withColumn("paragraph", F.sum("new").over(order))
    return _joined(numbered, ["work", "article", "paragraph"]).join(heads, ["work", "article"]).select("work", "article", "paragraph", "volume", "title", "text")


def index_kind(title: Column) -> Column:
    t = F.upper(title)
    return F.when(t.contains("ФЛОР") | t.contains("ФАУН"), "flora").when(t.contains("ГЕОГРАФ") | t.contains("ЭТНИЧ"), "geo").when(t.contains("ИМЕН") | t.contains("ПЕРСОНАЖ"), "imen").otherwise("predmet")


def index_entries(lines: DataFrame, heading: str = ARTICLE) -> DataFrame:
    """(work, section, volume, title, kind, entry): entries under headings of indexes, one a line; blank lines and page marks are none."""
    c = F.trim(F.regexp_replace("line", "(?i)</?H1>", ""))
    rows = lines.select("work", "line_no", c.alias("text")).withColumn("is_head", F.col("text").rlike(heading) & F.upper("text").contains("УКАЗАТЕЛ"))
    rows = rows.withColumn("section", F.sum(F.col("is_head").cast("int")).over(Window.partitionBy("work").orderBy("line_no")))
    title = F.trim(F.regexp_replace(F.trim(F.regexp_extract("text", heading, 2)), r"\*+$", ""))
    heads = rows.where("is_head").select("work", "section", F.regexp_extract("text", heading, 1).alias("volume"), title.alias("title"))
    entries = rows.where(~F.col("is_head") & (F.col("text") != "") & ~F.col("text").rlike(PAGE_MARK) & (F.col("section") > 0))
    return entries.join(heads, ["work", "section"]).select("work", "section", "volume", "title", index_kind(F.col("title")).alias("kind"), F.col("text").alias("entry"))


def glossary(lines: DataFrame, start: str = GLOSS) -> DataFrame:
    """(work, entry, headword, iast, text): 'Headword (iast) – definition' with the lines that continue it, blank ones aside; lines before any
    entry go."""
    rows = lines.withColumn("text", F.trim("line")).where("text <> ''").withColumn("new", F.col("text").rlike(start))
    rows = rows.withColumn("entry", F.sum(F.col("new").cast("int")).over(Window.partitionBy("work").orderBy("line_no"))).where("entry > 0")
    heads = rows.where("new").select("work", "entry", F.trim(F.regexp_extract("text", start, 1)).alias("headword"), F.trim(F.regexp_extract("text", start, 2)).alias("iast"))
    bodies = _joined(rows.withColumn("text", F.when(F.col("new"), F.trim(F.regexp_extract("text", start, 3))).otherwise(F.col("text"))), ["work", "entry"])
    head = F.concat("headword", F.when(F.col("iast") != "", F.concat(F.lit(" ("), "iast", F.lit(")"))).otherwise(""))
    return bodies.join(heads, ["work", "entry"]).select("work", "entry", "headword", "iast", F.concat(head, F.lit(" – "), "text").alias("text"))


def bibliography(lines: DataFrame, start: str = LABEL) -> DataFrame:
    """(work, entry, label, text): a line 'Label – title', or one behind a blank line, begins an entry; others continue it."""
    rows = lines.withColumn("t", F.trim("line"))
    order = Window.partitionBy("work").orderBy("line_no")
    rows = rows.withColumn("prior", F.lag("t").over(order)).where("t <> ''").withColumn("labelled", F.col("t").rlike(start))
    rows = rows.withColumn("new", (F.col("labelled") | (F.coalesce("prior", F.lit("")) == "")).cast("int")).withColumn("entry", F.sum("new").over(order))
    label = F.max(F.when((F.col("new") == 1) & F.col("labelled"), F.trim(F.regexp_extract("t", start, 1))))
    first = rows.groupBy("work", "entry").agg(F.coalesce(label, F.lit("")).alias("label"))
    text = F.when(F.col("labelled"), F.concat(F.trim(F.regexp_extract("t", start, 1)), F.lit(" – "), F.trim(F.regexp_extract("t", start, 2)))).otherwise(F.col("t"))
    return _joined(rows.withColumn("text", text), ["work", "entry"]).join(first, ["work", "entry"]).select("work", "entry", "label", "text")


def iast_span(c: Column) -> Column:
    """The romanised word in a line's first brackets, up to a dash; '' if there is none or the brackets hold a Cyrillic letter."""
    span = F.regexp_extract(c, r"\(([^)]*)\)", 1)
    head = F.regexp_replace(F.trim(F.regexp_replace(span, "[—–].*$", "")), "^[«»\"']+|[«»\"']+$", "")
    return F.when(span.rlike(r"[\x{0400}-\x{04FF}]"), "").otherwise(F.trim(head))


def names_of(lines: DataFrame) -> DataFrame:
    """(work, line_no, headword, iast): a glossary's headword stands before a tab, else before a bracket, else before a blank."""
    c = F.col("line")
    tabbed, bracketed = c.contains("\t"), c.rlike(r"^.*? \([^)]*\)")
    head = F.when(tabbed, F.split_part(c, F.lit("\t"), F.lit(1))).when(bracketed, F.regexp_extract(c, r"^(.*?) \(([^)]*)\)", 1)).otherwise(F.split_part(c, F.lit(" "), F.lit(1)))
    iast = F.when(tabbed, iast_span(F.regexp_replace(c, "^[^\t]*\t", ""))).when(bracketed, iast_span(F.concat(F.lit("("), F.regexp_extract(c, r"^(.*?) \(([^)]*)\)", 2), F.lit(")")))).otherwise("")
    rows = lines.where((F.trim("line") != "") & ~F.ltrim("line").startswith("<!--"))
    return rows.select("work", "line_no", F.trim(head).alias("headword"), iast.alias("iast")).where("headword <> ''")


def join_names(names: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Glossary names with the rows of a table of proper nouns (cyrillic, slp1, witness) that are written alike, and how the two romanised
    forms agree; and per glossary its entries, those that were joined, and the rows made.

    A name and a noun that are met often give the product of their rows, so what one side alone decides is made before the join,
    and a name's entries are dealt over SHARES tasks, each with all the nouns of that name."""

    def plain(c: str) -> Column:
        return F.regexp_replace(F.lower(F.translate(c, "āīūṛṝḷḹṅñṭḍṇśṣṃḥ", "aiurrllnntdnssmh")), "[^a-z0-9]", "")

    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number, as the inputs' bytes say little of the rows to be made
    left = names.select("*", plain("iast").alias("plain"), F.pmod(F.hash("work", "line_no"), F.lit(SHARES)).alias("share")).repartition(n, "headword", "share")
    right = table.select(F.col("cyrillic").alias("headword"), "slp1", "witness", plain("witness").alias("other"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")).repartition(n, "headword", "share")
    keyed = left.join(right, ["headword", "share"])
    agreement = F.when(F.col("iast") == "", "NO_SPAN").when(F.col("plain") == F.col("other"), "MATCH").otherwise("MISMATCH")
    joined = keyed.select("work", "line_no", "headword", "iast", "slp1", "witness", agreement.alias("agreement"))
    counts = joined.groupBy("work").agg(F.countDistinct("line_no").alias("joined_entries"), F.count("*").alias("joined_rows"))
    return joined, names.groupBy("work").agg(F.count("*").alias("entries")).join(counts, "work", "left").fillna(0, ["joined_entries", "joined_rows"])


# -- numbers, spelling, rules ---------------------------------------------------------------------------------


def _forms(word: str) -> list[str]:
    """A feminine ordinal in the nominative and the genitive."""
    return [word, word[:-2] + ("ьей" if word.endswith("ья") else "ой")]


def ordinal(c: Column) -> Column:
    """The number of a feminine ordinal of one word or two, 1 to 99; null for anything else. The letter ё is е."""
    units = {f: k for k, w in enumerate(UNITS, 1) for f in _forms(w)}
    single = units | {f: 10 * k for k, w in enumerate(TENS, 2) for f in _forms(w)}
    tens = {w: 10 * k for k, w in enumerate(BEFORE, 2)}

    def of(table: dict[str, int], word: Column) -> Column:
        return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), word)

    words = F.split(F.regexp_replace(F.translate(F.lower(F.trim(c)), "ё", "е"), r"\s+", " "), " ")
    pair = of(tens, F.get(words, 0)) + of({w: n for w, n in units.items() if n <= 9}, F.get(words, 1))
    return F.when(F.size(words) == 1, of(single, F.get(words, 0))).when(F.size(words) == 2, pair)


def token_defect(c: Column) -> Column:
    """Why a run of letters is not of one script: null if it is (jers in a Latin word do not count)."""
    latin, cyrillic, deva = c.rlike(r"\p{IsLatin}"), c.rlike(r"\p{IsCyrillic}"), c.rlike("[ऀ-ॿ]")
    bare = F.regexp_replace(c, f"[{JERS}]", "")
    to_latin = ~F.translate(c, TO_LATIN[0], "").rlike(r"\p{IsCyrillic}")
    to_cyrillic = ~F.translate(c, TO_CYRILLIC[0], "").rlike(r"\p{IsLatin}")
    return F.when(deva & (latin | cyrillic), "flagged_devanagari").when(latin & cyrillic & bare.rlike(r"\p{IsCyrillic}"), F.when(to_latin, "mixed_cyr_in_lat").when(to_cyrillic, "mixed_lat_in_cyr").otherwise("flagged_unmappable"))


def repaired(c: Column, latin: bool) -> Column:
    """A token with its look-alikes in the script that is expected; null if that leaves letters of the other one, or changes none."""
    table, rest = (TO_LATIN, r"\p{IsCyrillic}") if latin else (TO_CYRILLIC, r"\p{IsLatin}")
    fixed = F.translate(c, *table)
    return F.when((fixed != c) & ~fixed.rlike(rest), fixed)


def defect_census(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(defect, tokens): letter runs by what is wrong with them."""
    runs = rows.select(F.explode(F.regexp_extract_all(text_col, F.lit(r"[\p{L}\p{M}]+"), 0)).alias("t"))
    return runs.select(token_defect(F.col("t")).alias("defect")).where("defect is not null").groupBy("defect").agg(F.count("*").alias("tokens"))


def phrases(lines: DataFrame) -> DataFrame:
    """(lemma, rubric) of lines 'lemma: rubric'; the last line of a lemma holds."""
    rows = lines.where(F.col("line").contains(": ")).select("line_no", F.lower(F.trim(F.substring_index("line", ": ", 1))).alias("lemma"), F.trim(F.regexp_replace("line", "^.*?: ", "")).alias("rubric"))
    return rows.groupBy("lemma").agg(F.max_by("rubric", "line_no").alias("rubric"))


def options(lines: DataFrame) -> DataFrame:
    """(lemma, variants array of (word, rubric)) of lines 'lemma: word - rubric; word - rubric'; the last line of a lemma holds."""
    rows = lines.where(F.col("line").contains(": ")).select("line_no", F.lower(F.trim(F.substring_index("line", ": ", 1))).alias("lemma"), F.split(F.regexp_replace("line", "^.*?: ", ""), "; ").alias("chunks"))
    pairs = F.transform(F.filter("chunks", lambda x: x.contains(" - ")), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, " - ", 1))).alias("word"), F.trim(F.regexp_replace(x, "^.*? - ", "")).alias("rubric")))
    return rows.select("line_no", "lemma", pairs.alias("variants")).where("size(variants) > 0").groupBy("lemma").agg(F.max_by("variants", "line_no").alias("variants"))


def resolve_option(variants: Column, sentence: Column) -> Column:
    """The rubric of the first variant whose word the sentence holds; null if none does."""
    return F.get(F.filter(variants, lambda v: F.contains(F.lower(sentence), v["word"])), 0)["rubric"]


def declension_rules(lines: DataFrame) -> DataFrame:
    """(class, case, suffix): blocks between blank lines, a class on the first line and then 'case suffix, suffix'; '_' is no suffix."""
    c = F.trim("line")
    rows = lines.select("work", "line_no", c.alias("text")).withColumn("block", F.sum((F.col("text") == "").cast("int")).over(Window.partitionBy("work").orderBy("line_no"))).where("text <> ''")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("work", "block").orderBy("line_no")))
    heads = rows.where("k = 1").select("work", "block", F.col("text").alias("class"))
    cases = rows.where("k > 1").select("work", "block", F.substring_index("text", " ", 1).alias("case"), F.explode(F.split(F.regexp_replace("text", r"^\S+ ?", ""), ",")).alias("suffix"))
    return cases.join(heads, ["work", "block"]).select("class", "case", F.when(F.trim("suffix") == "_", "").otherwise(F.trim("suffix")).alias("suffix"))


def declension_class(lemma: Column, indeclinable: str = "иую") -> Column:
    """The class that a lemma's last letter tells: а, я, or _ for a consonant; null for one that is not declined."""
    last = F.substring(lemma, -1, 1)
    return F.when(lemma == "", "_").when(F.instr(F.lit(indeclinable), last) > 0, F.lit(None)).when(last.isin("а", "я"), last).otherwise("_")


def declined(lemmas: DataFrame, rules: DataFrame) -> DataFrame:
    """(lemma, case, form): a lemma with the suffixes of its class; the vowel of the classes а and я gives way."""
    rows = lemmas.select("lemma", declension_class(F.col("lemma")).alias("class")).where("class is not null")
    stem = F.when(F.col("class") == "_", F.col("lemma")).otherwise(F.expr("substring(lemma, 1, length(lemma) - 1)"))
    return rows.join(rules, "class").select("lemma", "case", F.concat(stem, "suffix").alias("form"))


def lemma_pool(parts: dict[str, DataFrame]) -> DataFrame:
    """(lemma, tags): the union of lists of lemmas, each with the lists it is in."""
    rows = None
    for tag, df in parts.items():
        one = df.select(F.lower("lemma").alias("lemma"), F.lit(tag).alias("tag"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("lemma").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def agreed_input(reports: DataFrame) -> DataFrame:
    """One row: the hash that all reports (slug, input_hash) were made from, null if they differ or there are none, and how many hashes there are."""
    return reports.agg(F.when(F.countDistinct("input_hash") == 1, F.min("input_hash")).alias("input_hash"), F.countDistinct("input_hash").alias("hashes"))


def resolve_tokens(presented: DataFrame, issued: DataFrame, now: Column) -> DataFrame:
    """(token_hash, valid): presented tokens that were issued, have not expired and, where they are for one use, were not used. Why one is
    not valid is not told."""
    known = issued.groupBy("token_hash").agg(F.max(F.struct("issued_at", "expires_at", "used_at")).alias("t"))
    met = presented.select("token_hash").join(known, "token_hash", "left")
    return met.select("token_hash", F.coalesce((F.col("t.expires_at") >= now) & F.col("t.used_at").isNull(), F.lit(False)).alias("valid"))


def cached_stems(words: DataFrame, cache: DataFrame) -> DataFrame:
    """(word, stem, cached): stems of words from a cache (word, stems array); an empty list is an answer too, and never grows old; a word
    without stems stands for itself."""
    met = words.select("word").distinct().join(cache.select("word", "stems", F.lit(True).alias("cached")), "word", "left")
    stems = F.when(F.coalesce(F.size("stems"), F.lit(0)) > 0, F.col("stems")).otherwise(F.array("word"))
    return met.select("word", F.explode(stems).alias("stem"), F.coalesce("cached", F.lit(False)).alias("cached"))


# -- verses of running text ---------------------------------------------------------------------------------


def split_verses(texts: DataFrame, id_col: str = "id", speaker: str = r"^([А-ЯЁ][^.:()]{1,60}):\s*", number: str = r"\(\s*([0-9]+(?:\s*[-–]\s*[0-9]+)?)\s*\)") -> DataFrame:
    """(id, k, verse, author, text): the pieces of a text that end in a number in brackets. A piece may begin with its speaker, who goes on
    speaking until the next one; what is behind the last number goes."""
    parts = texts.select(id_col, F.posexplode(F.arrays_zip(F.split("text", number, -1).alias("piece"), F.regexp_extract_all("text", F.lit(number), 1).alias("verse"))).alias("k", "p"))
    rows = parts.select(id_col, "k", F.trim("p.piece").alias("piece"), F.regexp_replace("p.verse", r"\s", "").alias("verse")).where("verse is not null and piece <> ''")
    said = F.when(F.col("piece").rlike(speaker), F.trim(F.regexp_replace(F.regexp_extract("piece", speaker, 1), "[0-9]+$", "")))
    carried = F.last(said, ignorenulls=True).over(Window.partitionBy(id_col).orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(id_col, "k", "verse", carried.alias("author"), F.trim(F.regexp_replace("piece", speaker, "")).alias("text"))


def note_references(verses: DataFrame, notes: DataFrame, glued: str = r"[А-яёЁ»\)\]]([0-9]{1,3})(?![0-9(])") -> DataFrame:
    """(volume, verse_no, number): references to notes (volume, number) in verses (volume, verse_no, text): digits behind a letter or a
    closing mark that are a note's number, the first time in the volume."""
    found = verses.select("volume", "verse_no", F.posexplode(F.regexp_extract_all("text", F.lit(glued), 1)).alias("k", "digits")).withColumn("number", F.col("digits").cast("int"))
    known = found.join(notes.select("volume", "number").distinct(), ["volume", "number"], "left_semi")
    first = F.row_number().over(Window.partitionBy("volume", "number").orderBy("verse_no", "k"))
    return known.withColumn("n", first).where("n = 1").select("volume", "verse_no", "number")


def collapse_verses(chapters: DataFrame, jump: int = 50) -> DataFrame:
    """chapters (id, verses array of (start, end, text, debris, colophon)) with false verses put back.

    A fold over a chapter's verses, as what becomes of one depends on those that were kept: a verse that starts before the last one's end,
    or looks like a note, goes to the text of the one before (a colophon goes altogether), and one that is `jump` ahead goes."""
    kind = "array<struct<start:int,end:int,text:string>>"
    start = F.struct(F.lit(0).alias("upto"), F.array().cast(kind).alias("out"))

    def step(s: Column, v: Column) -> Column:
        some, known = F.size(s["out"]) > 0, v["start"].isNotNull()
        back, debris = some & known & (v["start"] < s["upto"]), some & known & v["debris"]
        gone = (debris & v["colophon"] & ~back) | (some & known & ~back & ~debris & (s["upto"] >= 1) & (v["start"] >= s["upto"] + jump))
        merged = (back | debris) & ~gone
        last = F.try_element_at(s["out"], F.lit(-1))
        joined = F.concat(F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), last["end"].alias("end"), F.trim(F.concat(last["text"], F.lit(" "), v["text"])).alias("text"))))
        kept = F.concat(s["out"], F.array(F.struct(v["start"].alias("start"), v["end"].alias("end"), v["text"].alias("text"))))
        return F.struct(F.when(gone | merged | ~known, s["upto"]).otherwise(v["end"]).alias("upto"), F.when(gone, s["out"]).when(merged, joined).otherwise(kept).alias("out"))

    return chapters.select("id", F.aggregate("verses", start, step, lambda s: s["out"]).alias("verses"))


# -- errata ---------------------------------------------------------------------------------------------------


def errata_entries(lines: DataFrame) -> DataFrame:
    """(work, entry, fields map) of files with a list of entries: '- key: value' begins one, '  key: value' goes on with it; comments and blank
    lines are nothing, quotes about a value go, and a value may hold colons."""
    pattern = r"^(?:- |\s+)([A-Za-z_]+):\s*(.*?)\s*$"
    rows = lines.where(F.col("line").rlike(pattern) & ~F.col("line").rlike(r"^\s*#")).withColumn("entry", F.sum(F.col("line").startswith("- ").cast("int")).over(Window.partitionBy("work").orderBy("line_no"))).where("entry > 0")
    value = F.regexp_replace(F.regexp_extract("line", pattern, 2), r"^(['\"])(.*)\1$", "$2")
    pairs = rows.groupBy("work", "entry", F.regexp_extract("line", pattern, 1).alias("key")).agg(F.max_by(value, "line_no").alias("value"))  # the last line of a key holds
    return pairs.groupBy("work", "entry").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("fields"))


def errata_report(applied: DataFrame) -> DataFrame:
    """(work, natural, line): a report's lines on errata (work, passage, read, instead, status), in the natural order of passages."""
    from ..functions import text as X

    mark = F.when(F.col("status") == "applied", "x").otherwise(" ")
    line = F.concat(F.lit("- ["), mark, F.lit("] "), "passage", F.lit(": "), "read", F.lit(" → "), "instead", F.when(F.col("status") == "applied", "").otherwise(F.concat(F.lit(" ("), "status", F.lit(")"))))
    return applied.select("work", X.natural_key(F.col("passage")).alias("natural"), line.alias("line"))
