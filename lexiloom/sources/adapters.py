"""The corpus model over driver tables, and readers of canonical files. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = ("id", "work", "passage", "seg", "group", "lang", "script", "text", "html", "slp1", "structure", "chapter", "annotates")
SEGMENT = T.StructType([*(T.StructField(k, T.StringType()) for k in STRINGS), T.StructField("seq", T.DoubleType()), T.StructField("deleted", T.BooleanType()), T.StructField("needs_review", T.BooleanType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, slug, sort_order: one row per distinct source of documents, a dimension table."""
    slugs = table(spark, sf_dir, "documents").select(F.col("source").alias("slug")).where("slug is not null").distinct()
    return slugs.select(F.dense_rank().over(Window.orderBy("slug")).alias("source_id"), "slug").withColumn("sort_order", F.col("source_id"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus lines from documents; line_num is the document's number, a double as in the corpus model, so no window is needed."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("source_slug"), F.col("doc_id").cast("double").alias("line_num"), F.col("text").alias("line_text"), F.col("lang").alias("chapter"), F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("canonical_id")
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments from conversations: user is the sa side, assistant the ru side, system commentary."""
    seg = F.when(F.col("role") == "user", "sa").when(F.col("role") == "assistant", "ru").otherwise("comm")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group_id"), seg.alias("seg"), F.col("turn").alias("seq"), "text")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, line_no from 0, line): HTML cut at line feeds and before block tags."""
    cut = F.split(F.regexp_replace("html", r"<(h1|h2|p|li|div)([ >])", "\n<$1$2"), "\n")
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(cut).alias("line_no", "line"))


def read_canonical(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Live canonical records of JSON-lines files; strict stops at broken lines and missing ids, else broken lines are dropped."""
    rows = spark.read.schema(SEGMENT).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path).where(~F.coalesce("deleted", F.lit(False)))
    return rows.withColumn("id", F.coalesce("id", F.raise_error(F.lit("a record has no id")).cast("string"))) if strict else rows.where("id is not null")


def read_corpus_html(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of HTML corpora; the file's order is kept by its byte order within one file split."""
    raw = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), "value")
    return raw.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """CoNLL-U sentences: sent_id, text and ten-column rows; paragraphs are the records."""
    raw = spark.read.option("lineSep", "\n\n").text(path).where(F.length(F.trim("value")) > 0)
    every = F.split("value", "\n")
    rows = F.transform(F.filter(every, lambda x: ~x.startswith("#") & (F.length(x) > 0)), lambda x: F.split(x, "\t"))
    return raw.select(F.regexp_extract("value", r"(?m)^# sent_id = (.*)$", 1).alias("sent_id"), F.regexp_extract("value", r"(?m)^# text = (.*)$", 1).alias("text"), rows.alias("rows"))
