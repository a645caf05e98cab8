"""Loading a corpus: checks, normalised keys, versions, one source again, and what the corpus says of itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import export, refs, search


def read_corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """(work, line_no, line) of text files, which are read in splits: a line's number is that within its split behind the lines of the splits
    before it. Rows of a split are numbered among themselves only."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("m"))
    numbered = raw.withColumn("n", F.row_number().over(Window.partitionBy("file", "block").orderBy("m")) - 1)
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("c"))
    before = counts.select("file", "block", (F.sum("c").over(Window.partitionBy("file").orderBy("block")) - F.col("c")).alias("before"))  # a row a split
    work = F.regexp_replace(F.regexp_replace(F.url_decode("file"), "^.*/", ""), r"\.[A-Za-z_]+$", "")
    return numbered.join(before, ["file", "block"]).select(work.alias("work"), (F.col("before") + F.col("n")).alias("line_no"), F.col("value").alias("line"))


def faults(lines: DataFrame, sources: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(fault, source_slug, n): missing and repeated ids, sources without lines, lines without a source, and, if `expected` (source_slug,
    record_count) is given, counts that differ from it."""
    missing = lines.where(F.coalesce("canonical_id", F.lit("")) == "").groupBy("source_slug").agg(F.count("*").alias("n")).select(F.lit("missing_id").alias("fault"), "source_slug", "n")
    repeated = lines.groupBy("source_slug", "canonical_id").agg(F.count("*").alias("c")).where("c > 1 and canonical_id <> ''").groupBy("source_slug").agg(F.count("*").alias("n")).select(F.lit("repeated_id").alias("fault"), "source_slug", "n")
    counts = lines.groupBy("source_slug").agg(F.count("*").alias("n"))
    named = sources.select(F.col("slug").alias("source_slug"))
    empty = named.join(counts, "source_slug", "left_anti").select(F.lit("empty_source").alias("fault"), "source_slug", F.lit(0).cast("long").alias("n"))
    unknown = counts.join(named, "source_slug", "left_anti").select(F.lit("unknown_source").alias("fault"), "source_slug", "n")
    found = missing.unionByName(repeated).unionByName(empty).unionByName(unknown)
    if expected is None:
        return found
    differ = expected.join(counts, "source_slug", "left").where(F.col("record_count") != F.coalesce("n", F.lit(0)))
    return found.unionByName(differ.select(F.lit("wrong_count").alias("fault"), "source_slug", F.coalesce("n", F.lit(0)).alias("n")))


def load(lines: DataFrame, sources: DataFrame, root: str, version: str, expected: DataFrame | None = None) -> int:
    """Write a checked corpus with its search keys as a new version, by source, and name it; nothing is named if there is a fault."""
    wrong = faults(lines, sources, expected).limit(20).collect()
    if wrong:
        raise ValueError(f"the corpus is not loaded: {[tuple(r) for r in wrong]}")
    return export.publish(search.with_norm(lines), root, version, partition="source_slug")


def reload_source(lines: DataFrame, folder: str) -> None:
    """Replace the lines of the sources that `lines` has and of no others; done again, it changes nothing."""
    search.with_norm(lines).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_slug").parquet(folder)


def vanished(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source_slug): sources of the corpus before that the one after has not."""
    return before.select("source_slug").distinct().join(after.select("source_slug").distinct(), "source_slug", "left_anti")


def meta(lines: DataFrame, version: str) -> DataFrame:
    """(key, value): version, numbers of sources and lines, and a hash of every source's first and last id and counts, in order of slugs."""
    by = refs.manifest(lines)
    marks = F.array_join(F.transform(F.sort_array(F.collect_list(F.concat_ws(":", "source_slug", "record_count", "first_id", "last_id", "chars"))), lambda x: x), "\n")
    one = by.agg(F.count("*").alias("sources"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("lines"), F.sha2(marks, 256).alias("hash"))  # a row a source
    pairs = [("corpus_version", F.lit(version)), ("source_count", F.col("sources").cast("string")), ("line_count", F.col("lines").cast("string")), ("input_manifest_hash", F.col("hash"))]
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs))).alias("p")).select("p.key", "p.value")


def health(lines: DataFrame, sources: DataFrame, canary: str) -> DataFrame:
    """One row: sources, lines, and whether a search that must have hits has any."""
    hits = search.search_plain(lines, sources, search.SearchSpec(canary, limit=1)).agg((F.count("*") > 0).alias("search_ok"))
    return sources.agg(F.count("*").alias("sources")).crossJoin(lines.agg(F.count("*").alias("lines"))).crossJoin(hits)  # three single rows
