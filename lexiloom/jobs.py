"""Jobs from the command line: python -m lexiloom.jobs convert | load | search | roll-back | validate-conllu."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import annotation, conversion, export, ingest, search
from .sources import adapters


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    """Corpus HTML files to canonical records, as JSON lines."""
    conversion.verse_records(ingest.read_corpus_lines(spark, a.input)).write.mode("overwrite").json(a.output)


def load(spark: SparkSession, a: argparse.Namespace) -> None:
    """Canonical records to a new version of the searchable corpus."""
    rows = adapters.read_canonical(spark, a.input)
    lines = rows.select(F.col("work").alias("source_slug"), F.col("seq").alias("line_num"), F.col("text").alias("line_text"), F.col("html").alias("line_html"), "chapter", F.col("id").alias("canonical_id"), F.col("passage").alias("link_id"))
    print(ingest.load(lines, lines.select(F.col("source_slug").alias("slug")).distinct(), a.output, a.version))


def find(spark: SparkSession, a: argparse.Namespace) -> None:
    """Hits of a query in the corpus that is published, as JSON lines."""
    lines = export.read_published(spark, a.input)
    slugs = lines.select(F.col("source_slug").alias("slug")).distinct()
    sources = slugs.withColumn("source_id", F.xxhash64("slug")).withColumn("sort_order", F.col("slug"))
    hits, stats = search.dispatch(lines, sources, a.query, a.mode, a.case_sensitive, a.whole_word, limit=a.limit)
    for row in search.export_rows(hits, a.query).toJSON().toLocalIterator():  # at most the limit
        print(row)
    if stats is not None:
        print(stats.toJSON().first())


def roll_back(spark: SparkSession, a: argparse.Namespace) -> None:
    """Take the version before the present one."""
    print(export.roll_back(spark, a.input))


def validate_conllu(spark: SparkSession, a: argparse.Namespace) -> int:
    """Faults of CoNLL-U files by rule; errors end with 1."""
    s = adapters.read_conllu(spark, a.input)
    s = s.select(F.lit(a.input).alias("file"), F.monotonically_increasing_id().alias("pos"), "sent_id", "text", "rows")
    codes = {r["code"]: r["n"] for r in annotation.conllu_faults(s).groupBy("code").agg(F.count("*").alias("n")).collect()}
    print(codes)
    return int(any(k.startswith("E") for k in codes))


JOBS = {"convert": convert, "load": load, "search": find, "roll-back": roll_back, "validate-conllu": validate_conllu}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexiloom")
    p.add_argument("job", choices=JOBS)
    p.add_argument("--input", required=True)
    p.add_argument("--output")
    p.add_argument("--version", default="1")
    p.add_argument("--query", default="")
    p.add_argument("--mode", default="plain", choices=("plain", "regex", "morph"))
    p.add_argument("--limit", type=int, default=100)
    p.add_argument("--case-sensitive", action="store_true")
    p.add_argument("--whole-word", action="store_true")
    a = p.parse_args(argv)
    return JOBS[a.job](SparkSession.builder.appName("lexiloom").getOrCreate(), a) or 0


if __name__ == "__main__":
    sys.exit(main())
