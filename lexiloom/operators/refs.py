"""Durable references, rebuild verdicts and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(refs: DataFrame, corpus: DataFrame, pinned: DataFrame, version: str) -> DataFrame:
    """refs: (ref_id, slug, canonical_id, source_slug, line_num, corpus_version). Canonical hit, else the pinned map, else
    the same version's ordinal; never a nearest match; more than one hit is ambiguous."""
    hits = corpus.groupBy("source_slug", "canonical_id").agg(F.count("*").alias("n_hits"))
    by_id = refs.join(hits.select(F.col("source_slug").alias("slug"), "canonical_id", F.col("n_hits").alias("canonical_hits")), ["slug", "canonical_id"], "left")
    target = pinned.join(hits.select("source_slug", F.col("canonical_id").alias("pinned_id"), F.col("n_hits").alias("pinned_hits")), ["source_slug", "pinned_id"], "left")
    by_pin = by_id.join(target.select("source_slug", "line_num", "corpus_version", "pinned_id", F.coalesce("pinned_hits", F.lit(0)).alias("pinned_hits")), ["source_slug", "line_num", "corpus_version"], "left")
    ordinal = corpus.select("source_slug", "line_num", F.col("canonical_id").alias("ordinal_id")).distinct()
    every = by_pin.join(ordinal, ["source_slug", "line_num"], "left")
    hits_, pin = F.col("canonical_hits"), F.col("pinned_hits")
    status = (
        F.when(hits_ == 1, "canonical").when(hits_ > 1, "ambiguous").when(F.col("line_num").isNull(), "orphan")
        .when(pin == 1, "legacy_mapped").when(pin > 1, "ambiguous").when(pin == 0, "orphan")
        .when(F.coalesce(F.col("corpus_version"), F.lit(version)) == version, F.when(F.col("ordinal_id").isNotNull(), "legacy_direct").otherwise("orphan"))
        .otherwise("orphan")
    )
    found = F.when(F.col("status") == "canonical", F.col("canonical_id")).when(F.col("status") == "legacy_mapped", F.col("pinned_id")).when(F.col("status") == "legacy_direct", F.col("ordinal_id"))
    return every.withColumn("status", status).select("ref_id", "status", found.alias("resolved_id"))


def verdicts(refs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Of each ref (source_slug, line_num): stable, content_changed, identity_changed, orphaned, ambiguous or unresolved_before."""

    def side(c: DataFrame, name: str) -> DataFrame:
        return c.groupBy("source_slug", "line_num").agg(F.count("*").alias(f"{name}_n"), F.min("canonical_id").alias(f"{name}_id"), F.min("fingerprint").alias(f"{name}_print"))

    by_id = after.groupBy(F.col("canonical_id").alias("before_id")).agg(F.count("*").alias("id_n"), F.min("fingerprint").alias("id_print"))
    both = refs.join(side(before, "before"), ["source_slug", "line_num"], "left").join(side(after, "after"), ["source_slug", "line_num"], "left").join(by_id, "before_id", "left")
    verdict = (
        F.when(F.col("before_n").isNull(), "unresolved_before").when((F.col("before_n") > 1) | (F.col("id_n") > 1), "ambiguous")
        .when(F.col("id_n").isNull() & F.col("after_n").isNull(), "orphaned").when(F.col("id_n").isNull(), "identity_changed")
        .when(F.col("id_print") != F.col("before_print"), "content_changed").otherwise("stable")
    )
    return both.select("ref_id", verdict.alias("verdict"))


def manifest(lines: DataFrame) -> DataFrame:
    """Per source: records, first and last id in order, characters, and an order-independent content mark."""
    return lines.groupBy("source_slug").agg(
        F.count("*").alias("record_count"), F.min_by("canonical_id", "line_num").alias("first_id"), F.max_by("canonical_id", "line_num").alias("last_id"), F.sum(F.length("line_text")).alias("chars")
    )


def diff(old: DataFrame, new: DataFrame, key: str = "source_slug") -> DataFrame:
    """Full outer by key: added, removed, changed with the fields that differ, or same."""
    fields = [c for c in old.columns if c != key]
    a, b = old.select(key, F.struct(*fields).alias("a")), new.select(key, F.struct(*fields).alias("b"))
    differ = F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields)))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(differ) > 0, "changed").otherwise("same")
    return a.join(b, key, "full").select(key, status.alias("status"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.array_join(differ, ",")).otherwise("").alias("changed_fields"))


def validate_ingest(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: missing ids, duplicate (source, id), sources without lines."""
    missing = lines.agg(F.count_if(F.col("canonical_id").isNull() | (F.col("canonical_id") == "")).alias("missing_ids"))
    dup = lines.groupBy("source_slug", "canonical_id").count().where("count > 1").agg(F.count("*").alias("duplicate_ids"))
    empty = sources.join(lines.select(F.col("source_slug").alias("slug")).distinct(), "slug", "left_anti").agg(F.count("*").alias("empty_sources"))
    return missing.crossJoin(dup).crossJoin(empty)  # three single rows


def manifest_faults(sources: DataFrame, totals: dict[str, int]) -> DataFrame:
    """(fault, slug): what is wrong with a bundle's list of sources (pos, slug, path, sort_order, record_count, bytes) and its totals
    (source_count, record_count, canonical_bytes): duplicate slugs and paths, an order that is not by sort_order and slug, sums."""
    from pyspark.sql import Window

    def repeated(name: str) -> DataFrame:
        return sources.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(f"duplicate_{name}").alias("fault"), F.col(name).cast("string").alias("slug"))

    before = F.lag(F.struct("sort_order", "slug")).over(Window.orderBy("pos"))  # a dimension: one row a source
    order = sources.withColumn("before", before).where(F.col("before") > F.struct("sort_order", "slug")).select(F.lit("order").alias("fault"), "slug")
    sums = sources.agg(F.count("*").alias("source_count"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("canonical_bytes"))
    wrong = sums.select(F.explode(F.array_compact(F.array(*(F.when(F.col(k) != v, F.lit(f"total_{k}")) for k, v in totals.items())))).alias("fault"), F.lit(None).cast("string").alias("slug"))
    return repeated("slug").unionByName(repeated("path")).unionByName(order).unionByName(wrong)


def file_faults(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(fault, slug): sources (slug, path, bytes, sha256) whose file among `files` (path, length, content; as binaryFile reads them) is
    missing, has another size or another content."""
    held = files.select("path", "length", F.sha2("content", 256).alias("found"))
    met = sources.join(held, "path", "left")
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("length") != F.col("bytes"), "size").when(F.col("found") != F.col("sha256"), "sha256")
    return met.select(fault.alias("fault"), "slug").where("fault is not null")


def legacy_map(lines: DataFrame, version: str) -> DataFrame:
    """Ordinal places of a corpus with their canonical ids, pinned to the version they hold for; a place with several lines is left out."""
    by = lines.where(F.coalesce("canonical_id", F.lit("")) != "").groupBy("source_slug", "line_num").agg(F.count("*").alias("n"), F.min("canonical_id").alias("pinned_id"))
    return by.where("n = 1").select("source_slug", "line_num", F.lit(version).alias("corpus_version"), "pinned_id")


def backfill(refs: DataFrame, lines: DataFrame) -> DataFrame:
    """Stored references (ref_id, source_slug, line_num, remembered) with the canonical id of their line, bound only if the line still
    holds the remembered text: status bound, text_differs, ambiguous or missing."""
    at = lines.groupBy("source_slug", "line_num").agg(F.count("*").alias("n"), F.min(F.struct("canonical_id", "line_text")).alias("l"))
    met = refs.join(at, ["source_slug", "line_num"], "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(F.contains("l.line_text", "remembered"), "bound").otherwise("text_differs")
    return met.withColumn("status", status).select("ref_id", "status", F.when(F.col("status") == "bound", F.col("l.canonical_id")).alias("canonical_id"))


def by_status(resolved: DataFrame, every: tuple[str, ...] = ("canonical", "legacy_mapped", "legacy_direct", "ambiguous", "orphan")) -> DataFrame:
    """(status, n) of resolutions, 0 for a status that none has."""
    names = resolved.sparkSession.createDataFrame([(k,) for k in every], "status string")
    return names.join(resolved.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def run_groups(ids: DataFrame, least: int = 3) -> DataFrame:
    """(work, bare, members): passages of which `least` or more stand under letters, as (work, passage, annotated); none of which is annotated."""
    s = ids.withColumn("bare", F.regexp_replace("passage", "([0-9])[a-z]$", "$1")).where(F.col("passage") != F.col("bare"))
    by = s.groupBy("work", "bare").agg(F.count("*").alias("members"), F.bool_or("annotated").alias("a"))
    return by.where((F.col("members") >= least) & ~F.col("a")).select("work", "bare", "members")
