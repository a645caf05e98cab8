"""Audits and measures: tag and script censuses, suffix audit, errata, agreement, overlap, intervals, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import values_at

TAGS = ("p", "a", "li", "h1", "h2", "div", "script", "style", "nav")


def tag_census(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.select("page_id", *(F.regexp_count(html, F.lit(rf"<{t}[ >]")).cast("long").alias(f"n_{t}") for t in TAGS))


def script_flags(c: Column) -> list[Column]:
    return [c.rlike(rf"\p{{Is{s}}}").alias(f"has_{s.lower()}") for s in ("Latin", "Cyrillic", "Devanagari")]


def mixed_tokens(docs: DataFrame) -> DataFrame:
    """Letter runs that mix Latin with Cyrillic, per document."""
    runs = F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0)
    mixed = F.filter(runs, lambda x: x.rlike(r"\p{IsLatin}") & x.rlike(r"\p{IsCyrillic}"))
    return docs.select("doc_id", F.size(runs).cast("long").alias("n_runs"), F.size(mixed).cast("long").alias("n_mixed"))


def suffix_audit(ids: DataFrame) -> DataFrame:
    """Per work: ids that end in a letter behind a digit, those whose bare id is missing, deeper suffixes than b, and whether one work holds over 60 % of 30 or more."""
    s = ids.withColumn("suffix", F.regexp_extract("passage", "[0-9]([a-z])$", 1)).withColumn("bare", F.regexp_replace("passage", "([0-9])[a-z]$", "$1"))
    with_suffix = s.where("suffix <> ''")
    bare = ids.select("work", F.col("passage").alias("bare"), F.lit(True).alias("there")).distinct()
    by = with_suffix.join(bare, ["work", "bare"], "left").groupBy("work").agg(F.count("*").alias("n_suffixed"), F.count_if(F.col("there").isNull()).alias("no_base"), F.count_if(F.col("suffix") > "b").alias("deep"))
    total = F.sum("n_suffixed").over(Window.partitionBy(F.lit(1)))
    return by.withColumn("concentrated", (total >= 30) & (F.col("n_suffixed") > 0.6 * total))


def apply_errata(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """patches: (doc_id, read, instead). `read` must occur exactly once; where it does not but `instead` is there, it was applied before."""
    at = docs.join(patches, "doc_id")
    count = ((F.length("text") - F.length(F.replace("text", F.col("read"), F.lit("")))) / F.length("read")).cast("long")
    status = F.when(count == 1, "applied").when((count == 0) & F.contains("text", "instead"), "already").when(count == 0, "missing").otherwise("ambiguous")
    fixed = F.when(F.col("status") == "applied", F.replace("text", F.col("read"), F.col("instead"))).otherwise(F.col("text"))
    return at.withColumn("status", status).withColumn("fixed", fixed)


def agreement(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """(left_f, right_f) columns: rate of equal values among rows where both are there, null without any."""
    aggs = []
    for f in fields:
        same = F.col(f"left_{f}") == F.col(f"right_{f}")
        aggs += [F.count(same).alias(f"{f}_n"), F.try_divide(F.sum(same.cast("long")), F.count(same)).alias(f"{f}_rate")]
    return pairs.agg(*aggs)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, zz = k / n, z * z
    centre, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return (centre - half) / (1 + zz / n), (centre + half) / (1 + zz / n)


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def index_percentiles(df: DataFrame, value: str, parts: dict[str, tuple[int, int]]) -> DataFrame:
    """Values at index n * a div b of the sorted values, not interpolated."""
    return values_at(df, [], value, {name: F.floor(F.col("n") * a / b) for name, (a, b) in parts.items()}).select(*parts, "n")


def quota_sample(docs: DataFrame, stratum: str, quota: int, seed: str = "759") -> DataFrame:
    """The `quota` rows of each stratum that come first by md5 of seed and id; both engines agree on it."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col("doc_id").cast("string"))), "doc_id")
    return docs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= quota)


def symbols(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(symbol, n): the characters of all texts with their number."""
    return rows.select(F.explode(F.split(text_col, "")).alias("symbol")).where("symbol <> ''").groupBy("symbol").agg(F.count("*").alias("n"))


def tagger_scores(rows: DataFrame, stratum: str) -> DataFrame:
    """(stratum, n, lenient, strict, ambiguous, low, high): of rows (stratum, lemma, gold array in order), how many lemmas are among the gold
    ones, how many are the first, how many have several, and the interval of the lenient rate; by stratum and, with a null, over all."""
    lenient = F.array_contains("gold", F.lower("lemma"))
    strict = F.get(F.col("gold"), 0) == F.lower("lemma")
    found = rows.where(F.size("gold") > 0).groupingSets([[F.col(stratum)], []], F.col(stratum)).agg(F.count("*").alias("n"), F.count_if(lenient).alias("lenient"), F.count_if(strict).alias("strict"), F.count_if(F.size("gold") > 1).alias("ambiguous"))
    low, high = wilson(F.col("lenient").cast("double"), F.col("n").cast("double"))
    return found.select(F.col(stratum).alias("stratum"), "n", "lenient", "strict", "ambiguous", low.alias("low"), high.alias("high"))
