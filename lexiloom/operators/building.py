"""Corpus building: entries from lines, mappings, offsets, fallbacks, round trips, samples by budget, tokens of trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sanskrit as K
from .ranks import values_at


def entries(lines: DataFrame, group: str, start: Column) -> DataFrame:
    """Continuation lines go to the entry whose first line satisfies `start`; lines before any entry are entry 0."""
    n = F.sum(start.cast("int")).over(Window.partitionBy(group).orderBy("line_no"))
    parts = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return lines.withColumn("entry", n).groupBy(group, "entry").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("body"))


def mapping_faults(ranges: DataFrame, group: str) -> DataFrame:
    """Gaps and overlaps between ranges (lo, hi) in order of lo."""
    order = Window.partitionBy(group).orderBy("lo", "hi", "row_id")
    upto = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fault = F.when(F.col("lo") > F.col("upto") + 1, "gap").when(F.col("lo") <= F.col("upto"), "overlap")
    return ranges.withColumn("upto", upto).withColumn("fault", fault).where("fault is not null")


def offsets(sizes: DataFrame, group: str, order: str) -> DataFrame:
    """Local numbers to global ones: rows before each part in its group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))


def annotated(comments: DataFrame, passages: DataFrame) -> DataFrame:
    """The passage that a comment annotates: its own, else without a trailing letter, else its host."""
    p = passages.select("work", F.col("passage").alias("hit")).distinct()
    bare = F.regexp_replace("passage", "[a-z]$", "")
    c = comments.withColumn("bare", bare)
    one = c.join(p.withColumnRenamed("hit", "exact"), (c["work"] == p["work"]) & (c["passage"] == F.col("exact")), "left").drop(p["work"])
    two = one.join(p.select(F.col("work").alias("w2"), F.col("hit").alias("stripped")), (F.col("work") == F.col("w2")) & (F.col("bare") == F.col("stripped")), "left")
    return two.select("comment_id", F.coalesce("exact", "stripped", "host").alias("annotates"))


def roundtrip(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Match rate of two tables of texts by key; one row."""
    both = before.select(*key, F.col(value).alias("x")).join(after.select(*key, F.col(value).alias("y")), key, "full")
    same = F.col("x").eqNullSafe(F.col("y"))
    return both.agg(F.count("*").alias("n"), F.count_if(same).alias("same"), F.count_if(F.col("x").isNull()).alias("added"), F.count_if(F.col("y").isNull()).alias("lost"))


def budget_sample(rows: DataFrame, stratum: str, size: str, budget: int, seed: str = "20261029") -> DataFrame:
    """Rows of each stratum, by md5 of seed and id, while their sizes fit the budget.

    Sums by the first three digits of the md5 tell which rows can be within the budget; only these are put in order."""
    mark = F.md5(F.concat(F.lit(seed + ":"), F.col("doc_id").cast("string")))
    marked = rows.withColumn("__m", mark).withColumn("__b", F.substring("__m", 1, 3))
    sums = marked.groupBy(stratum, "__b").agg(F.sum(size).alias("__s"))  # at most 4096 rows a stratum
    before = F.sum("__s").over(Window.partitionBy(stratum).orderBy("__b")) - F.col("__s")
    near = sums.withColumn("__before", before).where(F.col("__before") <= budget).select(stratum, "__b", "__before")
    w = Window.partitionBy(stratum, "__b").orderBy("__m", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    run = marked.join(near, [stratum, "__b"]).withColumn("used", F.col("__before") + F.sum(size).over(w))
    return run.where(F.col("used") <= budget).drop("__m", "__b", "__before")


def landmarks(rows: DataFrame, group: str, order: str) -> DataFrame:
    """First, middle (n div 2, from 0) and last row of each group by a numeric column without equal values: (group, order, k, n)."""
    n = F.col("n")
    at = values_at(rows, [group], order, {"first": F.lit(0), "middle": F.floor(n / 2), "last": n - 1})
    every = F.array(*(F.struct(F.col(name).alias("v"), k.cast("long").alias("k")) for name, k in (("first", F.lit(0)), ("middle", F.floor(n / 2)), ("last", n - 1))))
    return at.select(group, "n", F.explode(F.array_distinct(every)).alias("p")).select(group, F.col("p.v").alias(order), F.col("p.k").alias("k"), "n")


def nearest_rank(df: DataFrame, value: str, group: str, share: float) -> DataFrame:
    """Nearest-rank percentile per group."""
    return values_at(df, [group], value, {"value": F.ceil(F.col("n") * share) - 1}).select(group, "value", "n")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key as columns of a struct; a combining aggregate, no window."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct("ts", "event_id", *(c for c in others if c not in ("ts", "event_id")))).alias("r")).select(key, "r.*")


def blocks(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """Coverage of a's tokens by matching blocks with b's tokens of the same group, and whether it reaches one half."""

    def kernel(key, left, right):
        import difflib

        import pyarrow as pa

        x = [t for _, t in sorted(zip(left["pos"].to_pylist(), left["token"].to_pylist(), strict=True))]
        y = [t for _, t in sorted(zip(right["pos"].to_pylist(), right["token"].to_pylist(), strict=True))]
        n = sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        share = n / len(x) if x else 0.0
        return pa.table({group: [key[0].as_py()], "tokens": [len(x)], "matched": [n], "confirmed": [share >= 0.5]})

    kind = a.schema[group].dataType.simpleString()
    return a.groupBy(group).cogroup(b.groupBy(group)).applyInArrow(kernel, f"{group} {kind}, tokens long, matched long, confirmed boolean")


def gold_to_words(rows: DataFrame) -> DataFrame:
    """rows: (id, gold array of forms, words array); adds pieces, the number of gold forms that make up each word, null unless all fit.

    Forms are compared folded, so that what changes where words meet does not count, and like vowels that meet are one. A fold
    over the gold forms: each goes to the first word that is not whole yet; a word is whole when the forms given to it spell it,
    and a form that takes it past its length fails the row. Words without a letter take no form."""
    targets = F.transform("words", lambda w: K.seam(K.fold_sandhi(w)))
    lettered = F.filter("targets", lambda t: t != "")
    start = F.struct(F.lit("").alias("made"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"), F.lit(True).alias("ok"))

    def step(s, form):
        made, n = F.concat(s["made"], form), s["n"] + 1
        target, spelt = F.get(F.col("lettered"), F.size(s["out"])), K.seam(made)
        whole = F.coalesce(spelt == target, F.lit(False))
        ok = s["ok"] & (whole | F.coalesce(F.length(spelt) < F.length(target), F.lit(False)))
        return F.struct(F.when(whole, "").otherwise(made).alias("made"), F.when(whole, 0).otherwise(n).alias("n"), F.when(whole, F.concat(s["out"], F.array(n))).otherwise(s["out"]).alias("out"), ok.alias("ok"))

    folded = rows.select("id", "words", F.transform("gold", lambda g: K.fold_sandhi(g)).alias("forms"), targets.alias("targets")).withColumn("lettered", lettered)
    done = folded.withColumn("s", F.aggregate("forms", start, step))
    fits = F.col("s.ok") & (F.col("s.n") == 0) & (F.size("s.out") == F.size("lettered")) & (F.size("words") > 0) & (F.size("forms") > 0)
    place = lambda t, k: F.when(t == "", 0).otherwise(F.get(F.col("s.out"), F.size(F.filter(F.slice("targets", 1, k + 1), lambda x: x != "")) - 1))
    return done.select("id", F.when(fits, F.transform("targets", place)).alias("pieces"))


def monotone_notes(rows: DataFrame, group: str, gap: int = 8) -> DataFrame:
    """Note starts are taken while they rise by 1 to `gap`; the others continue the note before. A fold over each group's ordered numbers."""
    ordered = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", "number"))).alias("xs"))
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<long>").alias("taken"))

    def step(acc, x):
        ok = (x["number"] > acc["last"]) & (x["number"] <= acc["last"] + gap)
        return F.struct(F.when(ok, x["number"]).otherwise(acc["last"]).cast("long").alias("last"), F.when(ok, F.concat(acc["taken"], F.array(x["pos"].cast("long")))).otherwise(acc["taken"]).alias("taken"))

    return ordered.select(group, F.aggregate("xs", start, step, lambda acc: acc["taken"]).alias("taken"))


def concatenate_ranges(ranges: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """ranges (range_id, group, lo, hi) with the texts (group, seq, text) between their ends, in order and joined by blanks, and how many.

    Ranges are short and are spread over their numbers, so the join is an equi-join; a range without a row is kept with none.
    Ranges with the same ends share one body, which is made once: texts are shuffled by ends, not by range."""
    ends = [group, "lo", "hi"]
    spread = ranges.select(*ends).distinct().withColumn("seq", F.explode(F.sequence("lo", "hi")))
    met = spread.join(rows.select(group, "seq", "text"), [group, "seq"]).groupBy(*ends).agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("xs"))
    bodies = met.select(*ends, F.array_join(F.transform("xs", lambda x: x["text"]), " ").alias("body"), F.size("xs").alias("n"))
    return ranges.join(bodies, ends, "left").select("range_id", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("n", F.lit(0)).alias("n"))


def prompt(rows: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """(key, prompt): the texts of a key in order, each on a line with its label. One cell of the result holds them all."""
    line = F.concat(F.lit("["), F.col(label), F.lit("] "), F.col("text"))
    by = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, line.alias("line")))).alias("xs"))
    return by.select(key, F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("prompt"))
