"""Joins between versions of a text: by key, by range, by tiers of likeness, by occurrence and as of a position."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sanskrit as K


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def align_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every left row with the first right row of its key, and orphans of the right: status matched, left_only or orphan."""
    matched = left.join(right, key, "left").withColumn("status", F.when(F.col("right_id").isNotNull(), "matched").otherwise("left_only"))
    orphans = right.join(left.select(key).distinct(), key, "left_anti").select(F.lit(None).cast(left.schema["left_id"].dataType).alias("left_id"), key, "right_id", F.lit("orphan").alias("status"))
    return matched.select("left_id", key, "right_id", "status").unionByName(orphans)


def expand_ranges(df: DataFrame, lo: str = "lo", hi: str = "hi", out: str = "verse") -> DataFrame:
    return df.withColumn(out, F.explode(F.sequence(lo, hi)))


def compare_range(wanted: DataFrame, versions: DataFrame) -> DataFrame:
    """For each wanted (chapter, verse), each work's best version: exact before range, then the narrower, then the earlier row.

    Ranges are short, so they are expanded to their verses and met by an equi-join."""
    spread = expand_ranges(versions)
    found = wanted.join(spread, ["chapter", "verse"])
    is_range = (F.col("lo") != F.col("hi")).cast("int")
    return first_per_key(found.withColumn("is_range", is_range), ["work", "chapter", "verse"], ["is_range", "lo", "hi", "row_id"])


def multiset_join(left: DataFrame, right: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """The n-th occurrence of a key on one side meets the n-th on the other; the rest is left_only or right_only."""

    def nth(df: DataFrame) -> DataFrame:
        return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(group, key).orderBy(order)))

    a, b = nth(left).withColumnRenamed(order, "left_at"), nth(right).withColumnRenamed(order, "right_at")
    both = a.join(b, [group, key, "occurrence"], "full")
    return both.withColumn("status", F.when(F.col("left_at").isNull(), "right_only").when(F.col("right_at").isNull(), "left_only").otherwise("matched"))


def ratio_of(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with score: the matching-block ratio of two texts, which has no built-in."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    return pairs.withColumn("score", ratio(left, right))


def reachable(left: Column, right: Column, least: float) -> Column:
    """Whether texts of these lengths can have a ratio of `least`: no more characters match than the shorter one has."""
    a, b = F.length(left), F.length(right)
    return 2 * F.least(a, b) >= least * (a + b)


def tiers(left: DataFrame, right: DataFrame, guard: float = 0.70, prefix: int = 10, cutoff: float = 0.90) -> DataFrame:
    """The best partner of each left line by its key: (left_id, right_id, tier, score, n_right).

    Tier exact: equal keys. Else sandhi: equal skeletons, the key with the highest matching-block ratio, if that reaches the
    guard. Else fuzzy: a common prefix, the key with the highest ratio from the cutoff on. Empty keys have no partner.
    n_right counts the right lines of the key that was found (more than one: ambiguous), right_id is the smallest.

    left: (left_id, left_key), right: (right_id, right_key). Keys are compared once each, however many lines have them, and
    only lines that a tier leaves over go to the next, so a common line costs no more than a rare one."""
    keys = right.where("right_key <> ''").groupBy("right_key").agg(F.min("right_id").alias("right_id"), F.count("*").alias("n_right"))
    asked = left.where("left_key <> ''").select("left_key").distinct()
    exact = asked.join(keys.withColumn("left_key", F.col("right_key")), "left_key").select("left_key", "right_key", "right_id", "n_right", F.lit("exact").alias("tier"), F.lit(1.0).alias("score"))
    open_ = asked.join(exact.select("left_key"), "left_key", "left_anti")

    def best(pairs: DataFrame, least: float, tier: str, tie: str) -> DataFrame:
        scored = ratio_of(pairs.where(reachable(F.col("left_key"), F.col("right_key"), least)), "left_key", "right_key").where(F.col("score") >= least)
        top = F.max_by(F.struct("right_key", "right_id", "n_right", "score"), F.struct("score", tie))
        return scored.groupBy("left_key").agg(top.alias("b")).select("left_key", "b.right_key", "b.right_id", "b.n_right", F.lit(tier).alias("tier"), "b.score")

    bones = keys.withColumn("bones", K.skeleton(F.col("right_key")))
    met = open_.withColumn("bones", K.skeleton(F.col("left_key"))).join(bones, "bones").drop("bones").withColumn("first", -F.col("right_id"))
    sandhi = best(met, guard, "sandhi", "first")
    still = open_.join(sandhi.select("left_key"), "left_key", "left_anti")
    heads = still.withColumn("p", F.substring("left_key", 1, prefix)).join(keys.withColumn("p", F.substring("right_key", 1, prefix)), "p").drop("p")
    fuzzy = best(heads, cutoff, "fuzzy", "right_key")
    every = exact.unionByName(sandhi).unionByName(fuzzy)
    return left.join(every, "left_key").select("left_id", "right_id", "tier", "score", "n_right")


def as_of(rows: DataFrame, boundaries: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """The last boundary at or before each row, by one sort of both sides together."""
    own = rows.withColumn(value, F.lit(None).cast(boundaries.schema[value].dataType)).withColumn("__row", F.lit(1))
    marks = boundaries.select(group, at, value)
    for c in own.columns:
        if c not in marks.columns:
            marks = marks.withColumn(c, F.lit(0) if c == "__row" else F.lit(None).cast(own.schema[c].dataType))
    order = Window.partitionBy(group).orderBy(at, "__row").rowsBetween(Window.unboundedPreceding, 0)
    filled = own.unionByName(marks.select(own.columns)).withColumn(value, F.last(value, ignorenulls=True).over(order))
    return filled.where("__row = 1").drop("__row")


def phrase_matches(docs: DataFrame, phrases: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Leftmost-longest, non-overlapping occurrences of many phrases by an automaton built once per task; none of no phrases."""
    import pyarrow as pa

    phrases = sorted({p for p in phrases if p})
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, phrase string, place long"
    if not phrases:
        return docs.sparkSession.createDataFrame([], schema)

    def kernel(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in phrases:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for b in batches:
            rows, found, places = [], [], []
            for k, t in enumerate(b.column(1)):
                for end, p in automaton.iter_long(t.as_py() or ""):
                    rows.append(k)
                    found.append(p)
                    places.append(end - len(p) + 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(places, pa.int64())], names=[id_col, "phrase", "place"])

    return docs.select(id_col, text_col).mapInArrow(kernel, schema)
