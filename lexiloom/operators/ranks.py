"""Values at ranks of a group, without gathering or sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def values_at(rows: DataFrame, group: list[str], value: str, places: dict[str, Column], buckets: int = 4096) -> DataFrame:
    """(group, n, one column for each place): the values at places from 0 in the order of a numeric column; a place is an expression of n.

    Equal values are folded first. Counts in `buckets` stretches of equal width between a group's ends tell in which stretch a
    place lies, and only the distinct values of that stretch are ordered. Groups may be of any size; a task holds the values of
    one stretch, which is much only where nearly all values lie within a 4096th of their range. Nulls are left out."""
    one = [*group] or ["__all"]
    rows = rows if group else rows.withColumn("__all", F.lit(1))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*one, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    ends = counts.groupBy(*one).agg(F.min(F.col("v").cast("double")).alias("lo"), F.max(F.col("v").cast("double")).alias("hi"), F.sum("c").alias("n"))
    stretch = F.coalesce(F.floor(F.try_divide((F.col("v").cast("double") - F.col("lo")) * (buckets - 1), F.col("hi") - F.col("lo"))), F.lit(0))
    placed = counts.join(ends, one).withColumn("b", stretch)
    held = placed.groupBy(*one, "b").agg(F.sum("c").alias("m"), F.first("n").alias("n"))
    upto = held.withColumn("before", F.sum("m").over(Window.partitionBy(*one).orderBy("b")) - F.col("m"))  # at most `buckets` rows a group
    asked = upto.withColumn("p", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), x.cast("long").alias("k")) for k, x in places.items()))))
    asked = asked.where((F.col("p.k") >= F.col("before")) & (F.col("p.k") < F.col("before") + F.col("m"))).select(*one, "b", "before", F.col("p.name").alias("name"), F.col("p.k").alias("k"))
    within = placed.select(*one, "b", "v", "c").join(asked, [*one, "b"])
    run = within.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(*one, "name").orderBy("v")))
    found = run.where("upto > k").groupBy(*one).agg(*(F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places))
    return ends.select(*one, "n").join(found, one, "left").drop("__all")
