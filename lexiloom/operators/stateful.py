"""Fixed-window quotas, caches with a lifetime, first touch, deterministic picks and the spending ladder, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epoch(c: Column) -> Column:
    return F.unix_seconds(c.cast("timestamp"))


def rate_limit(events: DataFrame, key: str, window_s: int, limit: int) -> DataFrame:
    """Per event: its window, its count in it (denied requests count too), allowed, what remains, and seconds to wait."""
    now = epoch(F.col("ts"))
    start = now - now % window_s
    w = events.withColumn("window_start", start).withColumn("now", now)
    n = F.row_number().over(Window.partitionBy(key, "window_start").orderBy("ts", "event_id"))
    out = w.withColumn("n", n)
    return out.select("event_id", key, "window_start", F.col("n").cast("long").alias("n"), (F.col("n") <= limit).alias("allowed"), F.greatest(F.lit(0), limit - F.col("n")).cast("long").alias("remaining"), F.greatest(F.lit(1), F.col("window_start") + window_s - F.col("now")).cast("long").alias("retry_after"))


def ttl_hits(events: DataFrame, key: list[str], ttl_s: int) -> DataFrame:
    """Per event: whether the event before it with the same key is within the lifetime."""
    before = F.lag(epoch(F.col("ts"))).over(Window.partitionBy(*key).orderBy("ts", "event_id"))
    return events.withColumn("hit", F.coalesce(epoch(F.col("ts")) - before <= ttl_s, F.lit(False)))


def first_touch(events: DataFrame, key: str, first: str, latest: str) -> DataFrame:
    """Insert-once `first` by earliest row, latest non-null `latest`."""
    order = F.struct("ts", "event_id")
    return events.groupBy(key).agg(F.min_by(first, order).alias("first_value"), F.max_by(F.when(F.col(latest).isNotNull(), F.col(latest)), F.when(F.col(latest).isNotNull(), order)).alias("latest_value"))


def pick_unseen(pool: DataFrame, seen: DataFrame, key: str, day: str) -> DataFrame:
    """One unseen row, by md5 of day and key."""
    order = F.md5(F.concat(F.lit(day + ":"), F.col(key).cast("string")))
    return pool.join(seen.select(key).distinct(), key, "left_anti").withColumn("order", order).orderBy("order", key).limit(1)


def spend_ladder(calls: DataFrame, prices: dict[str, float], ceiling: float, chars_per_token: int = 4, enabled: bool = True) -> DataFrame:
    """calls: (doc_id, model, chars, max_output). The first rung that applies decides; cost is the worst case."""
    table = F.create_map(*(F.lit(v) for kv in prices.items() for v in kv))
    price = F.try_element_at(table, F.col("model"))
    tokens = F.ceil(F.col("chars") / chars_per_token)
    cost = (tokens + F.col("max_output")) * price / 1000.0
    verdict = F.when(F.lit(not enabled), "ai_disabled").when(F.col("max_output") <= 0, "invalid_output_bound").when(F.lit(ceiling <= 0), "invalid_cost_ceiling").when(price.isNull(), "unknown_model").when(cost > ceiling, "cost_ceiling_exceeded").otherwise("allowed")
    return calls.select("doc_id", tokens.cast("long").alias("tokens"), cost.alias("cost"), verdict.alias("verdict"))
