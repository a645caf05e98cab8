"""Structured Streaming form of the fixed-window counter; the batch form gives the same rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, key: str, window: str = "1 hour", late: str | None = None) -> DataFrame:
    """(window_start, key, n); with a watermark, windows older than it are purged."""
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    if late:
        at = at.withWatermark("at", late)
    return at.groupBy(F.window("at", window).alias("w"), key).agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("window_start"), key, "n")


def run_available(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a streaming frame over what is there now and return its result as a table; the result is kept on the driver, so it is for small ones."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in spark.checkpoint.dir, which driver and executors share; only a local session may have none, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='lexiloom-')}"
    return f"{shared.rstrip('/')}/lexiloom-{name}-{uuid.uuid4().hex}"


def run_to_files(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Run a streaming aggregate over what is there now and return its result, which executors write as Parquet under `folder`.

    Each batch writes the rows it has updated under its own number, so that a batch that is run again replaces its own files;
    of each key the row of the last batch holds."""

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/rows/n={n}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    others = [c for c in stream.columns if c not in keys]
    rows = stream.sparkSession.read.option("recursiveFileLookup", "true").parquet(f"{folder}/rows")  # the folders' numbers are no column
    return rows.groupBy(*keys).agg(F.max(F.struct("batch", *others)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in others))
