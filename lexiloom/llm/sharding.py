"""Sharding by a Feistel permutation over global row numbers.

Rows get gapless global row numbers in a total order that depends on their contents alone; the
permutation of [0, n) by a four-round Feistel network with cycle walking then deals them out, so that
shard = image mod shards and slot = image div shards are computable from the row number, and back.
Shard sizes differ by one at most (the law ``rows``).

Numbering never sorts the whole table in one task: rows are counted per hash bucket (equal rows first
fold into one counted row, so copies cannot make a bucket hot), bucket offsets are running sums over
the fixed number of buckets, and a window numbers the rows within a bucket.

Defined cases: null text has size 0 + 1 and the CRC of the empty string; null ids are numbered as any
other; fully equal rows take consecutive numbers; an empty table gives an empty result; further input
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, materialize, ship

BUCKETS = 4096


class Feistel:
    """A keyed permutation of [0, n): a balanced Feistel network over the least even number of bits, walked until the image falls below n."""

    def __init__(self, n: int, seed: int = 0, rounds: int = 4):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [self.mix(np.uint64((seed * 0x9E3779B97F4A7C15 + r + 1) % 2**64)) for r in range(rounds)]

    @staticmethod
    def mix(x):
        """Fixed constants: the 64-bit finalizer of splitmix64."""
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

    def step(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in self.keys:
            left, right = right, left ^ (self.mix(right ^ k) & self.mask)
        return (left << np.uint64(self.half)) | right

    def back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in reversed(self.keys):
            left, right = right ^ (self.mix(left ^ k) & self.mask), left
        return (left << np.uint64(self.half)) | right

    def walk(self, x, one) -> np.ndarray:
        y = one(np.asarray(x, dtype=np.uint64))
        while (out := y >= np.uint64(self.n)).any():  # a cycle through a start below n returns below n
            y[out] = one(y[out])
        return y.astype(np.int64)

    def forward(self, rows) -> np.ndarray:
        return self.walk(rows, self.step)

    def inverse(self, images) -> np.ndarray:
        return self.walk(images, self.back)


def number_rows(df: DataFrame, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """df's rows with row_number from 0, gapless, ordered by hash bucket and then by the columns of order, which must be all of df's."""
    counted = materialize(df.groupBy(*order).agg(F.count("*").alias("__n")).withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")), "numbering")
    running = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    starts = counted.groupBy("__b").agg(F.sum("__n").alias("__in")).withColumn("__start", F.coalesce(F.sum("__in").over(running), F.lit(0))).drop("__in")
    within = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = counted.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(F.broadcast(starts), "__b").withColumn("__first", F.col("__start") + F.col("__before"))
    return first.select(*order, F.explode(F.sequence("__first", F.col("__first") + F.col("__n") - 1)).alias("row_number"))


def assign_shards(docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard (null: the law is `rows`) and the row_number that both derive from."""
    spark = docs.sparkSession
    ship(spark)
    raw = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    base = docs.select(F.col(id_col), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    numbered = number_rows(base, [id_col, "size", "text_crc32"])
    n = docs.count()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutation = Feistel(n, seed)
        for b in batches:
            image = permutation.forward(b.column(3).to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros(0, np.int64)
            cols = [b.column(0), b.column(1), b.column(2), pa.array(["rows"] * b.num_rows, pa.string()), pa.array((image % shards).astype(np.int32)), pa.array(image // shards), pa.nulls(b.num_rows, pa.int32()), b.column(3)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    long, number = T.LongType(), T.IntegerType()
    schema = T.StructType([field(docs, id_col), *(T.StructField(k, t) for k, t in (("size", long), ("text_crc32", long), ("law", T.StringType()), ("shard", number), ("slot", long), ("grown_shard", number), ("row_number", long)))])
    return numbered.mapInArrow(kernel, schema)


def row_of(shard: int, slot: int, n: int, shards: int = 8, seed: int = 42) -> int:
    """The global row number at a place: the way back that a loader needs to seek."""
    return int(Feistel(n, seed).inverse([slot * shards + shard])[0])
