"""What the training-data operators share: shipping code, cutting lineage, ids of rows and hashing.

Nothing here collects rows to the driver. Intermediate tables go to the folder in
``spark.checkpoint.dir``, which driver and executors share on a cluster.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context, so that they need no PYTHONPATH."""
    sc = spark.sparkContext
    if getattr(sc, "_lexiloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / "lexiloom_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(archive))
    sc._lexiloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only in a local session that has none, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lexiloom-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexiloom-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(df: DataFrame, name: str, rename: str | None = None) -> T.StructField:
    return T.StructField(rename or name, df.schema[name].dataType, True)


def bounded_broadcast(df: DataFrame, rows: int, most_rows: int) -> DataFrame:
    """Broadcast only if the counted rows are within the stated bound; beyond it the plan joins by shuffle."""
    return F.broadcast(df) if rows <= most_rows else df


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join where a key may hold a third of big's rows and small has one row a key: big's rows of a key are spread over salts tasks."""
    left = big.withColumn("__salt", (F.monotonically_increasing_id() % salts).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def tokenizer_path(name: str) -> str:
    """Default place of the vocabulary files; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters, marks and signs whose classes no Unicode version since 6.0 has changed; texts with any other character take
#: the tokenizer library's own splitting, whose Unicode tables may be older or newer than Python's.
STABLE = re.compile(r"[^\x00-\u036f\u0386-\u03ce\u0400-\u0481\u048a-\u0523\u1e00-\u1eff\u2010-\u2027\u2030-\u205e\u20a0-\u20b8\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")


class Memo(dict):
    """A dict that computes missing values and is emptied when its keys and values take about `most` bytes; results do not depend on what it holds.

    Workers are used again by later stages, so an operator's kernel calls alone() first, which empties the memos of the others."""

    every: weakref.WeakSet = weakref.WeakSet()
    __hash__ = object.__hash__  # for the set above

    def __init__(self, compute, most: int = 48 << 20, longest: int = 64):
        super().__init__()
        self.compute, self.most, self.longest, self.held = compute, most, longest, 0
        Memo.every.add(self)

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            size = sys.getsizeof(key) + sum(map(sys.getsizeof, value) if isinstance(value, tuple) else [sys.getsizeof(value)]) + 104  # of the dict itself
            if self.held + size > self.most:
                self.clear()
                self.held = 0
            self.held += size
            self[key] = value
        return value

    def alone(self) -> None:
        for other in list(Memo.every):
            if other is not self and other:
                other.clear()
                other.held = 0
