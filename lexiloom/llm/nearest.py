"""Approximate nearest neighbours: a forest of random-projection trees searched through one priority queue.

The forest is fitted on a bounded sample (`sample` vectors, those with the smallest hashes), so its size
does not depend on the data; every vector is then indexed, by the leaf it falls into in each tree. A
query walks all trees through one queue ordered by margin, nearest side first, until the leaves it has
taken hold `share` of a tree's sample for each tree; every member of those leaves is a candidate, none
is capped, and candidates are reranked by exact Euclidean distance in double precision.

Equal vectors are folded first: of each distinct vector the `k + 1` smallest ids are kept, which is all
that any answer can hold, so copies cannot fill a leaf. Leaves are dealt out in blocks of a bounded
number of members, each met by the queries of the leaf; a block is what a task holds, and it passes on
the best `k + 1` of each query only.

Defined cases: vectors that are null, empty, zero, of another dimension than most or have null or
non-finite components take no part; null ids take no part; equal distances go by the smaller id; rows
repeated with one id and vector count once; rows that have the query's id are never its neighbours; with
fewer than k other ids all of them are returned; an empty table gives an empty result; further input columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, salted_join, ship

SAMPLE, TREES, LEAF = 8192, 4, 32


class Tree:
    """Inner nodes as arrays: a plane (normal, offset) and two children; a negative child is leaf -1 - child."""

    def __init__(self, points: np.ndarray, leaf: int, seed: int):
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []
        self.sizes: list[int] = []
        self.rng = np.random.default_rng(seed)
        self.root = self.grow(points, np.arange(len(points)), leaf)
        self.planes, self.cuts = (np.array(self.normals), np.array(self.offsets)) if self.normals else (np.zeros((0, points.shape[1])), np.zeros(0))
        self.kids = np.array(self.children, dtype=np.int64).reshape(-1, 2)

    def grow(self, points: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        """Depth-first with halves of equal size, so the depth is the logarithm of the sample."""
        if len(rows) > leaf:
            normal = self.rng.standard_normal(points.shape[1])
            normal /= np.linalg.norm(normal)
            at = points[rows] @ normal
            cut = float(np.median(at))
            left = at < cut
            if left.any() and not left.all():
                node = len(self.normals)
                self.normals.append(normal)
                self.offsets.append(cut)
                self.children.append([0, 0])
                self.children[node] = [self.grow(points, rows[left], leaf), self.grow(points, rows[~left], leaf)]
                return node
        self.sizes.append(len(rows))
        return -len(self.sizes)

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """The leaf of every point."""
        at = np.full(len(points), self.root, dtype=np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = (np.einsum("ij,ij->i", points[inner], self.planes[node]) >= self.cuts[node]).astype(np.int64)
            at[inner] = self.kids[node, side]
        return -1 - at


class Forest:
    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 42):
        self.trees = [Tree(sample, leaf, seed + k) for k in range(trees)]
        self.points = len(sample)

    def index(self, points: np.ndarray) -> np.ndarray:
        return np.stack([t.leaves(points) for t in self.trees], 1)

    def search(self, query: np.ndarray, share: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until they hold `share` of the sample per tree."""
        margins = [t.planes @ query - t.cuts for t in self.trees]
        queue = [(0.0, k, t.root) for k, t in enumerate(self.trees)]
        found, held, enough = [], 0, share * self.points * len(self.trees)
        while queue and held < enough:
            far, k, node = heapq.heappop(queue)
            t = self.trees[k]
            while node >= 0:
                m = margins[k][node]
                near = int(m >= 0)
                heapq.heappush(queue, (max(far, abs(m)), k, int(t.kids[node, 1 - near])))
                node = int(t.kids[node, near])
            found.append((k, -1 - node))
            held += t.sizes[-1 - node]
        return found


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): vectors that take part, as arrays of double."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    return rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))


def folded(rows: DataFrame, keep: int, salts: int = 64) -> DataFrame:
    """One row per distinct vector: key (its smallest id), v, ids (the `keep` smallest distinct ones, in order). Ids are thinned per vector and salt before a vector's meet."""
    salt = F.pmod(F.xxhash64("id"), F.lit(salts))
    one_each = rows.select("id", "v", salt.alias("s")).repartition("v", "s").dropDuplicates(["v", "s", "id"])
    first = one_each.withColumn("r", F.row_number().over(Window.partitionBy("v", "s").orderBy("id"))).where(F.col("r") <= keep)
    few = first.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= keep)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("key"), "v", "ids")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", share: float = 0.3, budget: int | None = None, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, block: int = 20_000, seed: int = 42) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest among all other rows.

    With a `budget`, a query visits leaves of about that many vectors a tree, however many there are, so that the work grows with
    the queries alone; the sample, and with it the number of leaves, has to grow along for that. `share` is the upper bound then."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = materialize(rows.where(F.size("v") == sizes[0]["n"]), "vectors")
    distinct = materialize(folded(rows, k + 1), "distinct-vectors")
    if budget:
        share = min(share, budget / max(1, distinct.count()))
    points = np.array([r["v"] for r in distinct.orderBy(F.xxhash64("key"), "key").limit(sample).select("v").collect()])  # a bounded sample
    forest = Forest(points, trees, leaf, seed)
    n_leaves = [len(t.sizes) for t in forest.trees]

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = forest.index(matrix(b.column(1)))
                for t in range(at.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array([t] * b.num_rows, pa.int32()), pa.array(at[:, t]), b.column(0), b.column(1), b.column(2)], names=["tree", "leaf", "key", "v", "ids"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, q in enumerate(matrix(b.column(1))):
                t, f = zip(*forest.search(q, share), strict=True)
                same = pa.array([n] * len(t))
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(f, pa.int64()), b.column(0).take(same), b.column(1).take(same)], names=["tree", "leaf", "q", "qv"])

    key_type = distinct.schema["key"].dataType.simpleString()
    indexed = distinct.mapInArrow(members, f"tree int, leaf long, key {key_type}, v array<double>, ids array<{key_type}>")
    # A leaf's members are dealt over blocks; how many follows from its counted members.
    counts = distinct.mapInArrow(members, indexed.schema).groupBy("tree", "leaf").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).select("tree", "leaf", "blocks")
    counts = F.broadcast(counts)  # at most trees * sample / leaf * 2 rows
    dealt = indexed.join(counts, ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).drop("blocks")
    wanted = rows.where(F.pmod(F.col("id"), F.lit(every)) == 0)
    asked = distinct.join(wanted.select("v").distinct(), "v", "left_semi").select("key", "v")
    seen = asked.repartition("key").mapInArrow(visits, f"tree int, leaf long, q {key_type}, qv array<double>")
    posed = seen.join(counts, ["tree", "leaf"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block come together, members first; queries are compared with them a batch at a time."""
        place, held, ready = None, [], None
        for b in batches:
            marks = list(zip(*(b.column(i).to_pylist() for i in (0, 1, 2)), strict=True))
            is_query = b.column(3).to_pylist()
            at = 0
            while at < b.num_rows:
                end = at
                while end < b.num_rows and marks[end] == marks[at] and is_query[end] == is_query[at]:
                    end += 1
                part = b.slice(at, end - at)
                if marks[at] != place:
                    place, held, ready = marks[at], [], None
                if not is_query[at]:
                    held.append(part)
                elif held:
                    if ready is None:
                        ready = matrix(pa.concat_arrays([h.column(5) for h in held])), pa.concat_arrays([h.column(4) for h in held]), pa.concat_arrays([h.column(6) for h in held])
                    yield best(part, *ready)
                at = end

    def best(part: pa.RecordBatch, vecs: np.ndarray, keys: pa.Array, ids: pa.Array) -> pa.RecordBatch:
        out_q, out_at, out_d = [], [], []
        number = keys.to_numpy(zero_copy_only=False)
        for n, q in enumerate(matrix(part.column(5))):
            d = np.sqrt(np.square(vecs - q).sum(1))
            some = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k + 1 else np.arange(len(d))
            some = some[np.lexsort((number[some], d[some]))][: k + 1]
            out_q += [n] * len(some)
            out_at.append(some)
            out_d.append(d[some])
        at = pa.array(np.concatenate(out_at))
        return pa.RecordBatch.from_arrays([part.column(4).take(pa.array(out_q)), keys.take(at), pa.array(np.concatenate(out_d)), ids.take(at)], names=["q", "key", "d", "ids"])

    both = dealt.select("tree", "leaf", "block", F.lit(False).alias("asks"), "key", "v", "ids").unionByName(posed.select("tree", "leaf", "block", F.lit(True).alias("asks"), F.col("q").alias("key"), F.col("qv").alias("v"), F.lit(None).cast(f"array<{key_type}>").alias("ids")))
    close = both.repartition("tree", "leaf", "block").sortWithinPartitions("tree", "leaf", "block", "asks").mapInArrow(compare, f"q {key_type}, key {key_type}, d double, ids array<{key_type}>")
    # The same neighbour may come from several trees; at most blocks * (k + 1) rows a query meet here.
    merged = close.dropDuplicates(["q", "key"]).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "key"))).where(F.col("r") <= k + 1)
    lists = merged.select("q", "d", F.explode("ids").alias("id")).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("r") <= k + 1)
    lists = lists.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("near"))
    # Many queries may share a vector: their rows are spread before they meet its list.
    queries = salted_join(salted_join(wanted.select(F.col("id").alias("query_id"), "v").distinct(), asked.select(F.col("key").alias("q"), "v"), "v").select("query_id", "q"), lists, "q")
    one = queries.select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("pos", "x"))
    return one.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))
