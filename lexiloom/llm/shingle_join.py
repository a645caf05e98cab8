"""N-gram Jaccard join by a universe-partition pigeonhole.

Sets of word shingles (64-bit hashes) are compared by size band. The universe of shingles is cut into
segments by hash, as many as a band's largest allowed symmetric difference asks for. If two sets link,
their difference is spread so thinly that some segment agrees: where a segment is allotted 1, its subset
is a key (no difference there); where it is allotted 2, its subset and all its one-deletion neighbours
are keys (one difference there). The allotments of a band must add up to more than the difference; which
mix is taken follows from a cost model of keys sent and chance candidates met (see allocation). Small
sets get deletion neighbourhoods, large ones plain subsets.

Sets that share a key are candidates. They are verified exactly, in three rounds so that a group of
near copies does not cost all its pairs: first every set against one other, the smallest of most of its
keys; then, in keys whose sets are not yet in one component, every set against the key's smallest and
the next two; then all pairs of such a key that are still apart. Before whole sets are
compared, an exact lower bound of their difference from folded parity sketches rules most out. Equal
sets are one class throughout and need no pairs at all. Components are found on the executors, never on
the driver.

Empty segments are not used as keys, because many sets would share them, unless a set has so few filled
segments that the count no longer proves a match; two such sets then meet through their empty segments,
and any other pair is proved by the set that has enough.

Hashes of shingles, classes and keys have 64 bits: texts that differ are taken for equal only if a
collision happens, about once in 2 ** 64 comparisons.

Defined cases: null or blank text has an empty set and links with nothing; a null id gets the smallest
id of its component, or null; repeated rows are copies; an empty table gives an empty result; further
input columns are not read by the report and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, bounded_broadcast, field, materialize, salted_join, ship

U = np.uint64
CHUNK = 400_000
MOST_BROADCAST = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """Fixed constants: the 64-bit finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


# -- sets ---------------------------------------------------------------------------------------------


class Shingler:
    """Distinct word shingles of texts: ASCII letters lowered, words cut at ASCII blanks."""

    def __init__(self, words: int):
        import xxhash

        self.words, self.memo = words, Memo(xxhash.xxh3_64_intdigest)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """The sorted set of each text."""
        split = [t.encode().lower().split() for t in texts]
        k, lens = self.words, np.array([len(w) for w in split], dtype=np.int64)
        flat = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(split)), dtype=U, count=int(lens.sum()))
        ends, out = np.cumsum(lens), []
        with np.errstate(over="ignore"):
            if len(flat) >= k:
                rolled = flat[: len(flat) - k + 1].copy()
                for j in range(1, k):
                    rolled = rolled * U(0x9E3779B97F4A7C15) + flat[j : len(flat) - k + 1 + j]
                rolled = mix(rolled)
            for n, end in zip(lens.tolist(), ends.tolist(), strict=True):
                if n >= k:
                    s = np.sort(rolled[end - n : end - k + 1])
                    out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
                elif n:
                    h = U(n)
                    for w in flat[end - n : end]:
                        h = mix(np.array([h * U(0x9E3779B97F4A7C15) + w]))[0]
                    out.append(np.array([h]))
                else:
                    out.append(np.zeros(0, U))
        return out


@lru_cache(maxsize=4)
def shingler(words: int) -> Shingler:
    return Shingler(words)


def class_of(s: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    return int(mix(np.array([mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) + U(len(s))]))[0].astype(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """Parities of the counts of members per slot, the slots being a power of two of at least twice the members, 64 to 65,536."""
    slots = min(max(64, 1 << (2 * len(s) - 1).bit_length()), 1 << 16)
    return np.packbits((np.bincount((s & U(slots - 1)).astype(np.int64), minlength=slots) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(x: bytes, size: int) -> np.ndarray:
    """A sketch folded to `size` bytes: still parities, of fewer slots."""
    a = np.frombuffer(x, dtype=np.uint8)
    while len(a) > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


# -- bands, allotments, keys ----------------------------------------------------------------------------


class Bands:
    """Size bands with their segments, for a threshold of num / den."""

    def __init__(self, num: int, den: int, ratio: float = 1.5):
        self.num, self.den = num, den
        self.lows, self.highs, self.ones, self.twos = [], [], [], []
        low = 1
        while low < 1 << 31:
            high = max(low, int(low * ratio))
            need = self.apart(high, self.widest(high)) + 1
            ones, twos = self.allocation(need, (low + high) / 2)
            self.lows.append(low)
            self.highs.append(high)
            self.ones.append(ones)
            self.twos.append(twos)
            low = high + 1
        self.low_of, self.high_of = np.array(self.lows), np.array(self.highs)
        self.one_of, self.two_of = np.array(self.ones), np.array(self.twos)

    def widest(self, n):
        """The largest size that may link with n."""
        return n * self.den // self.num

    def apart(self, x, y):
        """The largest symmetric difference of linked sets of sizes x and y."""
        return (x + y) * (self.den - self.num) // (self.den + self.num)

    @staticmethod
    def allocation(need: int, size: float, crowd: float = 1e6, chance: float = 0.4, verify: float = 4.0) -> tuple[int, int]:
        """(segments allotted 1, segments allotted 2): 2 % and one more than needed, so that empty segments can be left out.

        Cost of a mix: keys sent, one per segment and one more per member of segments allotted 2, and
        `verify` for each of `crowd` sets met by chance, which share each member with probability `chance`."""
        need += 1 + need // 50

        def cost(twos: int) -> float:
            ones = max(0, need - 2 * twos)
            each = size / (ones + twos)
            met = ones * chance**each + twos * chance ** max(each - 1, 0) * (1 + each)
            return ones + twos * (1 + each) + verify * crowd * met / max(size, 1) ** 2

        few = range(0, need // 2 + 1) if need <= 200 else [0, need // 2]
        twos = min(few, key=cost)
        return max(0, need - 2 * twos), twos

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high_of, n)

    def alone(self, n):
        """Sizes at which linked sets are equal, so that classes say it all."""
        return self.apart(n, self.widest(n)) == 0


@lru_cache(maxsize=4)
def bands(num: int, den: int) -> Bands:
    return Bands(num, den)


def keys_for(b: Bands, flat: np.ndarray, owner: np.ndarray, sizes: np.ndarray, band: np.ndarray, proof: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key) of sets in their bands; flat holds members by owner; proof is the largest difference each set has to prove."""
    ones, twos = b.one_of[band], b.two_of[band]
    m = ones + twos
    base = np.concatenate(([0], np.cumsum(m)))[:-1]
    total = int(m.sum())
    seg = (((flat >> U(32)) * m.astype(U)[owner]) >> U(32)).astype(np.int64)
    at, value = base[owner] + seg, mix(flat)
    sums, count = np.zeros(total, U), np.bincount(at, minlength=total)
    np.add.at(sums, at, value)
    seg_owner = np.repeat(np.arange(len(sizes)), m)
    seg_number = np.arange(total) - base[seg_owner]
    double = seg_number < twos[seg_owner]
    place = mix((band[seg_owner].astype(U) << U(32)) + seg_number.astype(U) + U(1))
    proved = np.bincount(seg_owner, weights=np.where(double, 2 * (count >= 2), count >= 1), minlength=len(sizes))
    short = proved <= proof
    own = (count > 0) | short[seg_owner]
    owners, keys = [seg_owner[own]], [mix(sums[own] ^ place[own])]
    less = double[at] & ((count[at] >= 2) | short[owner])
    if less.any():
        owners.append(owner[less])
        keys.append(mix((sums[at[less]] - value[less]) ^ place[at[less]]))
    return np.concatenate(owners), np.concatenate(keys)


def keys_of(b: Bands, sets: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct keys of each set, signed: of its own band, and of the band below if a smaller set there may link with it."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = [np.zeros(0, np.int64)] * len(sets)
    live = np.flatnonzero((sizes > 0) & ~b.alone(np.maximum(sizes, 1)))
    if not live.size:
        return out
    n, band = sizes[live], b.of(sizes[live])
    below = np.where(band > 0, b.high_of[band - 1], 0)
    smaller = (below * b.den >= b.num * n) & (band > 0)
    found_owner, found = [], []
    with np.errstate(over="ignore"):
        for mask, bands_, proof in ((np.ones(len(n), bool), band, b.apart(n, b.widest(n))), (smaller, band - 1, b.apart(below, n))):
            rows = np.flatnonzero(mask)
            if rows.size:
                flat = np.concatenate([sets[live[r]] for r in rows])
                o, k = keys_for(b, flat, np.repeat(np.arange(len(rows)), n[rows]), n[rows], bands_[rows], proof[rows])
                found_owner.append(live[rows][o])
                found.append(k)
    owner, key = np.concatenate(found_owner), np.concatenate(found).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    owner, key = owner[order], key[order]
    cuts = np.searchsorted(owner, np.arange(len(sets) + 1))
    for i in live:
        out[i] = np.unique(key[cuts[i] : cuts[i + 1]])
    return out


# -- the join -------------------------------------------------------------------------------------------


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) with a bounded amount of text each."""
    texts, first, size = [], 0, 0
    for k, t in enumerate(batch.column(column)):
        texts.append(t.as_py() or "")
        size += len(texts[-1]) // 5
        if size > CHUNK:
            yield first, texts
            texts, first, size = [], k + 1, 0
    if texts:
        yield first, texts


def described(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> DataFrame:
    """Per row: id, text_hash, n, uid (null for empty sets), and where a task meets a class first, its sketch and keys."""
    ship(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, b, met = shingler(words), bands(num, den), set()
        s.memo.alone()
        for batch in batches:
            for first, texts in chunks(batch, 2):
                sets = s.sets(texts)
                uid = [class_of(x) if len(x) else None for x in sets]
                fresh = []
                for i, x in enumerate(uid):
                    if x is not None and x not in met:
                        fresh.append(i)
                        if len(met) < 200_000:  # only saves rows: classes met again are sent again
                            met.add(x)
                keys: list = [None] * len(sets)
                marks: list = [None] * len(sets)
                for i, k in zip(fresh, keys_of(b, [sets[i] for i in fresh]), strict=True):
                    keys[i], marks[i] = k, sketch(sets[i])
                here = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([here.column(0), here.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(uid, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=[f.name for f in schema.fields])

    long = T.LongType()
    schema = T.StructType([field(docs, id_col, "id"), T.StructField("text_hash", long), T.StructField("n", long), T.StructField("uid", long), T.StructField("sketch", T.BinaryType()), T.StructField("keys", T.ArrayType(long))])
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("t")).mapInArrow(kernel, schema)


def members(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(uid, members): sets of the rows as sorted 64-bit numbers in bytes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shingler(words)
        s.memo.alone()
        for batch in batches:
            for _, texts in chunks(batch, 0):
                sets = [x for x in s.sets(texts) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array(map(class_of, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["uid", "members"])

    return docs.select(text_col).mapInArrow(kernel, "uid long, members binary")


def passing(pairs: DataFrame, num: int, den: int, exact: bool) -> DataFrame:
    """Pairs (a, b, x, y) whose columns x and y hold members (exact) or sketches with sizes (a lower bound)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = x.as_buffer(), y.as_buffer()
                if exact:
                    p, q = np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)
                    both = np.concatenate((p, q))
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    if den * common >= num * (len(p) + len(q) - common):
                        keep.append(k)
                else:
                    size = min(len(x), len(y))
                    apart = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())
                    total = batch.column(4)[k].as_py() + batch.column(5)[k].as_py()
                    if apart * (den + num) <= total * (den - num):
                        keep.append(k)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return pairs.mapInArrow(kernel, "a long, b long")


class Sketches:
    """A column of sketches in words of eight bytes."""

    def __init__(self, column: pa.Array):
        raw = column.cast(pa.large_binary())
        first, ends = raw.offset, np.frombuffer(raw.buffers()[1], dtype=np.int64)
        ends = ends[first : first + len(raw) + 1]
        self.words = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].copy().view(U)
        self.at, self.size = (ends[:-1] - ends[0]) // 8, np.diff(ends) // 8

    def within(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, held: int = 1 << 19) -> np.ndarray:
        """Of the pairs (x, y), the numbers of those that differ in at most `most` slots, the larger sketch folded to the smaller one."""
        found = []
        kinds = self.size[x] * (1 << 20) + self.size[y]
        for kind in np.unique(kinds):
            p, q = divmod(int(kind), 1 << 20)
            some, w = np.flatnonzero(kinds == kind), min(p, q)
            step = max(1, held // max(p, q))
            for part in (some[k : k + step] for k in range(0, len(some), step)):
                left, right = (np.bitwise_xor.reduce(self.words[self.at[z[part]][:, None] + np.arange(n)].reshape(len(part), -1, w), axis=1) for z, n in ((x, p), (y, q)))
                found.append(part[np.bitwise_count(left ^ right).sum(1, dtype=np.int64) <= most[part]])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def beside(num: int, den: int):
    """A kernel over rows in the order of (key, block, uid): pairs of a set with the first of its (key, block) and the two before it, if
    their components differ and the sketches do not rule them out. Three rows are held from batch to batch."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            here = joined([held, batch]) if held else batch
            key, block, uid, comp, n = numbers(here, "key", "block", "uid", "comp", "n")
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            x = np.arange(held.num_rows if held else 0, len(new))
            pairs = np.concatenate([np.stack([x, y]) for y in (first[x], np.maximum(x - 1, first[x]), np.maximum(x - 2, first[x]))], 1)
            x, y = pairs
            x, y = pairs[:, (comp[x] != comp[y]) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y]))]
            a, b = np.minimum(uid[x], uid[y]), np.maximum(uid[x], uid[y])
            one = np.unique(np.stack([a, b]), axis=1, return_index=True)[1]
            x, y, a, b = x[one], y[one], a[one], b[one]
            good = Sketches(here.column("sketch")).within(x, y, (n[x] + n[y]) * (den - num) // (den + num))
            yield pa.RecordBatch.from_arrays([pa.array(a[good], pa.int64()), pa.array(b[good], pa.int64())], names=["a", "b"])
            last = sorted({int(first[-1]), *range(max(int(first[-1]), len(new) - 2), len(new))})
            held = here.take(pa.array(last))

    return kernel


def across(num: int, den: int):
    """A kernel over the rows of each (key, i, j), which come together: all pairs in different components that the sizes and the sketches
    do not rule out; pairs of one block where i = j only."""

    def pairs(group: pa.RecordBatch, tile: int = 256) -> tuple[list, list]:
        uid, comp, n, block, i, j = numbers(group, "uid", "comp", "n", "block", "i", "j")
        marks, a, b, place = Sketches(group.column("sketch")), [], [], np.arange(len(uid))
        for k in range(0, len(n), tile):
            t = slice(k, k + tile)
            open_ = (comp[t, None] != comp) & (place[t, None] < place)
            if i[0] != j[0]:
                open_ &= block[t, None] != block
            x, y = np.nonzero(open_)
            x += k
            some = den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])
            x, y = x[some], y[some]
            good = marks.within(x, y, (n[x] + n[y]) * (den - num) // (den + num))
            a.append(np.minimum(uid[x[good]], uid[y[good]]))
            b.append(np.maximum(uid[x[good]], uid[y[good]]))
        return a, b

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def of(groups: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b, empty = [], [], np.zeros(0, np.int64)
            for g in groups:
                if g.num_rows > 1:
                    x, y = pairs(g)
                    a += x
                    b += y
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *a])), pa.array(np.concatenate([empty, *b]))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            here = joined([*held, batch])
            key, i, j = numbers(here, "key", "i", "j")
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist()]
            yield of([here.slice(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)])
            held = [here.slice(cuts[-1])]
        if held:
            yield of(held)

    return kernel


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one task, the smaller root on top."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root[y]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in list(root)], pa.int64())], names=["uid", "label"])


def labels(links: DataFrame, one_task: int = 200_000) -> DataFrame:
    """(uid, label): the smallest uid that links (a written table) reach, for every uid that has a link.

    Up to `one_task` counted links, one task unites them, whose table of at most 400,000 numbers takes about 50 MB; beyond
    that, min-label propagation with pointer jumping over tables, in as many rounds as it takes. Both give the same labels."""
    if links.count() <= one_task:
        return materialize(links.select("a", "b").coalesce(1).mapInArrow(united, "uid long, label long"), "labels")
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = materialize(edges.groupBy(F.col("a").alias("uid")).agg(F.min("b").alias("m")).select("uid", F.least("uid", "m").alias("label")), "labels")
    while True:
        heard = salted_join(edges, now.withColumnRenamed("uid", "a"), "a").groupBy(F.col("b").alias("uid")).agg(F.min("label").alias("m"))
        better = now.join(heard, "uid").select("uid", "label", F.least("label", "m").alias("new"))
        jump = now.select(F.col("uid").alias("new"), F.col("label").alias("far"))
        new = materialize(salted_join(better, jump, "new", "left").select("uid", "label", F.least("new", F.coalesce("far", "new")).alias("new")), "labels")
        if new.where("label != new").isEmpty():
            return new.select("uid", "label")
        now = new.select("uid", F.col("new").alias("label"))


def links(docs: DataFrame, table: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, block: int = 1024) -> DataFrame:
    """(uid, label) of the classes that link with another one; table is described(), written."""
    spark = docs.sparkSession
    rows = table.where(F.size("keys") > 0).select("uid", F.explode("keys").alias("key"))
    by_key = Window.partitionBy("key")
    met = rows.withColumn("lead", F.min("uid").over(by_key)).withColumn("top", F.max("uid").over(by_key)).where("lead != top")
    shared = materialize(met.select("key", "uid", "lead").distinct(), "shared-keys")
    involved = materialize(shared.select("uid").distinct(), "involved")
    n = involved.count()
    known = table.where("sketch is not null").select("uid", "n", "sketch")
    known = materialize(known.join(bounded_broadcast(involved, n, MOST_BROADCAST), "uid", "left_semi").groupBy("uid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")

    def fits(pairs: DataFrame) -> DataFrame:
        """Pairs that the sketches do not rule out."""
        one = pairs.join(known.select(F.col("uid").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("x")), "a")  # hot sides are split at run time
        two = one.join(known.select(F.col("uid").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("y")), "b")
        return passing(two.where(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)").select("a", "b", "x", "y", "n_a", "n_b"), num, den, exact=False)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (written) that link, by their whole sets, which are made again from the texts of one row a class."""
        wanted = pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct()
        one_row = materialize(table.where("n > 0").join(bounded_broadcast(wanted, n, MOST_BROADCAST), "uid", "left_semi").groupBy("uid").agg(F.min("id").alias("id")).select("id").distinct(), f"{name}-rows")
        few = bounded_broadcast(one_row.withColumnRenamed("id", id_col), one_row.count(), MOST_BROADCAST)
        texts = docs.select(id_col, text_col).join(few, docs[id_col].eqNullSafe(few[id_col]), "left_semi")
        sets = members(texts, id_col, text_col, words)
        sets = materialize(sets, f"{name}-sets")
        one = pairs.join(sets.select(F.col("uid").alias("a"), F.col("members").alias("x")), "a")
        two = one.join(sets.select(F.col("uid").alias("b"), F.col("members").alias("y")), "b")
        return materialize(passing(two.select("a", "b", "x", "y"), num, den, exact=True).distinct(), f"{name}-links")

    # One pair a set: with the smallest set of one of its keys, the one it shares most keys with. As all keys go by one order, most
    # members of a group of near copies come into one component this way, at a cost that is linear in the group.
    chosen = shared.where("uid != lead").groupBy("uid", "lead").agg(F.count("*").alias("times")).groupBy("uid").agg(F.max_by("lead", F.struct("times", -F.col("lead"))).alias("lead"))
    first = materialize(fits(chosen.select(F.col("lead").alias("a"), F.col("uid").alias("b"))), "first-pairs")
    found = verified(first, "first")
    label = labels(found)

    def apart(label: DataFrame, least: int) -> DataFrame:
        """Members of the keys of `least` sets or more whose sets are in different components, with size and sketch, dealt over blocks.

        Of a key, `odd` are the sets outside its largest component: only pairs with one of them are still open. They have the
        blocks from 0 on, the others those after them."""
        at = shared.join(label, "uid", "left").select("key", "uid", F.coalesce("label", "uid").alias("comp"))
        parts = at.groupBy("key", "comp").agg(F.count("*").alias("n"))
        keys = parts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"), F.max("n").alias("even"), F.sum("n").alias("rows"), F.count("*").alias("comps")).where(f"comps > 1 and rows >= {least}")
        keys = keys.select("key", "most", F.ceil((F.col("rows") - F.col("even")) / block).cast("int").alias("odds"), F.ceil(F.col("even") / block).cast("int").alias("evens"))
        at = at.join(keys, "key").withColumn("odd", F.col("comp") != F.col("most"))
        number = F.when(F.col("odd"), F.pmod(F.xxhash64("uid"), F.col("odds"))).otherwise(F.col("odds") + F.pmod(F.xxhash64("uid"), F.col("evens"))).cast("int")
        return at.select("key", number.alias("block"), "uid", "comp", "odd", "odds", "evens").join(known, "uid")

    # In keys whose sets are still in different components, each against the first of its block and the two before it.
    fields = ("key", "block", "other", "uid", "comp", "n", "sketch")
    some = apart(label, 2).withColumn("block", F.when(F.col("odds") + F.col("evens") > 2, F.col("block")).otherwise(0)).withColumn("other", F.col("block"))
    few = some.select(*fields).repartition("key", "block").sortWithinPartitions("key", "block", "uid").mapInArrow(beside(num, den), "a long, b long").distinct()
    again = materialize(few.join(first, ["a", "b"], "left_anti"), "next-pairs")
    if not again.isEmpty():
        found = materialize(found.unionByName(verified(again, "next")), "found-links")
        label = labels(found)

    # What is left: all pairs within a key whose sets are in different components. Of up to four sets, the round before had them all.
    rest = apart(label, 5).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("odds") + F.when(F.col("odd"), F.col("evens")).otherwise(0) - 1)))
    dealt = rest.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "uid", "comp", "n", "block", "sketch")
    second = materialize(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(across(num, den), "a long, b long").distinct(), "cross-pairs")
    if second.isEmpty():
        return label
    return labels(materialize(found.unionByName(verified(second, "cross")), "all-links"))


def components(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> DataFrame:
    """Per row: id, text_hash, n and component, the smallest id reachable by links, itself included."""
    table = materialize(described(docs, id_col, text_col, words, num, den), "shingles")
    label = links(docs, table, id_col, text_col, words, num, den)
    classes = table.where("uid is not null").groupBy("uid").agg(F.min("id").alias("low"), F.count("*").alias("rows"))
    several = materialize(classes.join(label, "uid", "left").where("rows > 1 or label is not null").select("uid", F.coalesce("label", "uid").alias("root"), "low"), "classes")
    roots = several.groupBy("root").agg(F.min("low").alias("component"))
    return salted_join(table.select("id", "text_hash", "n", "uid"), salted_join(several, roots, "root").select("uid", "component", F.lit(True).alias("grouped")), "uid", "left").select("id", "text_hash", "n", F.when(F.col("grouped"), F.col("component")).otherwise(F.col("id")).alias("component"), F.col("uid"), F.coalesce("grouped", F.lit(False)).alias("grouped"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    return components(docs, id_col, text_col, words, num, den).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component, the one with the smallest id (then text hash); all columns as they came."""
    found = materialize(components(docs, id_col, text_col, words, num, den).where("grouped").select("id", "text_hash", "component", "uid"), "groups")
    # Groups whose ids are all null have no smallest id; they go by their class.
    group = F.coalesce(F.col("component").cast("string"), F.concat(F.lit("class "), F.col("uid")))
    rows = found.groupBy(group.alias("g"), "id", "text_hash").agg(F.count("*").alias("times"))
    best = rows.groupBy("g").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "text_hash")).alias("best"))
    judged = salted_join(rows, best, "g").withColumn("stays", F.col("id").eqNullSafe(F.col("best.id")) & (F.col("text_hash") == F.col("best.text_hash")))
    out = materialize(judged.where("not stays or times > 1").select("id", "text_hash", "stays"), "dropped")
    n = out.count()
    mine = docs.withColumn("__hash", F.xxhash64(text_col))

    def at(some: DataFrame):
        return mine[id_col].eqNullSafe(some["id"]) & (mine["__hash"] == some["text_hash"])

    gone = bounded_broadcast(out, n, MOST_BROADCAST)
    kept = mine.join(gone, at(gone), "left_anti").drop("__hash")
    repeated = out.where("stays")
    if repeated.isEmpty():
        return kept
    one_each = mine.join(repeated, at(repeated), "left_semi").dropDuplicates([id_col, "__hash"]).drop("__hash")
    return kept.unionByName(one_each)
