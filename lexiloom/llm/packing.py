"""Best-fit packing by a linear grouping scheme.

Only the histogram of piece lengths reaches the driver: at most `capacity` counts, whatever the size of
the data. There
1. lengths above `large` are rounded up within groups of equal cardinality,
2. the few sizes that are left are packed by configurations found by column generation (a linear
   programme whose pricing step is a knapsack), rounded down to whole sequences,
3. actual lengths take the places of the rounded ones, and
4. what is left over, and all small lengths, go by best fit, longest first, into the gaps.
Everything is done on runs of equal sequences, so the plan's size depends on the number of groups and
distinct lengths and not on the number of documents. Each piece then finds its place from its length
and its rank among pieces of that length; ranks come from counts per length and salt, so no length,
however common, is gathered in one task.

Defined cases: null text counts as empty and makes one piece, the separator; null and repeated ids get
their pieces; an empty table gives an empty result; further input columns are not read. Memory is
linear in the longest text.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STABLE, Memo, field, materialize, ship, tokenizer_path
from .token_counts import byte_symbols

CAPACITY = 2048
SALTS = 256
#: Lengths over this part of the capacity are grouped; the others go by best fit.
LARGE = 0.4
#: Fixed value: how the word-end vocabulary splits normalised text; blanks are dropped.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds:
    """Ids of texts as little-endian 32-bit bytes; each distinct word goes through the tokenizers library once."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]], [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != WORD_PATTERN:
            raise ValueError(f"{path} splits texts in another way")
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.words = regex.compile(WORD_PATTERN).findall
        self.symbol = byte_symbols()
        self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.memo = Memo(self.word, most=96 << 20)

    def word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize("".join(map(self.symbol.__getitem__, word.encode())))]).tobytes()

    def part(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter, without final sigma
        return b"".join(map(self.memo.__getitem__, self.words(text.lower())))

    def ids(self, text: str) -> bytes:
        if not text.isascii() and STABLE.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if any(s in text for s in self.special):
            return b"".join(self.special.get(p) or self.part(p) for p in self.cut.split(text))
        return self.part(text)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, input_ids. Narrow."""
    ship(docs.sparkSession)
    path = vocabulary or tokenizer_path("word_bpe_49k.json")
    end = array("I", [separator]).tobytes()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        words.memo.alone()
        ids_of = words.ids
        for b in batches:
            at, rows, ids = [], [], []
            for k, t in enumerate(b.column(1)):
                data = ids_of(t.as_py() or "") + end
                for n, start in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[start : start + 4 * capacity]
                    at.append(k)
                    rows.append((n, start // 4, len(own) // 4, zlib.crc32(own)))
                    if with_ids:
                        ids.append(np.frombuffer(own, dtype="<u4").astype(np.int32))
            piece, start, length, crc = zip(*rows, strict=True) if rows else ((), (), (), ())
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=[f.name for f in schema.fields])

    long = T.LongType()
    schema = T.StructType([field(docs, id_col), T.StructField("piece", T.IntegerType()), *(T.StructField(k, long) for k in ("start", "length", "ids_crc32")), *([T.StructField("input_ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    return docs.select(id_col, text_col).mapInArrow(kernel, schema)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {size number: copies}) covering at most the demand: the linear programme's basis, rounded down."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    d = np.array(demand, float)
    shifted = d * (1 + 1e-5 * np.arange(1, k + 1) / k)  # unequal shifts, so that the simplex steps do not go in circles
    inverse = np.diag(1 / np.diag(basis))
    for _ in range(8 * k):  # any basis is a valid plan; more steps only make it better
        y = inverse.sum(0)  # every configuration costs one sequence
        # Unbounded knapsack over the prices, by number of items.
        best, chosen = np.zeros(capacity + 1), []
        for _ in range(capacity // min(sizes)):
            new, pick = best.copy(), np.full(capacity + 1, -1)
            for i, s in enumerate(sizes):
                value = np.full(capacity + 1, -1.0)
                value[s:] = best[: capacity + 1 - s] + y[i]
                better = value > new + 1e-12
                new[better], pick[better] = value[better], i
            chosen.append(pick)
            if (pick < 0).all():
                break
            best = new
        if best[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(k), capacity
        for pick in reversed(chosen):
            if pick[room] >= 0:
                column[pick[room]] += 1
                room -= sizes[pick[room]]
        x, move = inverse @ shifted, inverse @ column
        ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        row = inverse[out] / move[out]
        inverse = inverse - np.outer(move, row)
        inverse[out] = row
    x = np.linalg.solve(basis, d)
    plans = [(int(np.floor(x[j] + 1e-7)), {i: round(basis[i, j]) for i in range(k) if basis[i, j] > 0.5}) for j in range(k)]
    left = list(demand)
    found = []
    for times, config in plans:
        times = min([times, *(left[i] // n for i, n in config.items())])
        if times > 0:
            found.append((times, config))
            for i, n in config.items():
                left[i] -= times * n
    return found


class Plan:
    """Runs (length, first rank, count, first sequence, offset): pieces of a length, by rank, one to a sequence."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, large: int | None = None, groups: int = 128):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.used_of = dict.fromkeys(histogram, 0)
        self.gaps: list[tuple[int, int, int]] = []  # room, first sequence, sequences; sorted
        large = int(capacity * LARGE) if large is None else large
        left = {n: c for n, c in histogram.items() if c > 0}
        if capacity in left:
            self.open(capacity, left.pop(capacity))
        big = sorted((n for n in left if n > large), reverse=True)
        total = sum(left[n] for n in big)
        if total:
            for n, c in self.grouped([(n, left[n]) for n in big], -(-total // groups)):
                left[n] -= c
        for n in sorted(left, reverse=True):
            self.best_fit(n, left[n])

    def grouped(self, items: list[tuple[int, int]], cardinality: int) -> list[tuple[int, int]]:
        """Steps 1 to 3; returns what has found a place, as (length, count)."""
        members: dict[int, list[list[int]]] = {}  # rounded size: [length, count], longest first
        size, room = 0, 0
        for n, c in items:
            while c:
                if not room:
                    size, room = n, cardinality
                take = min(c, room)
                members.setdefault(size, []).append([n, take])
                c, room = c - take, room - take
        sizes = sorted(members, reverse=True)
        placed: list[tuple[int, int]] = []
        for times, config in configurations(sizes, [sum(c for _, c in members[s]) for s in sizes], self.capacity):
            open_runs = [(self.sequences, times, 0)]  # first sequence, sequences, tokens in each
            self.sequences += times
            for i, copies in config.items():
                for _ in range(copies):
                    after = []
                    for first, n, used in open_runs:
                        while n:
                            head = members[sizes[i]][0]
                            take = min(n, head[1])
                            self.run(head[0], take, first, used)
                            placed.append((head[0], take))
                            after.append((first, take, used + head[0]))
                            first, n, head[1] = first + take, n - take, head[1] - take
                            if not head[1]:
                                members[sizes[i]].pop(0)
                    open_runs = after
            for first, n, used in open_runs:
                if used < self.capacity:
                    insort(self.gaps, (self.capacity - used, first, n))
        return placed

    def run(self, length: int, count: int, first: int, offset: int) -> None:
        self.runs.append((length, self.used_of[length], count, first, offset))
        self.used_of[length] += count

    def open(self, length: int, count: int) -> None:
        self.run(length, count, self.sequences, 0)
        if length < self.capacity:
            insort(self.gaps, (self.capacity - length, self.sequences, count))
        self.sequences += count

    def best_fit(self, length: int, count: int) -> None:
        """Each piece into the sequence with the least room that holds it: a sequence takes as many of one length as fit before the next does."""
        while count:
            at = bisect_left(self.gaps, (length, -1, 0))
            if at < len(self.gaps):
                room, first, n = self.gaps.pop(at)
            else:
                room, first, n = self.capacity, self.sequences, -(-count // (self.capacity // length))
                self.sequences += n
            each = room // length
            whole = min(n, count // each)
            for k in range(each if whole else 0):
                self.run(length, whole, first, self.capacity - room + k * length)
            count -= whole * each
            if whole and room - each * length:
                insort(self.gaps, (room - each * length, first, whole))
            if whole < n:
                rest = count if count < each else 0  # the last few of this length go into one sequence
                for k in range(rest):
                    self.run(length, 1, first + whole, self.capacity - room + k * length)
                count -= rest
                keep = 1 if rest else 0
                if keep and room - rest * length:
                    insort(self.gaps, (room - rest * length, first + whole, 1))
                if n - whole - keep:
                    insort(self.gaps, (room, first + whole + keep, n - whole - keep))

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Keys (length << 44 | first rank) in order with their first sequence and offset."""
        runs = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 5)
        return runs[:, 0] << 44 | runs[:, 1], runs[:, 3], runs[:, 4]


def ranked(cut: DataFrame, id_col: str, salts: int = SALTS) -> DataFrame:
    """cut with rank: from 0 within each length, gapless."""
    salted = cut.withColumn("__s", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "__s").agg(F.count("*").alias("__c"))  # at most lengths times salts rows
    before = Window.partitionBy("length").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "__s", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("length", "__s").orderBy(id_col, "piece", "ids_crc32")
    return salted.withColumn("__r", F.row_number().over(within)).join(starts, ["length", "__s"]).withColumn("rank", F.col("__start") + F.col("__r") - 1).drop("__s", "__r", "__start")


def pack(cut: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, groups: int = 128) -> DataFrame:
    """Pieces with sequence_id and offset; cut must be stable when read again, as a written table is."""
    ship(cut.sparkSession)
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    keys, firsts, offsets = Plan(histogram, capacity, groups=groups).arrays()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = b.column(n_length).to_numpy().astype(np.int64) << 44 | b.column(n_rank).to_numpy()
                run = np.searchsorted(keys, at, side="right") - 1
                cols = [b.column(k) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(firsts[run] + at - keys[run]), pa.array(offsets[run])], names=[*kept, "sequence_id", "offset"])

    kept = cut.columns
    n_length, n_rank = kept.index("length"), len(kept)
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked(cut, id_col).select(*kept, "rank").mapInArrow(kernel, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, groups: int = 128, with_ids: bool = False) -> DataFrame:
    return pack(materialize(pieces(docs, id_col, text_col, vocabulary, capacity, with_ids=with_ids), "pieces"), id_col, capacity, groups)
