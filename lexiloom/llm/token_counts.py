"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers.

A text is cut at the strings of added tokens (one token each), then by the split pattern of the
byte-level pre-tokenizer. A word starts as its UTF-8 bytes in a doubly linked list; a heap gives the
lowest-rank adjacent pair, leftmost first; each merge takes one symbol away. The count is the
initial symbols minus the merges.

Defined cases: null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows are
counted each; an empty table gives an empty result; further input columns, whatever their names, are
not read. Words of any length take O(n log n).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import STABLE, Memo, field, ship, tokenizer_path

#: Fixed value: the split pattern of byte-level pre-tokenization.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others take the code points from 256 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    shifted = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return [chr(b) if b in set(own) else shifted[b] for b in range(256)]


class MergeCounter:
    """Counts tokens of texts for one byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        #: A pair of symbol numbers as one integer, to its rank; the symbol number that the merge of a rank makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        numbers = {s: i for i, s in enumerate(byte_symbols())}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[numbers[a] << 32 | numbers[b]] = rank
            self.made.append(numbers.setdefault(a + b, len(numbers)))
        self.words = regex.compile(SPLIT_PATTERN).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.marks = special
        self.library = None
        self.memo = Memo(self.count_word, most=96 << 20)

    def count_word(self, word: str) -> int:
        """A heap entry is rank << 32 | position; symbols[i] < 0 marks a position that a merge took away."""
        symbols: list[int] = list(word.encode())
        n = len(symbols)
        if n < 2:
            return n
        rank_of, made, pop, push = self.ranks.get, self.made, heapq.heappop, heapq.heappush
        heap = [rank << 32 | i for i in range(n - 1) if (rank := rank_of(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFF
            left, j = symbols[i], following[i]
            if left < 0 or j >= n or rank_of(left << 32 | symbols[j]) != entry >> 32:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = new, _ = made[entry >> 32], -1
            following[i] = k = following[j]
            merges += 1
            if k < n:
                before[k] = i
                if (rank := rank_of(new << 32 | symbols[k])) is not None:
                    push(heap, rank << 32 | i)
            if (h := before[i]) >= 0 and (rank := rank_of(symbols[h] << 32 | new)) is not None:
                push(heap, rank << 32 | h)
        return n - merges

    def split(self, text: str) -> list[str]:
        """Words of a text; with characters whose class differs between Unicode versions, as the library cuts them."""
        if text.isascii() or not STABLE.search(text):
            return self.words(text)
        if self.library is None:
            from tokenizers import pre_tokenizers

            self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        if self.special and any(m in text for m in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(sum(map(self.memo.__getitem__, self.split(p))) for p in parts)
        return sum(map(self.memo.__getitem__, self.split(text)))


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = 512) -> DataFrame:
    """One row per document: the id, n_bytes, n_tokens and over_limit (n_tokens > limit). Narrow: no shuffle."""
    ship(docs.sparkSession)
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        c.memo.alone()
        count = c.count
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            n = pa.array((count(t.as_py()) for t in texts), pa.int64())
            size = pc.binary_length(texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([field(docs, id_col), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select(id_col, text_col).mapInArrow(kernel, schema)
