"""Quality rules as weak supervision.

Rules look at counts of a text and vote good, bad or abstain. Expectation-maximisation over the counts
of vote patterns estimates, without labels, how often each rule gives each vote on good and on bad
documents; the posterior probability of a document's pattern replaces all-must-pass filtering. There
are at most 3 ** rules patterns, so what reaches the driver is bounded by the number of rules and not
by the data. The estimates use every document that passes the base test, which are those the verdict is
about: the base test settles the others, and their votes (two of its measures are rules too) would
shift the accuracies by cases that never come before the rules.

Defined cases: null text has no words and fails the base test; ids may be null or repeated, every row
gets its row; an empty table gives an empty result; further input columns are not read by the report
and stay untouched by the filter. Memory is linear in the longest text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, materialize, ship

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
GOOD, BAD, ABSTAIN = 1, 2, 0
WINDOW = 5


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, first occurrences included; each word counts once."""
    grams = list(zip(*(islice(words, k, None) for k in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    total = free = 0
    for at, g in enumerate(grams):
        if seen[g] > 1:
            total += at + window - max(at, free)
            free = at + window
    return total


def measure(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()  # bytes split at ASCII blanks only
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


@dataclass(frozen=True)
class Rule:
    """Votes bad where a share is over `bad`, good where it is at most `good`, else abstains; abstains also below `least` words."""

    name: str
    good: float
    bad: float
    least: int = 0

    def vote(self, value: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        v = np.where(value > self.bad, BAD, np.where(value <= self.good, GOOD, ABSTAIN))
        return np.where(n_words < self.least, ABSTAIN, v)


#: The declarative rules; each reads the share of the same name in shares().
RULES = (
    Rule("symbol_share", good=0.02, bad=0.10),
    Rule("symbols_per_word", good=0.05, bad=0.40),
    Rule("repeat_share", good=0.02, bad=0.15, least=20),
    Rule("dup_line_share", good=0.05, bad=0.30, least=20),
    Rule("dup_lines_per_word", good=0.005, bad=0.03, least=20),
    Rule("word_length_off", good=1.0, bad=2.0),
    Rule("shortness", good=0.034, bad=0.084),
)


def shares(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) -> dict[str, np.ndarray]:
    words, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    return {
        "symbol_share": n_symbols / chars,
        "symbols_per_word": n_symbols / words,
        "repeat_share": n_repeat_words / words,
        "dup_line_share": n_dup_lines / np.maximum(words / 12, 1),
        "dup_lines_per_word": n_dup_lines / words,
        "word_length_off": np.abs(word_chars / words - 5.0),
        "shortness": 1 / words,
    }


def pattern(columns: tuple[np.ndarray, ...], rules: tuple[Rule, ...] = RULES) -> np.ndarray:
    """Votes of all rules as one number in base 3, the first rule lowest."""
    by_name, code = shares(*columns), np.zeros(len(columns[0]), np.int64)
    for k, r in enumerate(rules):
        code += r.vote(by_name[r.name], columns[0]).astype(np.int64) * 3**k
    return code


def fit(counts: dict[int, int], n_rules: int, rounds: int = 200, good: float = 0.9, accuracy: float = 0.6, trust: float = 0.9) -> dict[int, float]:
    """Posterior probability of good for every pattern, by EM on a mixture of two classes.

    A rule that votes is right with its own estimated accuracy on good and on bad documents, independently
    of the others; an abstention says nothing. The first guess is the all-must-pass verdict, held with
    probability `trust`; from there each rule's accuracy on each class is learned, so that rules which
    contradict the others lose their veto. One imagined vote per rule and class, right with `accuracy`,
    and one imagined document keep estimates off 0 and 1."""
    if not counts:
        return {}
    codes = np.array(sorted(counts), dtype=np.int64)
    weight = np.array([counts[c] for c in codes], dtype=float)
    votes = np.stack([codes // 3**k % 3 for k in range(n_rules)], 1)
    said_good, said_bad = (votes == GOOD).astype(float), (votes == BAD).astype(float)
    vetoed = said_bad.any(1)
    share = np.stack([np.where(vetoed, trust, 1 - trust), np.where(vetoed, 1 - trust, trust)], 1)  # bad, good
    right = np.zeros((2, n_rules))
    for _ in range(rounds):
        mass = weight[:, None] * share
        g, b = mass.T @ said_good, mass.T @ said_bad
        new = (np.stack([b[0], g[1]]) + accuracy) / (g + b + 1)
        prior = (mass.sum(0) + np.array([1 - good, good])) / (weight.sum() + 1)
        done, right = np.abs(new - right).max() < 1e-9, new
        if done:
            break
        good_votes = np.log(np.stack([1 - right[0], right[1]]))
        bad_votes = np.log(np.stack([right[0], 1 - right[1]]))
        log = np.log(prior)[None] + said_good @ good_votes.T + said_bad @ bad_votes.T
        share = np.exp(log - log.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
    return dict(zip(codes.tolist(), share[:, 1].tolist(), strict=True))


def base_failed(n_words, n_repeat_words):
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_votes(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns of keep with __q: the five counts, base_failed and the vote pattern. Narrow."""
    ship(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([measure(t.as_py() or "") for t in b.column(at)], dtype=np.int64).reshape(-1, 5)
            cols = tuple(found[:, k] for k in range(5))
            votes = pa.StructArray.from_arrays([*map(pa.array, cols), pa.array(base_failed(cols[0], cols[4])), pa.array(pattern(cols))], names=[*COUNTS, "base_failed", "pattern"])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], votes], names=[*keep, "__q"])

    long = T.LongType()
    votes = T.StructType([*(T.StructField(k, long) for k in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("pattern", long)])
    sent = [*keep, *([] if text_col in keep else [text_col])]
    at = sent.index(text_col)
    return docs.select(*sent).mapInArrow(kernel, T.StructType([*(docs.schema[k] for k in keep), T.StructField("__q", votes)]))


def verdicts(voted: DataFrame, threshold: float) -> DataFrame:
    """A small table (pattern, quality, good) with a row for each vote pattern that occurs; at most 3 ** rules rows."""
    spark = voted.sparkSession
    counts = {r["pattern"]: r["n"] for r in voted.where(~F.col("__q.base_failed")).groupBy(F.col("__q.pattern").alias("pattern")).agg(F.count("*").alias("n")).collect()}
    rows = [(c, p, p >= threshold) for c, p in fit(counts, len(RULES)).items()]
    return spark.createDataFrame(rows, "pattern long, quality double, good boolean")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: id, the counts, base_failed, kept and the posterior quality (null where the base test failed)."""
    voted = materialize(with_votes(docs, text_col, [id_col]), "votes")
    by = F.broadcast(verdicts(voted, threshold).withColumnRenamed("pattern", "__p"))  # at most 3 ** len(RULES) rows
    failed = F.col("__q.base_failed")
    return voted.join(by, (F.col("__q.pattern") == F.col("__p")) & ~failed, "left").select(id_col, *(F.col(f"__q.{k}") for k in COUNTS), failed, (~failed & F.coalesce("good", F.lit(False))).alias("kept"), "quality")


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without the documents that the base test or the verdict rejects; all columns as they came."""
    voted = materialize(with_votes(docs, text_col, docs.columns), "voted")
    by = F.broadcast(verdicts(voted, threshold).where("good").select(F.col("pattern").alias("__p")))
    return voted.where(~F.col("__q.base_failed")).join(by, F.col("__q.pattern") == F.col("__p"), "left_semi").drop("__q")
