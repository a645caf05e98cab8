"""Dictionaries and lexicons: entries, buckets, lookups, paradigms, narrowing and name indexes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of the Sanskrit alphabet in order; kṣ and jñ are buckets of their own, last. As in the order of
#: the rules, a stands before ai and au and k before kh, so the longer ones are met only in the strict alphabet.
ALPHABET = "a ā i ī u ū ṛ ṝ ḷ e ai o au k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h".split()
LAST = ["kṣ", "jñ"]


def bucket(c: Column, strict: bool = False) -> Column:
    """The first letter that the headword starts with, '#' if none."""
    order = LAST + (sorted(ALPHABET, key=len, reverse=True) if strict else ALPHABET)
    low = F.lower(c)
    return F.coalesce(*(F.when(low.startswith(x), F.lit(x)) for x in order), F.lit("#"))


def bucket_rank(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(v) for k, x in enumerate(ALPHABET + LAST) for v in (x, k))), c), F.lit(999))


def alphabet_index(entries: DataFrame, strict: bool = False) -> DataFrame:
    return entries.groupBy(bucket(F.col("headword"), strict).alias("letter")).agg(F.count("*").alias("entries")).withColumn("letter_rank", bucket_rank(F.col("letter")))


def letter_page(entries: DataFrame, letter: str, page: int, size: int) -> DataFrame:
    """One page of a letter; the page is clamped to those there are. The entries are counted, then a top-k of what pages up to
    this one hold gives the rows; only those are ranked."""
    mine = entries.where(bucket(F.col("headword")) == letter)
    pages = max(1, -(-mine.count() // size))
    at = min(max(page, 1), pages)
    upto = mine.orderBy("headword", "entry_id").limit(at * size)
    ranked = upto.withColumn("__n", F.row_number().over(Window.orderBy("headword", "entry_id")))  # at most page * size rows
    return ranked.where(F.col("__n") > (at - 1) * size).withColumn("page", F.lit(at)).drop("__n")


def prefix_lookup(entries: DataFrame, prefix: str, per_dictionary: int) -> DataFrame:
    """Entries whose headword, or a token of it, starts with the prefix; the first of each dictionary."""
    low = F.lower(F.col("headword"))
    hit = low.startswith(prefix.lower()) | F.exists(F.split(low, " "), lambda x: x.startswith(prefix.lower()))
    order = Window.partitionBy("work").orderBy("headword", "entry_id")
    return entries.where(hit).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_dictionary)


def exact_lookup(entries: DataFrame, word: str) -> DataFrame:
    return entries.where(F.exists(F.split(F.lower("headword"), " "), lambda x: x == word.lower()) | (F.lower("headword") == word.lower()))


def parse_entries(lines: DataFrame) -> DataFrame:
    """Three line shapes, by work: tab-separated cells, '°head /iast/ gloss', 'N head /iast/ gloss'; else the raw line."""
    t, raw = F.split("line", "\t"), F.col("line")
    circle, numbered = r"^°(\S+) /([^/]*)/ (.*)$", r"^([0-9]+) (\S+) /([^/]*)/ (.*)$"
    shape = F.when(F.size(t) >= 3, "tabbed").when(raw.rlike(circle), "circle").when(raw.rlike(numbered), "numbered").otherwise("raw")

    def pick(tabbed: Column, c: int, n: int) -> Column:
        return F.when(F.col("shape") == "tabbed", tabbed).when(F.col("shape") == "circle", F.regexp_extract("line", circle, c)).when(F.col("shape") == "numbered", F.regexp_extract("line", numbered, n)).otherwise("")

    gloss = F.when(F.col("shape") == "raw", raw).otherwise(pick(F.get(t, 2), 3, 4))
    return lines.withColumn("shape", shape).select("entry_id", "work", "shape", pick(F.get(t, 0), 1, 2).alias("headword"), pick(F.regexp_replace(F.get(t, 1), "/", ""), 2, 3).alias("iast"), gloss.alias("gloss"))


def paradigms(lemmas: DataFrame, rules: DataFrame) -> DataFrame:
    """lemma x rules of its class: form = stem + suffix. rules: (ending, suffix), a small table joined on the ending."""
    ending = F.substring("lemma", -1, 1)
    return lemmas.withColumn("ending", ending).join(rules, "ending").select("lemma", F.concat(F.expr("substring(lemma, 1, length(lemma) - 1)"), "suffix").alias("form"))


def reverse_index(forms: DataFrame) -> DataFrame:
    return forms.groupBy("form").agg(F.array_join(F.array_sort(F.collect_set("lemma")), ",").alias("lemmas"), F.countDistinct("lemma").alias("n_lemmas"))


def narrow(candidates: Column, surface: Column) -> Column:
    """Soft constraints on candidate lemmas by the surface's ending; one that would leave none is ignored. Plural lemmas end in и or ы."""
    plural = surface.rlike("(ам|ям|ми|в|х)$")
    singular = ~plural & surface.rlike("(ом|ем|ой|у|е|ю|о)$")
    is_plural = lambda x: x.rlike("[иы]$")
    first = F.when(plural, F.filter(candidates, is_plural)).when(singular, F.filter(candidates, lambda x: ~is_plural(x))).otherwise(candidates)
    return F.when(F.size(first) > 0, first).otherwise(candidates)


def token_join(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """Per lemma: count, distinct forms, whether any was capitalised, ambiguous hits. Tokens are folded per form before the join."""
    folded = tokens.groupBy(F.lower("token").alias("form")).agg(F.count("*").alias("n"), F.max(F.col("token").rlike(r"^\p{Lu}")).alias("capital"))
    many = forms.groupBy("form").agg(F.count("*").alias("n_lemmas"))
    hits = folded.join(forms, "form").join(many, "form")
    return hits.groupBy("lemma").agg(F.sum("n").alias("hits"), F.countDistinct("form").alias("forms"), F.max("capital").alias("any_capital"), F.sum(F.when(F.col("n_lemmas") > 1, F.col("n")).otherwise(0)).alias("ambiguous_hits"))


def name_index(votes: DataFrame) -> DataFrame:
    """(lemma, rubric, n): the rubric with most votes, ties to the first by name; the lemma itself where there is none."""
    best = votes.groupBy("lemma").agg(F.min(F.when(F.col("rubric").isNotNull(), F.struct((-F.col("n")).alias("k"), "rubric")))["rubric"].alias("top"), F.sum("n").alias("votes"))
    return best.select("lemma", F.coalesce("top", "lemma").alias("display"), "votes")


def merge_plurals(tokens: DataFrame) -> DataFrame:
    """Stems (a final s off) to one lemma: the smallest plural, else the smallest. Tokens are folded to distinct ones first."""
    tokens = tokens.select("token").distinct()
    stem = F.when(F.col("token").endswith("s"), F.expr("substring(token, 1, length(token) - 1)")).otherwise(F.col("token"))
    plural = F.min(F.when(F.col("token").endswith("s"), F.col("token")))
    return tokens.groupBy(stem.alias("stem")).agg(F.coalesce(plural, F.min("token")).alias("lemma"), F.count("*").alias("members"))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)
