"""The core query: plain, regular-expression and variant search over corpus lines, context, snippets and overviews.

Filters come before limits, so a post-filter never makes a result short. Ties end in canonical_id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Bounds of the regular-expression contract.
MAX_PATTERNS, MAX_PATTERN_LENGTH, MAX_LIMIT, MAX_SCANNED, MAX_VARIANTS = 10, 512, 5000, 1_000_000, 100


@dataclass(frozen=True)
class SearchSpec:
    """query: lines are alternatives, tokens of a line must all occur. source_ids: None is all sources, () is none."""

    query: str
    case_sensitive: bool = False
    whole_word: bool = False
    fold_diacritics: bool = True
    source_ids: tuple[int, ...] | None = None
    limit: int | None = MAX_LIMIT

    def lines(self) -> list[list[str]]:
        return [x.split() for x in self.query.split("\n") if x.strip()]


def every(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def either(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def token_predicate(norm: Column, token: str, whole: bool, fold: bool) -> Column:
    """A token may hold separators: then it is a phrase, whose last piece is a prefix unless whole."""
    piece = X.norm_literal(token, fold)
    return norm.contains(f" {piece}{' ' if whole else ''}") if piece else F.lit(False)


def post_predicate(text: Column, token: str, spec: SearchSpec) -> Column:
    """Whole words by letters, digits and underscore on either side; case-sensitive alone: a substring."""
    if not spec.whole_word:
        return text.contains(token)
    flag = "" if spec.case_sensitive else "(?iu)"
    quoted = regex.escape(token, literal_spaces=True)
    return text.rlike(rf"{flag}(?:^|[^\p{{L}}\p{{N}}_]){quoted}(?:$|[^\p{{L}}\p{{N}}_])")


def with_norm(lines: DataFrame, fold_diacritics: bool = True) -> DataFrame:
    """lines with the normalised text stored in `norm`, as a corpus is written once and searched often; searches use it if it is there."""
    return lines.withColumn("norm" if fold_diacritics else "norm_exact", X.norm(F.col("line_text"), fold_diacritics))


def norm_of(lines: DataFrame, fold: bool) -> tuple[Column, bool]:
    """The stored normalised text of lines, else its expression, and whether it is stored."""
    name = "norm" if fold else "norm_exact"
    return (F.col(name), True) if name in lines.columns else (X.norm(F.col("line_text"), fold), False)


def tested(norm: tuple[Column, bool], test) -> Column:
    """test of the normalised text. One that is not stored is bound as the only element of an array, so that it is made once
    a row, however many tokens ask for it; as a column, every use would make it again."""
    c, stored = norm
    return test(c) if stored else F.exists(F.array(c), test)


def plain_predicate(lines: DataFrame, spec: SearchSpec) -> Column:
    found = tested(norm_of(lines, spec.fold_diacritics), lambda n: either([every([token_predicate(n, t, spec.whole_word, spec.fold_diacritics) for t in line]) for line in spec.lines()]))
    if spec.case_sensitive or spec.whole_word:
        found &= either([every([post_predicate(F.col("line_text"), t, spec) for t in line]) for line in spec.lines()])
    return found


def within_sources(lines: DataFrame, sources: DataFrame, ids: tuple[int, ...] | None) -> DataFrame:
    """Lines joined to the dimension of sources, whose size the planner checks before it broadcasts."""
    kept = sources if ids is None else sources.where(F.col("source_id").isin(list(ids)))
    return lines.join(kept, lines["source_slug"] == kept["slug"]).drop("slug")


def in_order(df: DataFrame, limit: int | None) -> DataFrame:
    ordered = df.orderBy("sort_order", "line_num", "canonical_id")
    return ordered if limit is None else ordered.limit(min(limit, MAX_LIMIT))


def search_plain(lines: DataFrame, sources: DataFrame, spec: SearchSpec) -> DataFrame:
    if not spec.lines() or spec.source_ids == ():
        return within_sources(lines, sources, ()).limit(0)
    return in_order(within_sources(lines.where(plain_predicate(lines, spec)), sources, spec.source_ids), spec.limit)


def checked(patterns: list[str]) -> list[str]:
    """The pattern contract, checked on the driver before any task starts."""
    if not patterns or len(patterns) > MAX_PATTERNS:
        raise ValueError("pattern_count")
    for p in patterns:
        if len(p) > MAX_PATTERN_LENGTH:
            raise ValueError("pattern_too_long")
        try:
            regex.compile(p)
        except regex.error as e:
            raise ValueError("pattern_invalid") from e
    return patterns


def regex_predicate(text: Column, patterns: list[str], case_sensitive: bool = False) -> Column:
    return either([text.rlike(p if case_sensitive else f"(?iu){p}") for p in checked(patterns)])


def search_regex(lines: DataFrame, sources: DataFrame, patterns: list[str], case_sensitive: bool = False, limit: int | None = MAX_LIMIT) -> DataFrame:
    return in_order(within_sources(lines.where(regex_predicate(F.col("line_text"), patterns, case_sensitive)), sources, None), limit)


def search_regex_bounded(lines: DataFrame, patterns: list[str], per_match_ms: int = 50) -> DataFrame:
    """Regex search with a time limit for each match, for patterns that may run away: a match out of time is no match, and says so."""
    checked(patterns)
    names = lines.columns
    at = names.index("line_text")

    def kernel(batches):
        import pyarrow as pa

        every = [regex.compile(p, regex.IGNORECASE) for p in patterns]
        for b in batches:
            hit, late = [], []
            for t in b.column(at):
                found = slow = False
                for p in every:
                    try:
                        found = found or bool(p.search(t.as_py() or "", timeout=per_match_ms / 1000))
                    except TimeoutError:
                        slow = True
                hit.append(found)
                late.append(slow)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit, pa.bool_()), pa.array(late, pa.bool_())], names=[*names, "matched", "timed_out"])

    from pyspark.sql import types as T

    return lines.mapInArrow(kernel, T.StructType([*lines.schema.fields, T.StructField("matched", T.BooleanType()), T.StructField("timed_out", T.BooleanType())])).where("matched or timed_out")


def ordered_prefix(lines: DataFrame, sources: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """The first `rows` lines in the order of sources and lines, joined to their sources; and (total, whole) in one row.

    Counts per source give the sources that are whole within the prefix and how much of the next one is; only that one is
    sorted, for a top-k. No rank over all lines is made."""
    counts = within_sources(lines.select("source_slug"), sources, None).groupBy("source_id", "sort_order").agg(F.count("*").alias("n"))
    run = counts.withColumn("upto", F.sum("n").over(Window.orderBy("sort_order", "source_id")))  # one row a source
    whole = run.where(F.col("upto") <= rows).select("source_id")
    partly = run.where((F.col("upto") > rows) & (F.col("upto") - F.col("n") < rows)).select("source_id", (F.lit(rows) - F.col("upto") + F.col("n")).alias("left")).collect()  # at most one row
    every_ = within_sources(lines, sources, None)
    first = every_.join(whole, "source_id", "left_semi")
    for r in partly:
        first = first.unionByName(every_.where(F.col("source_id") == r["source_id"]).orderBy("line_num", "canonical_id").limit(r["left"]))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return first, total


def search_regex_scan(lines: DataFrame, sources: DataFrame, patterns: list[str], case_sensitive: bool = False, source_ids: tuple[int, ...] | None = None, limit: int = MAX_LIMIT, max_rows: int = MAX_SCANNED) -> tuple[DataFrame, DataFrame]:
    """The bounded scan: lines in order until `limit` of them match or `max_rows` are read; and its statistics in one row:
    scanned_rows, budget_exceeded, truncated. The row that breaks the budget counts as scanned, as it does for a client.

    The rows are those that a scan in order finds, but they are tested side by side."""
    kept = sources if source_ids is None else sources.where(F.col("source_id").isin(list(source_ids)))
    first, total = ordered_prefix(lines, kept, max_rows)
    hits = in_order(first.where(regex_predicate(F.col("line_text"), patterns, case_sensitive)), limit)
    last = hits.agg(F.count("*").alias("found"), F.max(F.struct("sort_order", "line_num", "canonical_id")).alias("last"))
    full = last.where(F.col("found") >= limit).select("last")
    before = first.select(F.struct("sort_order", "line_num", "canonical_id").alias("at")).join(F.broadcast(full), F.col("at") <= F.col("last")).agg(F.count("*").alias("upto"))  # one row at most
    over = F.col("total") > max_rows
    stopped = F.col("upto") > 0
    scanned = F.when(stopped, F.col("upto")).when(over, F.lit(max_rows + 1)).otherwise(F.col("total"))
    exceeded = over & ~stopped
    stats = total.crossJoin(before).select(scanned.cast("long").alias("scanned_rows"), exceeded.alias("budget_exceeded"), exceeded.alias("truncated"))  # one row each
    return hits, stats


def scan_stats(bounded: DataFrame) -> DataFrame:
    """One row over the result of search_regex_bounded: lines that matched, matches that ran out of time, and whether the result is complete."""
    return bounded.agg(F.count_if("matched").alias("matched_rows"), F.count_if("timed_out").alias("match_timeouts"), (F.count_if("timed_out") > 0).alias("truncated"))


def search_variants(lines: DataFrame, sources: DataFrame, variants: list[str], limit: int | None = MAX_LIMIT) -> DataFrame:
    """Union of plain searches over variants in sorted order; a line is reported once, under its first variant."""
    names = sorted(set(variants))
    if not names:
        return within_sources(lines, sources, ()).withColumn("variant", F.lit("")).limit(0)

    def first(n: Column) -> Column:
        return F.coalesce(*(F.when(every([token_predicate(n, t, False, True) for t in v.split()]), F.lit(v)) for v in names))

    c, stored = norm_of(lines, True)
    variant = first(c) if stored else F.get(F.transform(F.array(c), first), 0)
    found = lines.withColumn("variant", variant).where("variant is not null")
    return in_order(within_sources(found, sources, None), limit)


def expand(word: str, stems: DataFrame) -> list[str]:
    """A word's variants: its stems of a lookup table (word, stem), or itself if there are none, in every script. The table holds few stems a word."""
    from ..functions import scripts as S

    found = [r["stem"] for r in stems.where(F.col("word") == word).select("stem").distinct().orderBy("stem").limit(MAX_VARIANTS).collect()] or [word]
    return sorted({v for s in found for v in (s, S.slp1_text(s), S.iast_text(s))})


def dispatch(lines: DataFrame, sources: DataFrame, query: str, mode: str = "plain", case_sensitive: bool = False, whole_word: bool = False, source_ids: tuple[int, ...] | None = None, limit: int = MAX_LIMIT, stems: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """A search in one of three modes, plain, regex or morph: its hits, and for regex the scan's statistics."""
    if mode == "regex":
        patterns = [p.strip() for p in query.split("\n") if p.strip()]
        if not patterns or source_ids == ():
            return within_sources(lines, sources, ()).limit(0), None
        return search_regex_scan(lines, sources, patterns, case_sensitive, source_ids, limit)
    if mode == "morph":
        kept = sources if source_ids is None else sources.where(F.col("source_id").isin(list(source_ids)))
        words = query.split()
        return search_variants(lines, kept, [v for w in words for v in (expand(w, stems) if stems is not None else [w])], limit), None
    if mode != "plain":
        raise ValueError(f"unknown mode {mode}")
    return search_plain(lines, sources, SearchSpec(query, case_sensitive, whole_word, source_ids=source_ids, limit=limit)), None


def source_ids_of(text: str | None) -> tuple[int, ...] | None:
    """Numbers with commas between; None stands for all sources, an empty text for none."""
    return None if text is None else tuple(int(x) for x in text.split(",") if x.strip())


def context(lines: DataFrame, anchors: DataFrame, window: float) -> DataFrame:
    """Lines of the anchor's source whose number is within the window by value; anchors: (anchor_source, anchor_num).

    Numbers are cut into stretches of the window's width: an anchor meets the lines of its own and the two beside it only."""
    width = max(float(window), 1.0)
    stretch = F.floor(F.col("line_num") / width)
    own = F.floor(F.col("anchor_num") / width)
    asked = anchors.withColumn("__stretch", F.explode(F.sequence(own - 1, own + 1)))
    met = lines.withColumn("anchor_source", F.col("source_slug")).withColumn("__stretch", stretch).join(asked, ["anchor_source", "__stretch"])
    near = met.where(F.col("line_num").between(F.col("anchor_num") - window, F.col("anchor_num") + window)).drop("__stretch")
    side = F.when(F.col("line_num") < F.col("anchor_num"), "before").when(F.col("line_num") > F.col("anchor_num"), "after").otherwise("current")
    return near.withColumn("side", side)


def overview(hits: DataFrame, top: int = 15) -> DataFrame:
    """Hits by source: the first `top` by count (ties by first appearance) and one row for the rest, with shares of all hits."""
    by = hits.groupBy("source_slug", "sort_order").agg(F.count("*").alias("hits"))
    ranked = by.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), "sort_order")))
    name = F.when(F.col("rank") <= top, F.col("source_slug")).otherwise("(rest)")
    grouped = ranked.groupBy(name.alias("source_name")).agg(F.sum("hits").alias("hits"), F.min("rank").alias("rank"))
    total = F.sum("hits").over(Window.partitionBy(F.lit(1)))
    return grouped.select("source_name", "hits", "rank", (F.col("hits") * 100.0 / total).alias("share"))


def progress(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source in order: found so far and percent of sources done. Windows run over the dimension only."""
    counts = hits.groupBy("source_id").agg(F.count("*").alias("found"))
    by = sources.join(counts, "source_id", "left").select("source_id", "sort_order", F.coalesce("found", F.lit(0)).alias("found"))
    run, whole = Window.orderBy("sort_order"), Window.partitionBy(F.lit(1))
    return by.select("source_id", F.sum("found").over(run).alias("found_so_far"), (F.row_number().over(run) * 100.0 / F.count("*").over(whole)).alias("percent"))


def primary_only(lines: DataFrame, reference_slugs: list[str]) -> DataFrame:
    return lines.where(~F.col("source_slug").isin(reference_slugs))


def overview_text(hits: DataFrame, query: str = "", top: int = 15, elapsed_ms: float | None = None) -> str:
    """The overview as lines of text: totals, the first sources with their shares, and one line for the rest. At most top + 1 rows are fetched."""
    by = hits.groupBy("source_slug", "sort_order").agg(F.count("*").alias("hits"))
    whole = by.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.count("*").alias("sources")).first()
    if not whole["sources"]:
        return ""
    shown = by.orderBy(F.desc("hits"), "sort_order").limit(top).collect()
    head = [*([f"Запрос: «{query}»"] if query else []), f"{whole['hits']} записей", f"{whole['sources']} источников", *([elapsed_ru(elapsed_ms)] if elapsed_ms is not None and elapsed_ms >= 0 else [])]
    out = [" · ".join(head), *(f"{k}. {r['source_slug']} — {r['hits']} ({100 * r['hits'] / whole['hits']:.1f}%)" for k, r in enumerate(shown, 1))]
    if whole["sources"] > len(shown):
        out.append(f"… ещё {whole['sources'] - len(shown)} источников · {whole['hits'] - sum(r['hits'] for r in shown)} записей")
    return "\n".join(out)


def elapsed_ru(ms: float) -> str:
    """A duration: tenths of a second under ten, then seconds, then minutes and seconds."""
    s = ms / 1000
    if s >= 60:
        return f"{int(s // 60)} мин {int(s % 60)} с"
    return (f"{s:.1f}".replace(".", ",") if s < 10 else str(int(s))) + " с"


def export_rows(hits: DataFrame, query: str, width: int = 40) -> DataFrame:
    """Hits as a client gets them: source, anchor and the snippet around the first term, never the whole line."""
    parts = X.kwic_parts(F.col("line_text"), query.split(), width)
    return hits.withColumn("k", parts).select("source_id", "source_slug", "line_num", "chapter", "canonical_id", F.concat("k.before", "k.match", "k.after").alias("snippet"), F.col("k.before").alias("before"), F.col("k.match").alias("match"), F.col("k.after").alias("after"))


def export_filename(query: str, extension: str) -> str:
    """A file name of a query: letters, digits, hyphens and underscores."""
    return (regex.sub(r"[^\p{L}\p{N}_-]+", "_", query).strip("_")[:50] or "search") + "." + extension


def by_source(hits: DataFrame) -> DataFrame:
    """Hits with the place of their source among the sources hit, in the order of the hits, and their own place in it."""
    first = hits.groupBy("source_id").agg(F.min("sort_order").alias("so")).withColumn("source_place", F.row_number().over(Window.orderBy("so", "source_id"))).drop("so")  # one row a source
    return hits.join(first, "source_id").withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("line_num", "canonical_id")))


def found_sources(hits: DataFrame, epic: list[str]) -> DataFrame:
    """One row: the numbers of the sources that have hits, in order, and whether all of them are epics."""
    by = hits.select("source_id", "source_slug").distinct()  # a row a source
    return by.agg(F.array_join(F.transform(F.array_sort(F.collect_set("source_id")), lambda x: x.cast("string")), ",").alias("source_ids"), F.coalesce(F.bool_and(F.col("source_slug").isin(*epic)), F.lit(False)).alias("epic_only"))
