"""The reference's operators as queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import align, export, lexicon, passages, quality, refs, search, stateful
from ..sources import adapters as A
from ..streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# -- shared SQL -----------------------------------------------------------------------------------------

SOURCES = "sources AS (SELECT source AS slug, dense_rank() OVER (ORDER BY source)::INT AS source_id FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))"
NORM = rf"' ' || trim(regexp_replace(translate(lower(text), {quoted(X.FOLD_FROM)}, {quoted(X.FOLD_TO)}), '[^\p{{L}}\p{{N}}\p{{Co}}]+', ' ', 'g')) || ' '"
LINES = f"lines AS (SELECT d.*, doc_id::DOUBLE AS line_num, source || ':' || doc_id AS canonical_id, {NORM} AS norm, s.source_id FROM documents d JOIN sources s ON s.slug = d.source)"
SEGMENTS = "seg AS (SELECT conv_id AS group_id, CASE role WHEN 'user' THEN 'sa' WHEN 'assistant' THEN 'ru' ELSE 'comm' END AS seg, turn AS seq, text FROM conversations)"
PIVOT = SEGMENTS + ", piv AS (SELECT group_id, max_by(coalesce(text, ''), seq) FILTER (seg = 'sa') AS sa_text, max_by(coalesce(text, ''), seq) FILTER (seg = 'ru') AS ru_text, count(*) FILTER (seg = 'comm') AS n_comm FROM seg GROUP BY group_id)"
PAGE_LINES = r"page_lines AS (SELECT page_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS line FROM (SELECT page_id, string_split(regexp_replace(html, '<(h1|h2|p|li|div)([ >])', chr(10) || '<\1\2', 'g'), chr(10)) AS l FROM pages))"
WORDS = r"words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents)"
VERSIONS = "versions AS (SELECT l_suppkey % 20 AS work, (l_orderkey % 18 + 1)::INT AS chapter, l_linenumber AS lo, (l_linenumber + l_quantity::INT % 4)::INT AS hi, l_orderkey * 10 + l_linenumber AS row_id FROM lineitem)"


def head(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def src(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return A.lines(spark, sf_dir), A.sources(spark, sf_dir)


# -- search ---------------------------------------------------------------------------------------------


@query(head(SOURCES, LINES) + "SELECT source, doc_id, source_id FROM lines WHERE contains(norm, ' the') OR (contains(norm, ' ein') AND contains(norm, ' der')) ORDER BY source_id, line_num LIMIT 5000")
def search_plain_prefix(spark, d):
    return search.search_plain(*src(spark, d), search.SearchSpec("the\nein der")).select(F.col("source_slug").alias("source"), F.col("line_num").cast("long").alias("doc_id"), "source_id")


@query(head(SOURCES, LINES) + r"SELECT doc_id, source_id FROM lines WHERE contains(norm, ' the ') AND regexp_matches(text, '(?:^|[^\p{L}\p{N}_])The(?:$|[^\p{L}\p{N}_])') ORDER BY source_id, line_num LIMIT 5000")
def search_plain_whole_word_cs(spark, d):
    return search.search_plain(*src(spark, d), search.SearchSpec("The", case_sensitive=True, whole_word=True)).select(F.col("line_num").cast("long").alias("doc_id"), "source_id")


@query(head(SOURCES, LINES) + "SELECT doc_id, source_id FROM lines WHERE contains(norm, ' of the') OR contains(norm, ' la') AND contains(norm, ' ee') ORDER BY source_id, line_num LIMIT 5000")
def search_plain_multiline(spark, d):
    return search.search_plain(*src(spark, d), search.SearchSpec("of-the\nla éé")).select(F.col("line_num").cast("long").alias("doc_id"), "source_id")


@query(head(SOURCES, LINES) + "SELECT doc_id, source_id FROM lines WHERE source_id IN (1, 3, 5) AND contains(norm, ' an') ORDER BY source_id, line_num LIMIT 5000")
def search_source_filter(spark, d):
    return search.search_plain(*src(spark, d), search.SearchSpec("an", source_ids=(1, 3, 5))).select(F.col("line_num").cast("long").alias("doc_id"), "source_id")


@query(head(SOURCES, LINES) + r"SELECT doc_id, source_id FROM lines WHERE regexp_matches(text, '(?i)tion[a-z]{3,}ing') OR regexp_matches(text, '(?i)[0-9]{16}') ORDER BY source_id, line_num LIMIT 5000")
def search_regex(spark, d):
    return search.search_regex(*src(spark, d), ["tion[a-z]{3,}ing", "[0-9]{16}"]).select(F.col("line_num").cast("long").alias("doc_id"), "source_id")


@query(r"SELECT doc_id, regexp_matches(text, '(?i)tion[a-z]{3,}ing') AS matched, false AS timed_out FROM documents WHERE regexp_matches(text, '(?i)tion[a-z]{3,}ing')")
def search_regex_bounded(spark, d):
    return search.search_regex_bounded(A.lines(spark, d), ["tion[a-z]{3,}ing"], per_match_ms=2000).select(F.col("line_num").cast("long").alias("doc_id"), "matched", "timed_out")


@query(head(SOURCES, LINES) + "SELECT doc_id, CASE WHEN contains(norm, ' ander') THEN 'ander' WHEN contains(norm, ' the') THEN 'the' ELSE 'une' END AS variant FROM lines WHERE contains(norm, ' ander') OR contains(norm, ' the') OR contains(norm, ' une') ORDER BY source_id, line_num LIMIT 5000")
def search_variants_dedup(spark, d):
    return search.search_variants(*src(spark, d), ["the", "une", "ander"]).select(F.col("line_num").cast("long").alias("doc_id"), "variant")


@query("SELECT a.doc_id AS anchor_id, b.doc_id, CASE WHEN b.doc_id < a.doc_id THEN 'before' WHEN b.doc_id > a.doc_id THEN 'after' ELSE 'current' END AS side FROM documents a JOIN benchmark k ON k.item_id = a.doc_id JOIN documents b ON b.source = a.source AND b.doc_id BETWEEN a.doc_id - 45 AND a.doc_id + 45")
def search_context_window(spark, d):
    lines = A.lines(spark, d)
    anchors = lines.join(A.table(spark, d, "benchmark").select(F.col("item_id").cast("double").alias("line_num")), "line_num").select(F.col("source_slug").alias("anchor_source"), F.col("line_num").alias("anchor_num"))
    return search.context(lines, anchors, 45).select(F.col("anchor_num").cast("long").alias("anchor_id"), F.col("line_num").cast("long").alias("doc_id"), "side")


def _kwic_sql(terms: list[str], width: int = 40) -> str:
    out = "CASE WHEN length(text) > 80 THEN text[1:80] || '…' ELSE text END"
    for t in reversed(terms):
        at, n = f"instr(lower(text), '{t}')", len(t)
        out = f"CASE WHEN {at} > 0 THEN CASE WHEN {at} - {width} > 1 THEN '…' ELSE '' END || text[greatest(1, {at} - {width}):{at} + {n + width - 1}] || CASE WHEN {at} + {n + width} <= length(text) THEN '…' ELSE '' END ELSE {out} END"
    return out


@query(f"SELECT doc_id, CASE WHEN length(text) = 0 THEN '' ELSE {_kwic_sql(['password', 'tion'])} END AS snippet FROM documents")
def search_kwic(spark, d):
    return A.table(spark, d, "documents").select("doc_id", X.kwic(F.col("text"), ["password", "tion"]).alias("snippet"))


_OVERVIEW = head(SOURCES, LINES, "hits AS (SELECT source, source_id, count(*) AS hits FROM lines WHERE contains(norm, ' an') GROUP BY ALL)", "r AS (SELECT *, row_number() OVER (ORDER BY hits DESC, source_id) AS rank FROM hits)")


@query(_OVERVIEW + "SELECT CASE WHEN rank <= 15 THEN source ELSE '(rest)' END AS source_name, sum(hits)::BIGINT AS hits, min(rank)::INT AS rank, sum(hits) * 100.0 / (SELECT sum(hits) FROM r)::DOUBLE AS share FROM r GROUP BY 1")
def search_source_overview(spark, d):
    hits = search.search_plain(*src(spark, d), search.SearchSpec("an", limit=None))
    return search.overview(hits)


@query(head(SOURCES, LINES) + "SELECT s.source_id, (sum(coalesce(f, 0)) OVER w)::BIGINT AS found_so_far, row_number() OVER w * 100.0 / (SELECT count(*) FROM sources)::DOUBLE AS percent FROM sources s LEFT JOIN (SELECT source_id, count(*) AS f FROM lines WHERE contains(norm, ' the') GROUP BY 1) h USING (source_id) WINDOW w AS (ORDER BY source_id)")
def search_progress(spark, d):
    lines, sources = src(spark, d)
    return search.progress(search.search_plain(lines, sources, search.SearchSpec("the", limit=None)), sources)


@query(head(SOURCES, LINES) + "SELECT doc_id, source_id FROM lines WHERE source NOT IN ('src0', 'src7') AND contains(norm, ' ed') ORDER BY source_id, line_num LIMIT 20")
def search_primary_only(spark, d):
    lines, sources = src(spark, d)
    return search.search_plain(search.primary_only(lines, ["src0", "src7"]), sources, search.SearchSpec("ed", limit=20)).select(F.col("line_num").cast("long").alias("doc_id"), "source_id")


# -- passages -------------------------------------------------------------------------------------------


@query(head(PIVOT) + "SELECT group_id, CASE WHEN trim(coalesce(sa_text, '')) <> '' AND trim(coalesce(ru_text, '')) <> '' THEN 'pair' WHEN trim(coalesce(ru_text, '')) <> '' AND sa_text IS NULL THEN 'mono_ru' WHEN trim(coalesce(sa_text, '')) <> '' AND ru_text IS NULL THEN 'mono_sa' ELSE 'none' END AS kind, coalesce(trim(sa_text) = '', false) OR coalesce(trim(ru_text) = '', false) AS empty_side, n_comm FROM piv")
def segment_pivot_classify(spark, d):
    return passages.classify(A.segments(spark, d)).select("group_id", "kind", "empty_side", "n_comm")


for _side in ("sa", "ru"):

    def _units(spark, d, side=_side):
        return passages.units(A.segments(spark, d), side).select("group_id", "text", X.natural_key(F.col("group_id").cast("string")).alias("natural"))

    _units.__name__ = f"segment_units_{_side}"
    query(head(PIVOT) + f"SELECT group_id, {_side}_text AS text, lpad(group_id::VARCHAR, 10, '0') AS natural FROM piv WHERE trim({_side}_text) <> '' AND {_side}_text <> '{{no rus data}}'")(_units)


@query(head(SEGMENTS) + "SELECT group_id, coalesce(max_by(text, seq) FILTER (seg = 'sa'), min_by(text, seq) FILTER (seg = 'ru')) AS text, min(seq) AS first_seq, count(*) AS n_segments FROM seg GROUP BY group_id")
def segment_merge_passage(spark, d):
    return passages.merge(A.segments(spark, d))


@query(head(SEGMENTS) + "SELECT group_id, count(*) FILTER (seg = 'sa') AS n_sa, count(*) FILTER (seg = 'ru') AS n_ru FROM seg GROUP BY group_id HAVING n_sa <> 1 OR n_ru <> 1")
def segment_parity_audit(spark, d):
    return passages.parity(A.segments(spark, d))


@query("SELECT source AS source_slug, lang AS chapter, min(doc_id)::DOUBLE AS first_line, count(*) AS n_lines FROM documents GROUP BY 1, 2")
def chapter_toc(spark, d):
    return passages.chapter_toc(A.lines(spark, d))


@query(head(PAGE_LINES) + "SELECT page_id, line_no::INT AS line_no, last_value(nullif(regexp_extract(line, '<h1[^>]*>([^<]*)', 1), '') IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS chapter FROM page_lines")
def chapter_carry_forward(spark, d):
    return passages.carry_heading(A.page_lines(spark, d)).select("page_id", "line_no", "chapter")


@query(head(PAGE_LINES, "c AS (SELECT *, sum(regexp_matches(line, '<h[12][ >]')::INT) OVER (PARTITION BY page_id ORDER BY line_no) AS chapter_no FROM page_lines)") + "SELECT page_id, line_no::INT AS line_no, 'c' || chapter_no || '.p' || row_number() OVER (PARTITION BY page_id, chapter_no ORDER BY line_no) AS passage FROM c WHERE regexp_matches(line, '<p[ >]')")
def paragraph_ids(spark, d):
    return passages.paragraph_ids(A.page_lines(spark, d)).select("page_id", "line_no", "passage")


_MINT = "SELECT l_orderkey, l_linenumber, work || ':' || passage || CASE WHEN dup = 0 THEN '' WHEN dup <= 25 THEN chr((dup + 97)::INT) END AS minted FROM (SELECT *, row_number() OVER (PARTITION BY work, passage ORDER BY l_orderkey, l_linenumber) - 1 AS dup FROM (SELECT l_orderkey, l_linenumber, 'w' || l_suppkey AS work, l_linenumber || '.' || l_quantity::INT AS passage FROM lineitem))"


@query(_MINT)
def mint_duplicate_suffix(spark, d):
    li = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("w"), F.col("l_suppkey")).alias("work"), F.concat_ws(".", F.col("l_linenumber"), F.col("l_quantity").cast("int")).alias("passage"))
    n = passages.nth_duplicate(li, ["work", "passage"], ["l_orderkey", "l_linenumber"])
    return n.select("l_orderkey", "l_linenumber", F.concat("work", F.lit(":"), "passage", X.letter_suffix(F.col("dup"))).alias("minted"))


@query("SELECT DISTINCT l_suppkey || '.' || l_linenumber AS passage, lpad(l_suppkey::VARCHAR, 10, '0') || '.' || lpad(l_linenumber::VARCHAR, 10, '0') AS natural FROM lineitem")
def natural_sort_ids(spark, d):
    ids = A.table(spark, d, "lineitem").select(F.concat_ws(".", "l_suppkey", "l_linenumber").alias("passage")).distinct()
    return ids.select("passage", X.natural_key(F.col("passage")).alias("natural"))


@query(head(SEGMENTS) + "SELECT group_id, seq, CASE WHEN lead(seg) OVER w = 'ru' THEN lead(text) OVER w END AS translation FROM seg WINDOW w AS (PARTITION BY group_id ORDER BY seq)")
def adjacent_translation(spark, d):
    return passages.adjacent(A.segments(spark, d)).select("group_id", "seq", "translation")


# -- joins ----------------------------------------------------------------------------------------------


def _versions(spark, d):
    return A.table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("work"), (F.col("l_orderkey") % 18 + 1).cast("int").alias("chapter"), F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 4).cast("int").alias("hi"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))


@query(head(VERSIONS, "wanted AS (SELECT DISTINCT chapter, lo AS verse FROM versions)") + "SELECT work, chapter, verse, lo, hi, row_id FROM (SELECT v.*, verse, row_number() OVER (PARTITION BY work, chapter, verse ORDER BY (lo <> hi)::INT, lo, hi, row_id) AS n FROM wanted w JOIN versions v USING (chapter) WHERE verse BETWEEN lo AND hi) WHERE n = 1")
def compare_range_join(spark, d):
    v = _versions(spark, d)
    return align.compare_range(v.select("chapter", F.col("lo").alias("verse")).distinct(), v).select("work", "chapter", "verse", "lo", "hi", "row_id")


@query(head(VERSIONS) + "SELECT DISTINCT work, chapter, unnest(range(lo, hi + 1))::INT AS verse FROM versions")
def enumerate_ranges(spark, d):
    return align.expand_ranges(_versions(spark, d)).select("work", "chapter", "verse").distinct()


@query("SELECT g.l_orderkey, g.l_linenumber AS token, t.l_linenumber AS passage FROM lineitem t JOIN lineitem g ON g.l_orderkey = t.l_orderkey AND g.l_linenumber BETWEEN t.l_linenumber AND t.l_linenumber + t.l_quantity::INT % 4 WHERE t.l_returnflag = 'R'")
def gold_token_range_join(spark, d):
    li = A.table(spark, d, "lineitem")
    p = li.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("passage"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 4).alias("hi"))
    g = li.select("l_orderkey", F.col("l_linenumber").alias("token"))
    return p.join(g, "l_orderkey").where("token between passage and hi").select("l_orderkey", "token", "passage")


@query("SELECT e.event_id, o.value AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) o ON e.user_id = o.user_id AND e.ts >= o.ts WHERE e.event_type = 'view'")
def asof_header_lookup(spark, d):
    e = A.table(spark, d, "events")
    marks = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    return align.as_of(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), marks, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@query()
def phrase_automaton(spark, d):
    phrases = ["Licensed under the Apache License", "of the", "the", "password", "token", "pour le", "der ein", "que le"]
    return align.phrase_matches(A.table(spark, d, "documents"), phrases)


# -- references and manifests ---------------------------------------------------------------------------

_REFS = "refs AS (SELECT o_orderkey AS ref_id, CASE WHEN o_orderkey % 3 = 0 THEN 'src' || (o_custkey % 20) END AS slug, CASE WHEN o_orderkey % 3 = 0 THEN 'src' || (o_custkey % 20) || ':' || o_custkey END AS canonical_id, 'src' || (o_custkey % 20) AS source_slug, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey::DOUBLE END AS line_num, CASE o_orderkey % 4 WHEN 0 THEN 'v2' WHEN 1 THEN 'v1' WHEN 2 THEN 'v0' END AS corpus_version FROM orders)"


def _refs(spark, d):
    slug = F.concat(F.lit("src"), F.col("o_custkey") % 20)
    third = F.col("o_orderkey") % 3 == 0
    version = F.when(F.col("o_orderkey") % 4 == 0, "v2").when(F.col("o_orderkey") % 4 == 1, "v1").when(F.col("o_orderkey") % 4 == 2, "v0")
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("ref_id"), F.when(third, slug).alias("slug"), F.when(third, F.concat(slug, F.lit(":"), "o_custkey")).alias("canonical_id"), slug.alias("source_slug"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("double")).alias("line_num"), version.alias("corpus_version"))


@query(head(_REFS, "corpus AS (SELECT source AS source_slug, doc_id::DOUBLE AS line_num, source || ':' || doc_id AS canonical_id FROM documents)", "pinned AS (SELECT source_slug, line_num, 'v1' AS corpus_version, source_slug || ':' || (line_num::BIGINT + 20) AS pinned_id FROM corpus WHERE line_num::BIGINT % 7 = 0)", "h AS (SELECT source_slug, canonical_id, count(*) AS n FROM corpus GROUP BY ALL)", "j AS (SELECT r.*, h.n AS ch, p.pinned_id, CASE WHEN p.pinned_id IS NOT NULL THEN coalesce(g.n, 0) END AS ph, o.canonical_id AS oid FROM refs r LEFT JOIN h ON h.source_slug = r.slug AND h.canonical_id = r.canonical_id LEFT JOIN pinned p ON p.source_slug = r.source_slug AND p.line_num = r.line_num AND p.corpus_version = r.corpus_version LEFT JOIN h g ON g.source_slug = p.source_slug AND g.canonical_id = p.pinned_id LEFT JOIN corpus o ON o.source_slug = r.source_slug AND o.line_num = r.line_num)", "s AS (SELECT *, CASE WHEN ch = 1 THEN 'canonical' WHEN ch > 1 THEN 'ambiguous' WHEN line_num IS NULL THEN 'orphan' WHEN ph = 1 THEN 'legacy_mapped' WHEN ph > 1 THEN 'ambiguous' WHEN ph = 0 THEN 'orphan' WHEN coalesce(corpus_version, 'v2') = 'v2' AND oid IS NOT NULL THEN 'legacy_direct' ELSE 'orphan' END AS status FROM j)") + "SELECT ref_id, status, CASE status WHEN 'canonical' THEN canonical_id WHEN 'legacy_mapped' THEN pinned_id WHEN 'legacy_direct' THEN oid END AS resolved_id FROM s")
def ref_resolution(spark, d):
    corpus = A.lines(spark, d).select("source_slug", "line_num", "canonical_id")
    pinned = corpus.where(F.col("line_num").cast("long") % 7 == 0).select("source_slug", "line_num", F.lit("v1").alias("corpus_version"), F.concat("source_slug", F.lit(":"), (F.col("line_num").cast("long") + 20).cast("string")).alias("pinned_id"))
    return refs.resolve(_refs(spark, d), corpus, pinned, "v2")


_BEFORE = "b AS (SELECT source AS source_slug, doc_id::DOUBLE AS line_num, source || ':' || doc_id AS canonical_id, sha256(text) AS fp FROM documents), a AS (SELECT source_slug, line_num, CASE WHEN line_num::BIGINT % 11 = 0 THEN canonical_id || 'x' ELSE canonical_id END AS canonical_id, CASE WHEN line_num::BIGINT % 13 = 0 THEN sha256(fp) ELSE fp END AS fp FROM b WHERE line_num::BIGINT % 17 <> 0), r AS (SELECT o_orderkey AS ref_id, 'src' || (o_custkey % 20) AS source_slug, o_custkey::DOUBLE AS line_num FROM orders)"


@query(head(_BEFORE) + "SELECT ref_id, CASE WHEN b.canonical_id IS NULL THEN 'unresolved_before' WHEN i.canonical_id IS NULL AND a.canonical_id IS NULL THEN 'orphaned' WHEN i.canonical_id IS NULL THEN 'identity_changed' WHEN i.fp <> b.fp THEN 'content_changed' ELSE 'stable' END AS verdict FROM r LEFT JOIN b USING (source_slug, line_num) LEFT JOIN a ON a.source_slug = r.source_slug AND a.line_num = r.line_num LEFT JOIN a i ON i.canonical_id = b.canonical_id")
def zero_orphan_verdicts(spark, d):
    before = A.lines(spark, d).select("source_slug", "line_num", "canonical_id", F.sha2("line_text", 256).alias("fingerprint"))
    n = F.col("line_num").cast("long")
    after = before.where(n % 17 != 0).select("source_slug", "line_num", F.when(n % 11 == 0, F.concat("canonical_id", F.lit("x"))).otherwise(F.col("canonical_id")).alias("canonical_id"), F.when(n % 13 == 0, F.sha2("fingerprint", 256)).otherwise(F.col("fingerprint")).alias("fingerprint"))
    r = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("ref_id"), F.concat(F.lit("src"), F.col("o_custkey") % 20).alias("source_slug"), F.col("o_custkey").cast("double").alias("line_num"))
    return refs.verdicts(r, before, after)


_PLAIN = r"trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"


@query(f"SELECT page_id, CASE WHEN length({_PLAIN}) > 0 THEN sha256({_PLAIN}) ELSE '' END AS fingerprint FROM pages")
def content_fingerprint(spark, d):
    return A.table(spark, d, "pages").select("page_id", X.fingerprint(F.col("html")).alias("fingerprint"))


_MANIFEST = "SELECT source AS source_slug, count(*) AS record_count, source || ':' || min(doc_id) AS first_id, source || ':' || max(doc_id) AS last_id, sum(length(text))::BIGINT AS chars FROM documents"


@query(_MANIFEST + " GROUP BY source")
def manifest_totals(spark, d):
    return refs.manifest(A.lines(spark, d))


@query(f"WITH a AS ({_MANIFEST} WHERE source <> 'src3' GROUP BY source), b AS ({_MANIFEST} WHERE source <> 'src5' AND doc_id % 97 <> 0 GROUP BY source) SELECT coalesce(a.source_slug, b.source_slug) AS source_slug, CASE WHEN a.source_slug IS NULL THEN 'added' WHEN b.source_slug IS NULL THEN 'removed' WHEN a = b THEN 'same' ELSE 'changed' END AS status, CASE WHEN a.source_slug IS NULL OR b.source_slug IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.record_count <> b.record_count THEN 'record_count' END, CASE WHEN a.first_id <> b.first_id THEN 'first_id' END, CASE WHEN a.last_id <> b.last_id THEN 'last_id' END, CASE WHEN a.chars <> b.chars THEN 'chars' END) END AS changed_fields FROM a FULL JOIN b ON a.source_slug = b.source_slug")
def manifest_diff(spark, d):
    lines = A.lines(spark, d)
    return refs.diff(refs.manifest(lines.where("source_slug <> 'src3'")), refs.manifest(lines.where("source_slug <> 'src5' and cast(line_num as long) % 97 <> 0")))


@query("SELECT count(*) FILTER (doc_id IS NULL) AS missing_ids, (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY source, doc_id HAVING count(*) > 1)) AS duplicate_ids, 0::BIGINT AS empty_sources FROM documents")
def ingest_validation(spark, d):
    return refs.validate_ingest(*src(spark, d))


# -- quality --------------------------------------------------------------------------------------------


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', ' ', 'g'), '(?is)<small[^>]*>.*?</small>', '', 'g'), '<[^>]*>', '', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages")
def html_strip_tags(spark, d):
    return A.table(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query(r"""SELECT page_id, unnest(range(0, len(l)))::INT AS pos, unnest(l) AS link FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)""")
def html_link_ids(spark, d):
    return A.table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("pos", "link"))


@query("SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '<{t}[ >]'))::BIGINT AS n_{t}" for t in quality.TAGS) + " FROM pages")
def html_tag_census(spark, d):
    return quality.tag_census(A.table(spark, d, "pages"))


@query(r"SELECT lang, regexp_matches(text, '\p{Latin}') AS has_latin, regexp_matches(text, '\p{Cyrillic}') AS has_cyrillic, regexp_matches(text, '\p{Devanagari}') AS has_devanagari, count(*) AS docs FROM documents GROUP BY ALL")
def script_census(spark, d):
    flags = quality.script_flags(F.col("text"))
    return A.table(spark, d, "documents").select("lang", *flags).groupBy("lang", "has_latin", "has_cyrillic", "has_devanagari").agg(F.count("*").alias("docs"))


@query(r"SELECT doc_id, len(l)::BIGINT AS n_runs, len(list_filter(l, lambda x: regexp_matches(x, '\p{Latin}') AND regexp_matches(x, '\p{Cyrillic}')))::BIGINT AS n_mixed FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS l FROM documents)")
def mixed_script_tokens(spark, d):
    return quality.mixed_tokens(A.table(spark, d, "documents"))


@query("WITH p AS (SELECT item_id AS doc_id, text[1:12] AS read, 'FIXED ' || item_id AS instead FROM benchmark), j AS (SELECT doc_id, d.text, read, instead, (length(d.text) - length(replace(d.text, read, ''))) // length(read) AS c FROM documents d JOIN p USING (doc_id)) SELECT doc_id, CASE WHEN c = 1 THEN 'applied' WHEN c = 0 AND contains(text, instead) THEN 'already' WHEN c = 0 THEN 'missing' ELSE 'ambiguous' END AS status, CASE WHEN c = 1 THEN replace(text, read, instead) ELSE text END AS fixed FROM j")
def errata_apply(spark, d):
    p = A.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.substring("text", 1, 12).alias("read"), F.concat(F.lit("FIXED "), F.col("item_id").cast("string")).alias("instead"))
    return quality.apply_errata(A.table(spark, d, "documents").select("doc_id", "text"), p).select("doc_id", "status", "fixed")


@query(r"WITH x AS (SELECT l.doc_id, l.quality AS lq, CASE WHEN d.n_chars > 100 THEN (NOT regexp_matches(text, '[#*$%&|<>]{3}'))::INT END AS rq, l.toxic AS lt, CASE WHEN d.lang = 'en' THEN 0 END AS rt FROM labels l JOIN documents d USING (doc_id)) SELECT count(lq = rq) AS quality_n, sum((lq = rq)::INT) / nullif(count(lq = rq), 0)::DOUBLE AS quality_rate, count(lt = rt) AS toxic_n, sum((lt = rt)::INT) / nullif(count(lt = rt), 0)::DOUBLE AS toxic_rate FROM x")
def agreement_rates(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 100, (~F.col("text").rlike("[#*$%&|<>]{3}")).cast("int")).alias("right_quality"), F.when(F.col("lang") == "en", F.lit(0)).alias("right_toxic"))
    pairs = A.table(spark, d, "labels").select("doc_id", F.col("quality").alias("left_quality"), F.col("toxic").alias("left_toxic")).join(docs, "doc_id")
    return quality.agreement(pairs, ["quality", "toxic"])


_JAC = head(r"a AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents)", r"b AS (SELECT item_id AS doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS v FROM benchmark)", "j AS (SELECT doc_id, len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v)))::DOUBLE AS jaccard FROM a JOIN b USING (doc_id))")


@query(_JAC + "SELECT doc_id, jaccard FROM j")
def lemma_set_jaccard(spark, d):
    return _jaccard(spark, d)


def _jaccard(spark, d):
    a = A.table(spark, d, "documents").select("doc_id", F.array_distinct(X.words(F.col("text"))).alias("w"))
    b = A.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.array_distinct(X.words(F.col("text"))).alias("v"))
    return a.join(b, "doc_id").select("doc_id", quality.jaccard(F.col("w"), F.col("v")).alias("jaccard"))


@query("WITH s AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT min(v) FILTER (i = n // 10) AS p10, min(v) FILTER (i = n // 2) AS median, min(v) FILTER (i = n * 9 // 10) AS p90, min(n) AS n FROM s")
def index_percentiles(spark, d):
    return quality.index_percentiles(A.table(spark, d, "documents"), "n_chars", {"p10": (1, 10), "median": (1, 2), "p90": (9, 10)})


@query("WITH s AS (SELECT lang, sum(quality)::DOUBLE AS k, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT lang, k, n, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) AS low, (k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) AS high FROM s")
def wilson_interval(spark, d):
    by = A.table(spark, d, "labels").join(A.table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("quality").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = quality.wilson(F.col("k"), F.col("n"))
    return by.select("lang", "k", "n", low.alias("low"), high.alias("high"))


@query("SELECT lang, doc_id, n::INT AS n FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('759:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 25")
def stratified_sample(spark, d):
    return quality.quota_sample(A.table(spark, d, "documents").select("lang", "doc_id"), "lang", 25)


# -- lexicon and dictionaries ---------------------------------------------------------------------------

_RULES = [("e", "e"), ("e", "es"), ("e", "ing"), ("n", "n"), ("n", "ns"), ("d", "d"), ("d", "ds"), ("t", "t"), ("t", "ts"), ("r", "r"), ("r", "rs"), ("l", "l"), ("l", "ls"), ("y", "y"), ("y", "ies")]
_RULES_SQL = "rules(ending, suffix) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _RULES) + ")"
_LEMMAS = r"lemmas AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS lemma FROM part)"
_FORMS = "forms AS (SELECT lemma, lemma[1:length(lemma) - 1] || suffix AS form FROM lemmas JOIN rules ON ending = right(lemma, 1))"


def _forms(spark, d):
    lemmas = A.table(spark, d, "part").select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), 0)).alias("lemma")).distinct()
    return lexicon.paradigms(lemmas, spark.createDataFrame(_RULES, "ending string, suffix string"))


@query(head(_RULES_SQL, _LEMMAS, _FORMS) + "SELECT lemma, form FROM forms")
def paradigm_expand(spark, d):
    return _forms(spark, d)


@query(head(_RULES_SQL, _LEMMAS, _FORMS) + "SELECT form, string_agg(DISTINCT lemma, ',' ORDER BY lemma) AS lemmas, count(DISTINCT lemma) AS n_lemmas FROM forms GROUP BY form")
def reverse_index(spark, d):
    return lexicon.reverse_index(_forms(spark, d))


_VOCAB = [("the", "th"), ("the", "the"), ("der", "d"), ("die", "d"), ("das", "d"), ("le", "l"), ("la", "l"), ("un", "u"), ("une", "u"), ("an", "a"), ("and", "a")]


@query(head("forms(form, lemma) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _VOCAB) + ")", r"t AS (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS token FROM documents)", r"f AS (SELECT lower(token) AS form, count(*) AS n, max(regexp_matches(token, '^\p{Lu}')) AS capital FROM t GROUP BY 1)", "m AS (SELECT form, count(*) AS c FROM forms GROUP BY 1)") + "SELECT lemma, sum(n)::BIGINT AS hits, count(DISTINCT form) AS forms, max(capital) AS any_capital, sum(CASE WHEN c > 1 THEN n ELSE 0 END)::BIGINT AS ambiguous_hits FROM f JOIN forms USING (form) JOIN m USING (form) GROUP BY lemma")
def lexicon_token_join(spark, d):
    tokens = A.table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0)).alias("token"))
    return lexicon.token_join(tokens, spark.createDataFrame(_VOCAB, "form string, lemma string"))


@query("WITH v AS (SELECT p_brand AS lemma, CASE WHEN p_size > 10 THEN p_type END AS rubric, count(*) AS n FROM part GROUP BY ALL) SELECT lemma, coalesce((SELECT rubric FROM v w WHERE w.lemma = v.lemma AND rubric IS NOT NULL ORDER BY n DESC, rubric LIMIT 1), lemma) AS display, sum(n)::BIGINT AS votes FROM v GROUP BY lemma")
def name_index(spark, d):
    votes = A.table(spark, d, "part").groupBy(F.col("p_brand").alias("lemma"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("rubric")).agg(F.count("*").alias("n"))
    return lexicon.name_index(votes)


@query(head(WORDS) + "SELECT regexp_replace(w, 's$', '') AS stem, coalesce(min(w) FILTER (w LIKE '%s'), min(w)) AS lemma, count(DISTINCT w) AS members FROM words GROUP BY 1")
def plural_singular_merge(spark, d):
    return lexicon.merge_plurals(A.table(spark, d, "documents").select(F.explode(X.words(F.col("text"))).alias("token")))


_ENTRY_LINE = "CASE p_partkey % 4 WHEN 0 THEN p_name || chr(9) || '/' || p_brand || '/' || chr(9) || p_type WHEN 1 THEN '°' || p_brand || ' /' || p_name || '/ ' || p_type WHEN 2 THEN p_size || ' ' || p_brand || ' /' || p_name || '/ ' || p_type ELSE p_name END"
_ENTRY = f"e AS (SELECT p_partkey AS entry_id, 'dict' || p_partkey % 4 AS work, {_ENTRY_LINE} AS line FROM part), s AS (SELECT *, CASE WHEN len(string_split(line, chr(9))) >= 3 THEN 'tabbed' WHEN regexp_matches(line, '^°(\\S+) /([^/]*)/ (.*)$') THEN 'circle' WHEN regexp_matches(line, '^([0-9]+) (\\S+) /([^/]*)/ (.*)$') THEN 'numbered' ELSE 'raw' END AS shape FROM e)"


def _entry_lines(spark, d):
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("entry_id"), F.expr("'dict' || (p_partkey % 4)").alias("work"), F.expr(_ENTRY_LINE).alias("line"))


@query(head(_ENTRY) + r"SELECT entry_id, work, shape, CASE shape WHEN 'tabbed' THEN split_part(line, chr(9), 1) WHEN 'circle' THEN regexp_extract(line, '^°(\S+) ', 1) WHEN 'numbered' THEN regexp_extract(line, '^[0-9]+ (\S+) ', 1) ELSE '' END AS headword, CASE shape WHEN 'tabbed' THEN replace(split_part(line, chr(9), 2), '/', '') WHEN 'raw' THEN '' ELSE regexp_extract(line, '/([^/]*)/', 1) END AS iast, CASE shape WHEN 'tabbed' THEN split_part(line, chr(9), 3) WHEN 'raw' THEN line ELSE regexp_extract(line, '/[^/]*/ (.*)$', 1) END AS gloss FROM s")
def dict_parse(spark, d):
    return lexicon.parse_entries(_entry_lines(spark, d))


def _entries(spark, d):
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("entry_id"), F.expr("'dict' || (p_partkey % 4)").alias("work"), F.lower("p_name").alias("headword"))


_BUCKET = "CASE " + " ".join(f"WHEN starts_with(headword, '{x}') THEN '{x}'" for x in lexicon.LAST + lexicon.ALPHABET) + " ELSE '#' END"
_ENTRIES = "e AS (SELECT p_partkey AS entry_id, 'dict' || p_partkey % 4 AS work, lower(p_name) AS headword FROM part)"
_RANK = "CASE letter " + " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(lexicon.ALPHABET + lexicon.LAST)) + " ELSE 999 END"


@query(head(_ENTRIES) + f"SELECT letter, count(*) AS entries, ({_RANK})::INT AS letter_rank FROM (SELECT {_BUCKET} AS letter FROM e) GROUP BY letter")
def dict_buckets(spark, d):
    return lexicon.alphabet_index(_entries(spark, d))


@query(head(_ENTRIES) + "SELECT entry_id, work, headword, n::INT AS n FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY headword, entry_id) AS n FROM e WHERE starts_with(headword, 'b') OR contains(headword, ' b')) WHERE n <= 30")
def dict_prefix_lookup(spark, d):
    return lexicon.prefix_lookup(_entries(spark, d), "b", 30)


@query(head(_ENTRIES, f"m AS (SELECT *, row_number() OVER (ORDER BY headword, entry_id) AS n, ceil(count(*) OVER () / 25)::INT AS pages FROM e WHERE {_BUCKET} = 's')") + "SELECT entry_id, work, headword, least(greatest(2, 1), pages) AS page FROM m WHERE n > (least(2, pages) - 1) * 25 AND n <= least(2, pages) * 25")
def dict_letter_page(spark, d):
    return lexicon.letter_page(_entries(spark, d), "s", 2, 25)


_PART_NORM = NORM.replace("lower(text)", "lower(p_type)")


@query(f"SELECT p_partkey, p_type FROM part WHERE contains({_PART_NORM}, ' economy ')")
def gloss_reverse_search(spark, d):
    return A.table(spark, d, "part").where(search.token_predicate(X.norm(F.col("p_type")), "ECONOMY", True, True)).select("p_partkey", "p_type")


# -- stateful -------------------------------------------------------------------------------------------


@query("WITH e AS (SELECT *, floor(epoch(ts))::BIGINT AS now FROM events), w AS (SELECT *, now - now % 86400 AS window_start FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY ts, event_id) AS n FROM w) SELECT event_id, user_id, window_start, n, n <= 2 AS allowed, greatest(0, 2 - n) AS remaining, greatest(1, window_start + 86400 - now) AS retry_after FROM n")
def rate_limit_decisions(spark, d):
    return stateful.rate_limit(A.table(spark, d, "events"), "user_id", 86400, 2)


@query("SELECT floor(epoch(ts))::BIGINT - floor(epoch(ts))::BIGINT % 3600 AS window_start, user_id, count(*) AS n FROM events GROUP BY ALL")
def rate_limit_windows(spark, d):
    return windows.windowed_counts(A.table(spark, d, "events"), "user_id")


@query("SELECT floor(epoch(ts))::BIGINT - floor(epoch(ts))::BIGINT % 3600 AS window_start, user_id, count(*) AS n FROM events GROUP BY ALL")
def rate_limit_windows_stream(spark, d):
    schema = A.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a pattern, as a stream takes no single file; it also meets a folder of files
    name = "rate_limit_windows_stream"
    return windows.run_to_files(windows.windowed_counts(stream, "user_id"), windows.new_folder(spark, name), ["window_start", "user_id"])


@query("SELECT event_id, coalesce(floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 86400, false) AS hit FROM events")
def ttl_cache_hits(spark, d):
    return stateful.ttl_hits(A.table(spark, d, "events"), ["user_id", "event_type"], 86400).select("event_id", "hit")


@query("SELECT event_type AS task, count(*) AS entries, count(DISTINCT user_id) AS keys FROM events GROUP BY 1")
def cache_stats(spark, d):
    return A.table(spark, d, "events").groupBy(F.col("event_type").alias("task")).agg(F.count("*").alias("entries"), F.countDistinct("user_id").alias("keys"))


@query("SELECT user_id, min_by(event_type, (ts, event_id)) AS first_value, max_by(value, (ts, event_id)) FILTER (value IS NOT NULL) AS latest_value FROM events GROUP BY user_id")
def first_touch_attribution(spark, d):
    return stateful.first_touch(A.table(spark, d, "events"), "user_id", "event_type", "value")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) ORDER BY md5('2026-01-01:' || doc_id), doc_id LIMIT 1")
def pick_unseen(spark, d):
    return stateful.pick_unseen(A.table(spark, d, "documents").select("doc_id"), A.table(spark, d, "events").select(F.col("user_id").alias("doc_id")), "doc_id", "2026-01-01").select("doc_id")


_MODEL = "CASE doc_id % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'large' WHEN 2 THEN 'other' ELSE 'small' END"


@query(f"WITH c AS (SELECT doc_id, {_MODEL} AS model, n_chars, (CASE WHEN doc_id % 9 = 0 THEN 0 ELSE 500 END) AS max_output, ceil(n_chars / 4.0)::BIGINT AS tokens FROM documents), p AS (SELECT *, (tokens + max_output) * CASE model WHEN 'small' THEN 0.5::DOUBLE WHEN 'large' THEN 4.0::DOUBLE END / 1000.0::DOUBLE AS cost FROM c) SELECT doc_id, tokens, cost, CASE WHEN max_output <= 0 THEN 'invalid_output_bound' WHEN cost IS NULL THEN 'unknown_model' WHEN cost > 3.0 THEN 'cost_ceiling_exceeded' ELSE 'allowed' END AS verdict FROM p")
def spend_policy_ladder(spark, d):
    calls = A.table(spark, d, "documents").select("doc_id", F.expr(_MODEL).alias("model"), F.col("n_chars").alias("chars"), F.when(F.col("doc_id") % 9 == 0, 0).otherwise(500).alias("max_output"))
    return stateful.spend_ladder(calls, {"small": 0.5, "large": 4.0}, 3.0)


# -- catalogue, exports ---------------------------------------------------------------------------------


@query("SELECT lang, source, grouping(lang, source)::INT AS level, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def catalog_report(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.groupingSets([[docs.lang], [docs.source], []], docs.lang, docs.source).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("docs"), F.sum("n_chars").alias("chars")).select("lang", "source", "level", "docs", "chars")


@query("SELECT doc_id, n_words, source FROM (SELECT doc_id, source, len(string_split(text, ' '))::INT AS n_words FROM documents) ORDER BY n_words DESC, doc_id LIMIT 25")
def catalog_top(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.size(F.split("text", " ")).alias("n_words"), "source").orderBy(F.desc("n_words"), "doc_id").limit(25)


_CELL = r"trim(regexp_replace(coalesce({}, ''), '[\t\r\n]+', ' ', 'g'))"


@query(head(PIVOT) + f"SELECT group_id, group_id || chr(9) || {_CELL.format('sa_text')} || chr(9) || {_CELL.format('ru_text')} AS row FROM piv WHERE trim(sa_text) <> '' AND trim(ru_text) <> ''")
def export_tsv_rows(spark, d):
    return export.tsv_rows(passages.classify(A.segments(spark, d)).where("kind = 'pair'"))


_XML = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(head(PIVOT) + f"""SELECT group_id, '<tu tuid="' || group_id || '"><tuv xml:lang="sa"><seg>' || {_XML.format('sa_text')} || '</seg></tuv><tuv xml:lang="ru"><seg>' || {_XML.format('ru_text')} || '</seg></tuv></tu>' AS unit FROM piv WHERE trim(sa_text) <> '' AND trim(ru_text) <> ''""")
def export_tmx(spark, d):
    return export.tmx_units(passages.classify(A.segments(spark, d)).where("kind = 'pair'"))


@query("SELECT source AS source_slug, CASE WHEN source IN ('src2', 'src4') THEN 'dict' ELSE 'base' END AS pack, count(*) AS records, sum(length(text))::BIGINT AS chars, CASE WHEN source IN ('src2', 'src4') THEN 'dictionary' ELSE 'anthology' END AS role FROM documents GROUP BY source")
def offline_pack_split(spark, d):
    lines, dicts = A.lines(spark, d), ["src2", "src4"]
    by = lines.groupBy("source_slug").agg(F.count("*").alias("records"), F.sum(F.length("line_text")).alias("chars"))
    return by.join(export.source_role(lines, dicts), "source_slug").select("source_slug", F.when(F.col("source_slug").isin(dicts), "dict").otherwise("base").alias("pack"), "records", "chars", "role")


@query("WITH s AS (SELECT source AS slug, count(DISTINCT lang) > 1 AS parallel FROM documents GROUP BY 1) SELECT slug, unnest(CASE WHEN parallel THEN ['https://example.org/sources/' || slug, 'https://example.org/sources/' || slug || '?lang=sa', 'https://example.org/sources/' || slug || '?lang=ru'] ELSE ['https://example.org/sources/' || slug] END) AS url FROM s")
def sitemap_urls(spark, d):
    s = A.table(spark, d, "documents").groupBy(F.col("source").alias("slug")).agg((F.countDistinct("lang") > 1).alias("parallel"))
    return export.sitemap(s)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
