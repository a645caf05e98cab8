"""Queries of the corpus-building operators, registered beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scripts as S
from ..functions import text as X
from ..operators import building as B
from ..sources import adapters as A
from .catalogue import PAGE_LINES, SEGMENTS, VERSIONS, _versions, head, query

_ENTRIES = head(PAGE_LINES, "e AS (SELECT page_id, line, line_no, sum(regexp_matches(line, '<(h1|h2|p)[ >]')::INT) OVER (PARTITION BY page_id ORDER BY line_no) AS entry FROM page_lines)")


@query(_ENTRIES + "SELECT page_id, entry::BIGINT AS entry, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS body FROM e GROUP BY ALL")
def entry_continuation(spark, d):
    return B.entries(A.page_lines(spark, d), "page_id", F.col("line").rlike("<(h1|h2|p)[ >]")).withColumn("body", F.md5("body"))


@query("SELECT lang, source, n, (coalesce(sum(n) OVER (PARTITION BY lang ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS offset FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)".replace(" AS offset", ' AS "offset"'))
def slice_offsets(spark, d):
    return B.offsets(A.table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")), "lang", "source")


@query("WITH p AS (SELECT DISTINCT 'w' || s_nationkey AS work, (s_suppkey % 9)::VARCHAR AS passage FROM supplier), c AS (SELECT c_custkey AS comment_id, 'w' || c_nationkey AS work, c_custkey % 11 || CASE c_custkey % 3 WHEN 0 THEN 'b' ELSE '' END AS passage, 'host' || c_nationkey AS host FROM customer) SELECT comment_id, coalesce(a.passage, b.passage, host) AS annotates FROM c LEFT JOIN p a ON a.work = c.work AND a.passage = c.passage LEFT JOIN p b ON b.work = c.work AND b.passage = regexp_replace(c.passage, '[a-z]$', '')")
def annotates_fallback(spark, d):
    p = A.table(spark, d, "supplier").select(F.expr("'w' || s_nationkey").alias("work"), (F.col("s_suppkey") % 9).cast("string").alias("passage"))
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("comment_id"), F.expr("'w' || c_nationkey").alias("work"), F.expr("(c_custkey % 11) || CASE c_custkey % 3 WHEN 0 THEN 'b' ELSE '' END").alias("passage"), F.expr("'host' || c_nationkey").alias("host"))
    return B.annotated(c, p)


@query("SELECT lang, doc_id, used::BIGINT AS used FROM (SELECT lang, doc_id, sum(n_chars) OVER (PARTITION BY lang ORDER BY md5('20261029:' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 20000")
def token_budget_sample(spark, d):
    return B.budget_sample(A.table(spark, d, "documents").select("lang", "doc_id", "n_chars"), "lang", "n_chars", 20000).select("lang", "doc_id", "used")


@query("SELECT source, doc_id, k::BIGINT AS k, n FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE k = 0 OR k = n // 2 OR k = n - 1")
def sample_parity(spark, d):
    return B.landmarks(A.table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id").select("source", "doc_id", F.col("k").cast("long").alias("k"), "n")


@query("WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, min(value) FILTER (k >= ceil(n * 0.95::DOUBLE)) AS value, max(n) AS n FROM s GROUP BY 1")
def latency_p95(spark, d):
    return B.nearest_rank(A.table(spark, d, "events"), "value", "event_type", 0.95)


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_state(spark, d):
    return B.latest(A.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id").select("user_id", "event_id", "event_type")


_SLP = "lower(p_name)"
for _a, _b in S.IAST_SLP1.items():
    _SLP = f"replace({_SLP}, '{_a}', '{_b}')"


@query(f"SELECT p_partkey, {_SLP} AS slp1, CASE WHEN regexp_matches(p_name, '[ऀ-ॿ]') THEN 'devanagari' WHEN regexp_matches(p_name, '[āīūṛṝḷḹṃḥṅñṭḍṇśṣ]') THEN 'iast' ELSE 'slp1' END AS encoding FROM part")
def transliterate_names(spark, d):
    return A.table(spark, d, "part").select("p_partkey", S.iast_to_slp1(F.lower("p_name")).alias("slp1"), S.encoding(F.col("p_name")).alias("encoding"))


@query("SELECT user_id, count(*) AS n, CASE WHEN count(*) % 100 BETWEEN 11 AND 14 THEN 'записей' WHEN count(*) % 10 = 1 THEN 'запись' WHEN count(*) % 10 BETWEEN 2 AND 4 THEN 'записи' ELSE 'записей' END AS noun FROM events GROUP BY 1")
def counted_nouns(spark, d):
    by = A.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return by.withColumn("noun", S.plural_ru(F.col("n"), "запись", "записи", "записей"))


@query("SELECT DISTINCT l_suppkey || '.' || l_linenumber || '.' || l_quantity::INT || '-' || (l_quantity::INT + 2) AS passage, l_suppkey || '.' || lpad(l_linenumber::VARCHAR, 3, '0') || '.' || lpad(l_quantity::INT::VARCHAR, 3, '0') || '-' || lpad((l_quantity::INT + 2)::VARCHAR, 3, '0') AS padded FROM lineitem")
def zero_pad_passages(spark, d):
    q = F.col("l_quantity").cast("int")
    ids = A.table(spark, d, "lineitem").select(F.concat_ws(".", "l_suppkey", "l_linenumber", F.concat_ws("-", q, q + 2)).alias("passage")).distinct()
    return ids.select("passage", S.zero_pad(F.col("passage")).alias("padded"))


@query(r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}]+')) AS t FROM documents) SELECT lang, count(*) AS tokens, count(*) FILTER (regexp_matches(t, '^\p{Lu}')) AS capitals, count(DISTINCT lower(t)) AS forms FROM w JOIN documents USING (doc_id) GROUP BY lang")
def counts_report(spark, d):
    w = A.table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), 0)).alias("t"))
    return w.groupBy("lang").agg(F.count("*").alias("tokens"), F.count_if(F.col("t").rlike(r"^\p{Lu}")).alias("capitals"), F.countDistinct(F.lower("t")).alias("forms"))
