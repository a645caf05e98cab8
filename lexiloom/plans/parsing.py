"""Queries of the line-oriented parsers, over lines in the sources' shapes that are made from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parsing as P
from ..sources import adapters as A
from .catalogue import head, query

_AT = ("concat('w', p_size % 5) AS work", "CAST(p_partkey AS INT) AS line_no")


def _lines(spark, d, line: str):
    return A.table(spark, d, "part").selectExpr(*_AT, f"{line} AS line")


def _sql(line: str, name: str = "l") -> str:
    return f"{name} AS (SELECT {', '.join(_AT)}, {line} AS line, p_partkey, p_name, p_type, p_brand, p_size FROM part)"


_WORD = r"[a-zA-Z]+(?:-[a-zA-Z]+)*"


@query(rf"WITH w AS (SELECT item_id, unnest(range(0, len(t))) AS k, unnest(t) AS surface, unnest(g[1:len(t)]) AS gap FROM (SELECT item_id, regexp_extract_all(text, '{_WORD}') AS t, regexp_split_to_array(text, '{_WORD}') AS g FROM benchmark)) SELECT item_id, k::INT AS k, surface, (sum(length(gap) + length(surface)) OVER (PARTITION BY item_id ORDER BY k) - length(surface))::BIGINT AS start, k = 0 OR regexp_matches(rtrim(replace(gap, chr(10), ' ')), '[.!?…»\"]$') AS sentence_initial FROM w")
def words_in_place(spark, d):
    """Latin words of the benchmark stand for Cyrillic ones."""
    return P.words_in_place(A.table(spark, d, "benchmark"), "item_id", word=_WORD)


_VERSE = "CASE p_partkey % 6 WHEN 0 THEN concat('% ', p_brand) WHEN 3 THEN concat(p_name, ' / ', p_type, ' // sokss_', p_size, ',', p_partkey % 7, '.', p_partkey, ' // ') WHEN 4 THEN '  ' ELSE concat(p_brand, ' x /') END"


@query(head(_sql(_VERSE), "b AS (SELECT *, coalesce(sum((p_partkey % 6 = 3)::INT) OVER (PARTITION BY work ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS verse FROM l WHERE p_partkey % 6 NOT IN (0, 4))") + "SELECT work, max(p_size) FILTER (p_partkey % 6 = 3)::INT AS lambaka, max(p_partkey % 7) FILTER (p_partkey % 6 = 3)::INT AS taranga, max(p_partkey) FILTER (p_partkey % 6 = 3)::INT AS sloka, string_agg(CASE WHEN p_partkey % 6 = 3 THEN p_name || ' / ' || p_type ELSE p_brand || ' x /' END, ' ' ORDER BY line_no) AS iast FROM b GROUP BY work, verse HAVING bool_or(p_partkey % 6 = 3)")
def marked_verses(spark, d):
    return P.marked_verses(_lines(spark, d, _VERSE)).drop("slp1")


_PROSE = "CASE p_partkey % 7 WHEN 0 THEN concat('## ', p_size, '.', p_partkey % 9, CASE WHEN p_size % 2 = 0 THEN '.' ELSE '' END, ' ВОЛНА') WHEN 1 THEN 'КНИГА первая' WHEN 2 THEN concat('# ', p_name) WHEN 3 THEN '' ELSE concat(' ', p_name, ' ') END"


@query(head(_sql(_PROSE), "c AS (SELECT *, coalesce(last_value(CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 9 END IGNORE NULLS) OVER (PARTITION BY work ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) AS taranga FROM l)", "k AS (SELECT work, arg_min(p_size, line_no) AS lambaka FROM l WHERE p_partkey % 7 = 0 GROUP BY 1)") + "SELECT work, coalesce(lambaka, 0)::INT AS lambaka, taranga::INT AS taranga, row_number() OVER (PARTITION BY work ORDER BY line_no)::INT AS idx, p_name AS text FROM c LEFT JOIN k USING (work) WHERE p_partkey % 7 >= 4")
def numbered_prose(spark, d):
    return P.numbered_prose(_lines(spark, d, _PROSE))


#: Under a heading every tenth line; blank lines, page marks with blank lines about them, and text.
_ARTICLE = "CASE (p_partkey div 5) % 10 WHEN 0 THEN concat('<H1>Махабхарата ', p_size, '. ', p_brand, CASE WHEN p_partkey % 2 = 0 THEN '. УКАЗАТЕЛЬ ИМЕН*' ELSE '' END, '</H1>') WHEN 2 THEN '' WHEN 4 THEN ' ' WHEN 5 THEN '-12-' WHEN 6 THEN '' WHEN 8 THEN '-13-' ELSE p_name END"
_KIND = "(p_partkey // 5) % 10"


def _ordered(line: str) -> str:
    """Works by the last digit, so that each has a line of every kind in turn."""
    return f"l AS (SELECT 'w' || p_partkey % 5 AS work, p_partkey::INT AS line_no, {_KIND} AS kind, p_name, p_brand, p_size, p_partkey FROM part)"


@query(head(_ordered(_ARTICLE), "a AS (SELECT *, (sum((kind = 0)::INT) OVER (PARTITION BY work ORDER BY line_no))::BIGINT AS article FROM l)", "h AS (SELECT work, article, p_size::VARCHAR AS volume, p_brand || CASE WHEN p_partkey % 2 = 0 THEN '. УКАЗАТЕЛЬ ИМЕН*' ELSE '' END AS title FROM a WHERE kind = 0)") + "SELECT work, article, CASE WHEN kind < 3 THEN 1 ELSE 2 END::BIGINT AS paragraph, volume, title, string_agg(p_name, ' ' ORDER BY line_no) AS text FROM a JOIN h USING (work, article) WHERE kind IN (1, 3, 7, 9) GROUP BY ALL")
def articles(spark, d):
    lines = A.table(spark, d, "part").selectExpr("concat('w', p_partkey % 5) AS work", "CAST(p_partkey AS INT) AS line_no", f"{_ARTICLE} AS line")
    return P.articles(lines)


@query(head(_ordered(_ARTICLE), "a AS (SELECT *, (sum((kind = 0 AND p_partkey % 2 = 0)::INT) OVER (PARTITION BY work ORDER BY line_no))::BIGINT AS section FROM l)", "h AS (SELECT work, section, p_size::VARCHAR AS volume, p_brand || '. УКАЗАТЕЛЬ ИМЕН' AS title FROM a WHERE kind = 0 AND p_partkey % 2 = 0)") + "SELECT work, section, volume, title, 'imen' AS kind, CASE WHEN kind = 0 THEN 'Махабхарата ' || p_size || '. ' || p_brand ELSE p_name END AS entry FROM a JOIN h USING (work, section) WHERE kind IN (1, 3, 7, 9) OR kind = 0 AND p_partkey % 2 = 1")
def index_entries(spark, d):
    lines = A.table(spark, d, "part").selectExpr("concat('w', p_partkey % 5) AS work", "CAST(p_partkey AS INT) AS line_no", f"{_ARTICLE} AS line")
    return P.index_entries(lines)


_GLOSS = "CASE p_partkey % 4 WHEN 0 THEN concat('Слово', CASE WHEN p_size % 2 = 0 THEN ' (śabda)' ELSE '' END, ' – ', p_name) WHEN 1 THEN '' ELSE concat('  ', p_type) END"


@query(head(_sql(_GLOSS), "b AS (SELECT *, (sum((p_partkey % 4 = 0)::INT) OVER (PARTITION BY work ORDER BY line_no))::BIGINT AS entry FROM l WHERE p_partkey % 4 <> 1)") + "SELECT work, entry, 'Слово' AS headword, CASE WHEN bool_or(p_partkey % 4 = 0 AND p_size % 2 = 0) THEN 'śabda' ELSE '' END AS iast, 'Слово' || CASE WHEN bool_or(p_partkey % 4 = 0 AND p_size % 2 = 0) THEN ' (śabda)' ELSE '' END || ' – ' || string_agg(CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE p_type END, ' ' ORDER BY line_no) AS text FROM b WHERE entry > 0 GROUP BY work, entry")
def glossary_entries(spark, d):
    return P.glossary(_lines(spark, d, _GLOSS))


_BIB = "CASE p_partkey % 5 WHEN 0 THEN concat(p_brand, ' 2008 – ', p_name) WHEN 1 THEN concat('  ', p_type) WHEN 2 THEN '' WHEN 3 THEN concat('Subhead ', p_size) ELSE p_name END"


@query("WITH l AS (SELECT 'w' || p_size % 5 AS work, p_partkey AS line_no, p_partkey % 5 AS k, p_name, p_type, p_brand, p_size FROM part), x AS (SELECT *, lag(k) OVER (PARTITION BY work ORDER BY line_no) AS before FROM l), b AS (SELECT *, (k = 0 OR coalesce(before, 2) = 2) AS new FROM x WHERE k <> 2), e AS (SELECT *, (sum(new::INT) OVER (PARTITION BY work ORDER BY line_no))::BIGINT AS entry FROM b) SELECT work, entry, coalesce(max(CASE WHEN k = 0 THEN p_brand || ' 2008' END), '') AS label, string_agg(CASE k WHEN 0 THEN p_brand || ' 2008 – ' || p_name WHEN 1 THEN p_type WHEN 3 THEN 'Subhead ' || p_size ELSE p_name END, ' ' ORDER BY line_no) AS text FROM e GROUP BY work, entry")
def bibliography_entries(spark, d):
    return P.bibliography(_lines(spark, d, _BIB))


_NAMED = "CASE p_partkey % 5 WHEN 0 THEN concat('Имя', p_size, '\t(', lower(p_brand), 'ā — gloss) x') WHEN 1 THEN concat('Имя', p_size, ' (синоним) y') WHEN 2 THEN concat('Имя', p_size, ' слово') WHEN 3 THEN '<!-- note -->' ELSE concat('Имя', p_size, ' («', lower(p_brand), 'a») z') END"
_TABLE = "SELECT 'Имя' || (s_suppkey % 40) AS cyrillic, 's' || s_suppkey AS slp1, 'brand#' || (s_suppkey % 25) || 'a' AS witness FROM supplier"
_NAMES = "n AS (SELECT 'w' || p_size % 5 AS work, p_partkey::INT AS line_no, 'Имя' || p_size AS headword, CASE p_partkey % 5 WHEN 0 THEN lower(p_brand) || 'ā' WHEN 4 THEN lower(p_brand) || 'a' ELSE '' END AS iast, lower(p_brand) || 'a' AS plain FROM part WHERE p_partkey % 5 <> 3)"


def _joined(spark, d):
    table = A.table(spark, d, "supplier").selectExpr("concat('Имя', s_suppkey % 40) AS cyrillic", "concat('s', s_suppkey) AS slp1", "concat('brand#', s_suppkey % 25, 'a') AS witness")
    return P.join_names(P.names_of(_lines(spark, d, _NAMED)), table)


@query(head(_NAMES, f"t AS ({_TABLE})") + "SELECT work, line_no, headword, iast, slp1, witness, CASE WHEN iast = '' THEN 'NO_SPAN' WHEN plain = witness THEN 'MATCH' ELSE 'MISMATCH' END AS agreement FROM n JOIN t ON headword = cyrillic")
def glossary_name_join(spark, d):
    return _joined(spark, d)[0]


@query(head(_NAMES, f"t AS ({_TABLE})") + "SELECT work, count(DISTINCT line_no) AS entries, count(DISTINCT CASE WHEN cyrillic IS NOT NULL THEN line_no END) AS joined_entries, count(cyrillic) AS joined_rows FROM n LEFT JOIN t ON headword = cyrillic GROUP BY work")
def glossary_name_counts(spark, d):
    return _joined(spark, d)[1]


_ORDINALS = [("первая", 1), ("Второй", 2), ("третьей", 3), ("четвёртая", 4), ("двадцатая", 20), ("девяностой", 90), ("двадцать  первая", 21), ("сорок восьмой", 48), ("сорок десятая", None), ("сто первая", None), ("девятнадцатая", 19), ("", None)]


@query("SELECT p_partkey, CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN {'NULL' if n is None else n}" for k, (_, n) in enumerate(_ORDINALS)) + " END::INT AS number FROM part")
def ordinals(spark, d):
    c = "CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN '{w}'" for k, (w, _) in enumerate(_ORDINALS)) + " END AS w"
    return A.table(spark, d, "part").selectExpr("p_partkey", c).select("p_partkey", P.ordinal(F.col("w")).alias("number"))


_MIXED = "CASE p_partkey % 6 WHEN 0 THEN translate(p_name, 'aeo', 'аео') WHEN 1 THEN concat('ognь ', p_name) WHEN 2 THEN 'слoво дом' WHEN 3 THEN 'धर्мma' WHEN 4 THEN 'щq' ELSE p_name END"


@query(head(f"t AS (SELECT unnest(regexp_extract_all({_MIXED}, '[\\p{{L}}\\p{{M}}]+')) AS t FROM part)", "c AS (SELECT t, regexp_matches(t, '\\p{Latin}') AS la, regexp_matches(t, '\\p{Cyrillic}') AS cy FROM t)") + "SELECT defect, count(*) AS tokens FROM (SELECT CASE WHEN contains(t, 'ध') THEN 'flagged_devanagari' WHEN NOT (la AND cy) OR t = 'ognь' THEN NULL WHEN t = 'слoво' THEN 'mixed_lat_in_cyr' WHEN t = 'щq' THEN 'flagged_unmappable' ELSE 'mixed_cyr_in_lat' END AS defect FROM c) WHERE defect IS NOT NULL GROUP BY 1")
def spelling_defects(spark, d):
    return P.defect_census(A.table(spark, d, "part").selectExpr(f"{_MIXED} AS text"))


_OPTION = "concat(p_brand, ': ', p_name, ' - ', p_type, '; none; ', p_type, ' - other - x')"


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type || ' ' || p_name), w1) THEN r1 WHEN contains(lower(p_type || ' ' || p_name), w2) THEN 'other - x' END AS rubric FROM part JOIN (SELECT lower(p_brand) AS lemma, arg_max(p_name, p_partkey) AS w1, arg_max(p_type, p_partkey) AS r1, lower(arg_max(p_type, p_partkey)) AS w2 FROM part GROUP BY 1) ON lemma = lower(p_brand)")
def rubric_options(spark, d):
    known = P.options(_lines(spark, d, _OPTION))
    rows = A.table(spark, d, "part").selectExpr("p_partkey", "lower(p_brand) AS lemma", "concat(p_type, ' ', p_name) AS sentence")
    return rows.join(known, "lemma").select("p_partkey", P.resolve_option(F.col("variants"), F.col("sentence")).alias("rubric"))


@query("SELECT lower(p_brand) AS lemma, arg_max(p_name || ': ' || p_size, p_partkey) AS rubric FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1")
def rubric_phrases(spark, d):
    return P.phrases(_lines(spark, d, "CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE concat(p_brand, ': ', p_name, ': ', p_size) END"))


_RULES = ["_", "nom _", "gen а", "dat у, ю", "", "а", "nom а", "gen ы, и", "", "я", "nom я"]
_RULE_ROWS = [("_", "nom", ""), ("_", "gen", "а"), ("_", "dat", "у"), ("_", "dat", "ю"), ("а", "nom", "а"), ("а", "gen", "ы"), ("а", "gen", "и"), ("я", "nom", "я")]
_LEMMA = "concat(lower(p_brand), CASE p_partkey % 5 WHEN 0 THEN 'а' WHEN 1 THEN 'я' WHEN 2 THEN 'и' WHEN 3 THEN 'ю' ELSE 'т' END)"


@query("WITH r(c, cs, suffix) AS (VALUES " + ", ".join(str(x) for x in _RULE_ROWS) + f"), l AS (SELECT DISTINCT {_LEMMA} AS lemma FROM part), k AS (SELECT lemma, CASE right(lemma, 1) WHEN 'а' THEN 'а' WHEN 'я' THEN 'я' WHEN 'т' THEN '_' END AS c FROM l) SELECT lemma, cs AS case_name, CASE c WHEN '_' THEN lemma ELSE lemma[1:length(lemma) - 1] END || suffix AS form FROM k JOIN r USING (c)")
def declined_lemmas(spark, d):
    rules = P.declension_rules(spark.createDataFrame([("r", k, x) for k, x in enumerate(_RULES)], "work string, line_no int, line string"))
    return P.declined(A.table(spark, d, "part").selectExpr(f"{_LEMMA} AS lemma").distinct(), rules).withColumnRenamed("case", "case_name")


@query("SELECT lemma, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (SELECT lower(p_name) AS lemma, 'names' AS tag FROM part WHERE p_size > 10 UNION ALL SELECT lower(p_name), 'terms' FROM part WHERE p_size < 40) GROUP BY 1")
def lemma_pool(spark, d):
    part = A.table(spark, d, "part")
    pool = P.lemma_pool({"names": part.where("p_size > 10").selectExpr("p_name AS lemma"), "terms": part.where("p_size < 40").selectExpr("p_name AS lemma")})
    return pool.withColumn("tags", F.array_join("tags", ","))


@query("SELECT NULL::VARCHAR AS input_hash, count(DISTINCT l_returnflag) AS hashes FROM lineitem")
def agreed_input(spark, d):
    return P.agreed_input(A.table(spark, d, "lineitem").selectExpr("l_suppkey AS slug", "l_returnflag AS input_hash"))


@query("SELECT DISTINCT user_id::VARCHAR AS token_hash, coalesce(expires >= 1705000000 AND NOT used, false) AS valid FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN (SELECT user_id, max(floor(epoch(ts)))::BIGINT + 86400 AS expires, arg_max(event_id, (floor(epoch(ts)), event_id)) % 2 = 0 AS used FROM events WHERE event_type <> 'view' AND user_id % 3 <> 0 GROUP BY 1) USING (user_id)")
def resolved_tokens(spark, d):
    e = A.table(spark, d, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    last = e.where("event_type <> 'view' and user_id % 3 <> 0").groupBy("user_id").agg(F.max(F.struct("at", "event_id")).alias("x"))
    issued = last.selectExpr("CAST(user_id AS STRING) AS token_hash", "x.at AS issued_at", "x.at + 86400 AS expires_at", "CASE WHEN x.event_id % 2 = 0 THEN x.at END AS used_at")
    return P.resolve_tokens(e.selectExpr("CAST(user_id AS STRING) AS token_hash").distinct(), issued, F.lit(1705000000))


@query("WITH c AS (SELECT DISTINCT p_brand AS word, p_brand = 'Brand#7' AS none FROM part WHERE p_brand <> 'Brand#9'), w AS (SELECT DISTINCT p_brand AS word FROM part) SELECT word, CASE WHEN c.word IS NULL OR none THEN w.word ELSE lower(w.word) END AS stem, c.word IS NOT NULL AS cached FROM w LEFT JOIN c USING (word)")
def cached_stems(spark, d):
    words = A.table(spark, d, "part").selectExpr("p_brand AS word")
    cache = words.where("word <> 'Brand#9'").distinct().selectExpr("word", "CASE WHEN word = 'Brand#7' THEN array() ELSE array(lower(word)) END AS stems")
    return P.cached_stems(words, cache)


_UNIT = "CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, ' // Hit_', p_size, '.', p_partkey, ' // ') ELSE p_name END"


@query("WITH u AS (SELECT p_brand AS file, p_partkey AS seq, CASE WHEN p_partkey % 2 = 0 THEN 'verse' ELSE 'prose' END AS kind, p_name, p_size, p_partkey % 6 = 0 AS marked FROM part), c AS (SELECT *, coalesce(last_value(CASE WHEN marked THEN p_size::VARCHAR END IGNORE NULLS) OVER (PARTITION BY file ORDER BY seq ROWS UNBOUNDED PRECEDING), '0') AS chapter FROM u) SELECT file, seq, kind, CASE WHEN marked THEN chapter || '.' || seq ELSE 'c' || chapter || '.p' || row_number() OVER (PARTITION BY file, chapter, marked ORDER BY seq) END AS passage, chapter, p_name AS text, kind = 'verse' AND NOT marked AS needs_review FROM c")
def tei_passages(spark, d):
    """Only verses have marks; those of every sixth unit."""
    units = A.table(spark, d, "part").selectExpr("p_brand AS file", "p_partkey AS seq", "CASE WHEN p_partkey % 2 = 0 THEN 'verse' ELSE 'prose' END AS kind", f"CASE WHEN p_partkey % 2 = 0 THEN {_UNIT} ELSE p_name END AS text")
    return P.tei_passages(units)


_RUNNING = "concat(CASE WHEN p_partkey % 2 = 0 THEN concat('Сута 1: ', p_name) ELSE p_type END, ' (', p_size, ' - ', p_size + 1, ') ', p_brand, ' (7) tail')"


@query("SELECT p_partkey AS id, 0 AS k, p_size || '-' || (p_size + 1) AS verse, CASE WHEN p_partkey % 2 = 0 THEN 'Сута' END AS author, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS text FROM part UNION ALL SELECT p_partkey, 1, '7', CASE WHEN p_partkey % 2 = 0 THEN 'Сута' END, p_brand FROM part")
def split_verses(spark, d):
    return P.split_verses(A.table(spark, d, "part").selectExpr("p_partkey AS id", f"{_RUNNING} AS text"))


@query("WITH f AS (SELECT p_size % 5 AS volume, p_partkey AS verse_no, 0 AS k, p_partkey % 30 AS number FROM part UNION ALL SELECT p_size % 5, p_partkey, 1, p_size FROM part), n AS (SELECT DISTINCT s_suppkey % 5 AS volume, s_nationkey AS number FROM supplier) SELECT volume, verse_no, number::INT AS number FROM (SELECT *, row_number() OVER (PARTITION BY volume, number ORDER BY verse_no, k) AS r FROM f JOIN n USING (volume, number)) WHERE r = 1")
def note_references(spark, d):
    verses = A.table(spark, d, "part").selectExpr("CAST(p_size % 5 AS BIGINT) AS volume", "p_partkey AS verse_no", "concat('слово', p_partkey % 30, ' и », 12 год 1999(', ' дом]', p_size, '.') AS text")
    return P.note_references(verses, A.table(spark, d, "supplier").selectExpr("s_suppkey % 5 AS volume", "s_nationkey AS number"))


@query("WITH r AS (SELECT p_type AS stratum, lower(p_name) AS lemma, p_partkey % 3 AS k, p_partkey % 4 = 0 AS two FROM part WHERE p_partkey % 5 <> 0), s AS (SELECT stratum, count(*) AS n, count(*) FILTER (k = 0 OR two) AS lenient, count(*) FILTER (k = 0) AS strict, count(*) FILTER (two) AS ambiguous FROM r GROUP BY GROUPING SETS ((stratum), ())) SELECT *, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) AS low, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) AS high FROM (SELECT *, lenient / n::DOUBLE AS p FROM s)".replace("SELECT *, (p +", "SELECT stratum, n, lenient, strict, ambiguous, (p +"))
def tagger_scores(spark, d):
    from ..operators import quality

    gold = "CASE WHEN p_partkey % 5 = 0 THEN array() WHEN p_partkey % 4 = 0 THEN array(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'x' END, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE p_name END) ELSE array(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'x' END) END AS gold"
    return quality.tagger_scores(A.table(spark, d, "part").selectExpr("p_type", "upper(p_name) AS lemma", gold), "p_type")


@query("SELECT DISTINCT 'https://example.org/compare/w' || l_suppkey % 20 || '/' || (l_orderkey % 18 + 1) || '.' || l_linenumber AS url FROM lineitem")
def sitemap_compare(spark, d):
    from ..operators import export

    return export.sitemap_compare(A.table(spark, d, "lineitem").selectExpr("concat('w', l_suppkey % 20) AS work", "l_orderkey % 18 + 1 AS chapter", "l_linenumber AS verse"))


_ERRATUM = "CASE p_partkey % 5 WHEN 0 THEN concat('- id: ', p_partkey) WHEN 1 THEN concat('  read: \"', p_name, ': x\"') WHEN 2 THEN concat('  instead: ', p_type) WHEN 3 THEN '  # note: none' ELSE '' END"


@query("SELECT 'e' AS work, p_partkey // 5 + 1 AS entry, max(CASE WHEN p_partkey % 5 = 0 THEN p_partkey::VARCHAR END) AS id, max(CASE WHEN p_partkey % 5 = 1 THEN p_name || ': x' END) AS read, max(CASE WHEN p_partkey % 5 = 2 THEN p_type END) AS instead FROM part GROUP BY 2")
def errata_entries(spark, d):
    lines = A.table(spark, d, "part").selectExpr("'e' AS work", "p_partkey AS line_no", f"{_ERRATUM} AS line")
    return P.errata_entries(lines).select("work", "entry", *(F.try_element_at("fields", F.lit(k)).alias(k) for k in ("id", "read", "instead")))
