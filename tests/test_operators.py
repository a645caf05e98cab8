"""Operators on literal rows: edge cases that the driver tables do not hold."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import align, export, lexicon, passages, quality, refs, search, stateful
from lexiloom.sources import adapters
from lexiloom.streaming import windows


@pytest.fixture(scope="module")
def corpus(spark):
    lines = spark.createDataFrame(
        [("a", 1.0, "kṛṣṇa and arjuna", "1", "a:1"), ("a", 2.0, "snake_case foo-bar", "1", "a:2"), ("a", 2.5, "half line foo baz", "1", "a:2h"), ("b", 1.0, "Карма йога", "1", "b:1"), ("b", 2.0, None, "2", None), ("b", 3.0, "pitṝn pitrn", "2", "b:3")],
        "source_slug string, line_num double, line_text string, chapter string, canonical_id string",
    )
    sources = spark.createDataFrame([(1, "a", 2), (2, "b", 1), (3, "c", 3)], "source_id int, slug string, sort_order int")
    return lines, sources


def found(df):
    return [r["canonical_id"] for r in df.collect()]


def test_plain_search_folds_single_marks_only(corpus):
    assert found(search.search_plain(*corpus, search.SearchSpec("krsna"))) == ["a:1"]
    assert found(search.search_plain(*corpus, search.SearchSpec("krsna", fold_diacritics=False))) == []
    assert found(search.search_plain(*corpus, search.SearchSpec("pitrn\n arj"))) == ["b:3", "a:1"]  # by sort order of sources


def test_separators_make_phrases_with_a_prefix_at_the_end(corpus):
    assert found(search.search_plain(*corpus, search.SearchSpec("foo-ba"))) == ["a:2", "a:2h"]
    assert found(search.search_plain(*corpus, search.SearchSpec("foo-ba", whole_word=True))) == []
    assert found(search.search_plain(*corpus, search.SearchSpec("--"))) == []


def test_none_is_all_sources_and_empty_is_none(corpus):
    assert len(found(search.search_plain(*corpus, search.SearchSpec("a")))) == 1
    assert found(search.search_plain(*corpus, search.SearchSpec("a", source_ids=()))) == []
    assert found(search.search_plain(*corpus, search.SearchSpec(" \n "))) == []


def test_whole_word_counts_underscore_as_a_letter(corpus):
    assert found(search.search_plain(*corpus, search.SearchSpec("snake", whole_word=True))) == []
    assert found(search.search_plain(*corpus, search.SearchSpec("карма", whole_word=True))) == ["b:1"]
    assert found(search.search_plain(*corpus, search.SearchSpec("карма", whole_word=True, case_sensitive=True))) == []


def test_regex_contract(corpus):
    with pytest.raises(ValueError, match="pattern_count"):
        search.search_regex(*corpus, ["x"] * 11)
    with pytest.raises(ValueError, match="pattern_too_long"):
        search.search_regex(*corpus, ["x" * 513])
    with pytest.raises(ValueError, match="pattern_invalid"):
        search.search_regex(*corpus, ["("])


def test_runaway_pattern_times_out_and_says_so(spark):
    lines = spark.createDataFrame([("a" * 40 + "!",), ("b",)], "line_text string")
    got = search.search_regex_bounded(lines, ["(a|aa|a)*$c"], per_match_ms=20).collect()
    assert all(not r["matched"] for r in got)


def test_variants_are_reported_once(corpus):
    assert [(r["canonical_id"], r["variant"]) for r in search.search_variants(*corpus, ["foo", "bar", "half"]).collect()] == [("a:2", "bar"), ("a:2h", "foo")]


def test_kwic_takes_the_first_term_of_the_query(spark):
    df = spark.createDataFrame([("x" * 50 + " beta " + "y" * 50 + " alpha",), ("",)], "t string")
    got = [r[0] for r in df.select(X.kwic(F.col("t"), ["alpha", "beta"])).collect()]
    assert got[0].startswith("…") and got[0].endswith("alpha") and got[1] == ""


def test_classification(spark):
    seg = spark.createDataFrame([(1, "sa", 0, "x"), (1, "ru", 1, "y"), (1, "comm", 2, "z"), (2, "ru", 0, "y"), (3, "sa", 0, "x"), (4, "sa", 0, "x"), (4, "ru", 1, " ")], "group_id int, seg string, seq int, text string")
    got = {r["group_id"]: (r["kind"], r["empty_side"], r["n_comm"]) for r in passages.classify(seg).collect()}
    assert got == {1: ("pair", False, 1), 2: ("mono_ru", False, 0), 3: ("mono_sa", False, 0), 4: ("none", True, 0)}


def test_duplicate_suffixes_end_at_z(spark):
    got = [r[0] for r in spark.range(28).select(X.letter_suffix(F.col("id"))).collect()]
    assert got[:3] == ["", "b", "c"] and got[25] == "z" and got[26] is None


def test_compare_prefers_exact_over_range(spark):
    v = spark.createDataFrame([("w", 1, 5, 7, 1), ("w", 1, 6, 6, 2), ("x", 1, 5, 7, 3)], "work string, chapter int, lo int, hi int, row_id int")
    wanted = spark.createDataFrame([(1, 6), (1, 9)], "chapter int, verse int")
    assert sorted((r["work"], r["row_id"]) for r in align.compare_range(wanted, v).collect()) == [("w", 2), ("x", 3)]


def test_multiset_join_pairs_occurrences(spark):
    left = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, "b", 2)], "g int, k string, o int")
    right = spark.createDataFrame([(1, "a", 0), (1, "c", 1)], "g int, k string, o int")
    got = sorted((r["k"], r["occurrence"], r["status"]) for r in align.multiset_join(left, right, "g", "k", "o").collect())
    assert got == [("a", 1, "matched"), ("a", 2, "left_only"), ("b", 1, "left_only"), ("c", 1, "right_only")]


def test_errata_are_idempotent_and_refuse_many(spark):
    docs = spark.createDataFrame([(1, "x cat"), (2, "dog"), (3, "cat cat"), (4, "y")], "doc_id int, text string")
    p = spark.createDataFrame([(i, "cat", "dog") for i in (1, 2, 3, 4)], "doc_id int, read string, instead string")
    assert {r["doc_id"]: (r["status"], r["fixed"]) for r in quality.apply_errata(docs, p).collect()} == {1: ("applied", "x dog"), 2: ("already", "dog"), 3: ("ambiguous", "cat cat"), 4: ("missing", "y")}


def test_agreement_leaves_nulls_out(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (None, 1)], "left_x int, right_x int")
    assert tuple(quality.agreement(pairs, ["x"]).first()) == (2, 0.5)
    assert tuple(quality.agreement(pairs.limit(0), ["x"]).first()) == (0, None)


def test_bucket_quirk_and_strict_alphabet(spark):
    df = spark.createDataFrame([("aitihya",), ("kha",), ("kṣetra",), ("7",)], "h string")
    assert [r[0] for r in df.select(lexicon.bucket(F.col("h"))).collect()] == ["a", "k", "kṣ", "#"]
    assert [r[0] for r in df.select(lexicon.bucket(F.col("h"), strict=True)).collect()] == ["ai", "kh", "kṣ", "#"]


def test_narrowing_never_empties(spark):
    df = spark.createDataFrame([(["веды", "веда"], "ведам"), (["веда"], "ведам"), (["веды", "веда"], "ведой")], "c array<string>, s string")
    assert [r[0] for r in df.select(lexicon.narrow(F.col("c"), F.col("s"))).collect()] == [["веды"], ["веда"], ["веда"]]


def test_manifest_diff(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "source_slug string, n int")
    new = spark.createDataFrame([("b", 2), ("c", 4), ("d", 5)], "source_slug string, n int")
    assert sorted(map(tuple, refs.diff(old, new).collect())) == [("a", "removed", ""), ("b", "same", ""), ("c", "changed", "n"), ("d", "added", "")]


def test_quota_counts_denied_requests(spark):
    e = spark.sql("SELECT id AS event_id, 1 AS user_id, timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS ts FROM range(4)")
    got = [(r["n"], r["allowed"], r["remaining"]) for r in stateful.rate_limit(e, "user_id", 3600, 2).orderBy("event_id").collect()]
    assert got == [(1, True, 1), (2, True, 0), (3, False, 0), (4, False, 0)]


def test_stream_equals_batch(spark, tmp_path):
    e = spark.sql("SELECT id AS event_id, id % 3 AS user_id, timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 7) AS ts FROM range(200)")
    e.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "events"))
    got = windows.run_available(windows.windowed_counts(stream, "user_id"), "stream_equals_batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, windows.windowed_counts(e, "user_id").collect()))


def test_canonical_reader(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"id":"w:1#sa","work":"w","seg":"sa","text":"t","seq":1}\n{"id":"w:2#sa","deleted":true}\n')
    assert [r["id"] for r in adapters.read_canonical(spark, str(f)).collect()] == ["w:1#sa"]
    f.write_text('{"work":"w"}\n')
    with pytest.raises(Exception, match="no id"):
        adapters.read_canonical(spark, str(f)).select("id").collect()
    assert adapters.read_canonical(spark, str(f), strict=False).count() == 0


def test_conllu_reader(spark, tmp_path):
    f = tmp_path / "x.conllu"
    f.write_text("# sent_id = 1\n# text = a b\n1\ta\ta\n2\tb\tb\n\n# sent_id = 2\n# text = c\n1\tc\tc\n\n")
    got = [(r["sent_id"], r["text"], len(r["rows"])) for r in adapters.read_conllu(spark, str(f)).collect()]
    assert got == [("1", "a b", 2), ("2", "c", 1)]


def test_publication_moves_a_pointer(spark, tmp_path):
    root = f"file://{tmp_path}/pub"
    export.publish(spark.range(3), root, "1")
    export.publish(spark.range(5), root, "2")
    assert export.read_published(spark, root).count() == 5
    export.point(spark, root, "1")
    assert export.read_published(spark, root).count() == 3


def test_transliteration(spark):
    from lexiloom.functions import scripts as S

    df = spark.createDataFrame([("dharmakṣetre kṛṣṇaḥ",), (None,)], "t string")
    assert [r[0] for r in df.select(S.iast_to_slp1(F.col("t"))).collect()] == ["Darmakzetre kfzRaH", None]
    assert df.select(S.slp1_to_iast(S.iast_to_slp1(F.col("t")))).first()[0] == "dharmakṣetre kṛṣṇaḥ"
    deva = spark.createDataFrame([("धर्मक्षेत्रे कृष्णः",), (None,)], "t string")
    assert [r[0] for r in deva.select(S.deva_to_iast("t")).collect()] == ["dharmakṣetre kṛṣṇaḥ", None]
    mixed = spark.createDataFrame([("кaрма",), ("hоme",), ("дом",)], "t string")
    assert [r[0] for r in mixed.select(S.unmix(F.col("t"))).collect()] == ["карма", "home", "дом"]


def test_cover_fails_whole(spark):
    from lexiloom.operators import building as B

    cases = [(["a", "b", "c"], ["ab", "c"], [2, 1]), (["a", "b"], ["ab", "c"], None), (["a", "x"], ["a"], None), ([], [], None), (["manasā", "api"], ["manasāpi"], [2]), (["samāyuktaḥ"], ["samāyukto", "||"], [1, 0]), (["vāc", "vidām"], ["vāgvidāṃ"], [2]), (None, ["a"], None)]
    df = spark.createDataFrame([(k, g, w) for k, (g, w, _) in enumerate(cases)], "id int, gold array<string>, words array<string>")
    assert {r["id"]: r["pieces"] for r in B.gold_to_words(df).collect()} == {k: x for k, (_, _, x) in enumerate(cases)}


def test_keys_keep_the_letters_of_romanised_sanskrit(spark):
    from lexiloom.functions import sanskrit as K

    df = spark.createDataFrame([("Śaṅkara ṭīkā 1.2 ||",), ("saṃgṛhya",), ("saṅgṛhya",), ("ṁ a\u0304",), (None,)], "t string")
    got = [tuple(r) for r in df.select(K.norm_iast(F.col("t")), K.skeleton(K.norm_iast(F.col("t")))).collect()]
    assert got == [("śaṅkaraṭīkā", "śmkrṭk"), ("saṃgṛhya", "smgh"), ("saṅgṛhya", "smgh"), ("ṃā", "m"), ("", "")]
    more = spark.createDataFrame([("dharmakṣetre । kurukṣetre ॥ 1 ॥",)], "t string")
    assert more.select(K.half_verses(F.col("t"))).first()[0] == ["dharmakṣetre", "kurukṣetre"]
    lemmas = spark.createDataFrame([("kṛṣṇa",), ("k\ufffdp",), ("",), (None,)], "t string")
    assert [r[0] for r in lemmas.select(K.clean_lemma(F.col("t"))).collect()] == ["kfzRa", None, None, None]
    assert spark.createDataFrame([("evaM। 12 pArTAH",)], "t string").select(K.clean_slp1(F.col("t")), K.join_key(F.col("t"))).first() == ("evaM pArTAH", "evam। 12 pArTAs")


def test_slugs(spark):
    names = ["bhagavadgita-smirnov.html", "06_mahabharata-bhishmaparva.html", "01_rigveda.html", "Словарь Смирнова.txt", "Эрман-Темкин.txt", "Рамаяна 3. Словарь.txt", "x.pdf", ".html"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    assert [r[0] for r in df.orderBy("id").select(X.slug(F.col("name"))).collect()] == ["bhagavadgita-smirnov", "06_mahabharata-bhishmaparva", "01_rigveda", "slovar-smirnova", "erman-temkin", "ramayana-3-slovar", "x-pdf", ""]
    clash = spark.createDataFrame(list(enumerate(["a", "a", "a", "a-2", "a-4", "a", ".txt", ".xml"])), "id int, name string")
    assert [r["slug"] for r in X.unique_slugs(clash).orderBy("id").collect()] == ["a", "a-3", "a-5", "a-2", "a-4", "a-6", "source", "source-2"]


def test_references_are_undone_and_anchors_found(spark):
    from lexiloom.functions import markup as M

    df = spark.createDataFrame([("a &amp; b &lt;i&gt; &#1072;&#x431; &amp;lt;",), ("a<br>b <small>c</small>d<a href='#' class='comment_sub'>1</a>",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(M.searchable(F.col("t"))).collect()] == ["a & b <i> аб &lt;", "a b d", "plain", None]
    anchors = ["comment_1_2", "comment_1_2a", "comment_1_0", "comment_1_2_3", "comment_1_2-5", "comment_1_2a–c", "comment_1_1.3", "comment_c_4", "chapter_3C", "comment_1_2;", "comment_7_8б и далее", "note"]
    got = [r[0] for r in spark.createDataFrame([(k, a) for k, a in enumerate(anchors)], "k int, a string").orderBy("k").select(M.comment_target(F.col("a"))).collect()]
    assert got == ["1.2", "1.2a", "c.1", "1.2", "1.2", "1.2a", "1.1", "c.c", "c.3", "1.2", "7.8б", None]
    blocks = spark.createDataFrame([('<span class="translation_author">Санджая$:</span>сказал <span class="iast_author">x</span>',), ("no author",)], "t string")
    assert [tuple(r) for r in blocks.select(M.author(F.col("t")), M.without_author(F.col("t"))).collect()] == [("Санджая", "сказал "), (None, "no author")]


def test_nested_comments_and_titles(spark):
    from lexiloom.operators import conversion as C

    line = '<div class="citation_block" id="1.1"><div class="comments"><div class="comment_item" id="comment_1_1">a <div>b <div>c</div></div> d</div><div class="comment_item" id="x">e</div></div></div>'
    got = spark.createDataFrame([(line,), ("none",)], "t string").select(C.comment_items(F.col("t"))).collect()
    assert [[tuple(x) for x in r[0]] for r in got] == [[("comment_1_1", "a <div>b <div>c</div></div> d"), ("x", "e")], []]
    titles = spark.createDataFrame([("Махабхарата VI. 1. 3-6", "06_mahabharata-x"), ("Махабхарата VI. 1. 3-6", "other"), ("Гитаговинда, 1. 11-12", "g"), ("Appendix", "g")], "t string, w string")
    assert [r[0] for r in titles.select(C.titled_passage(F.col("t"), F.col("w"))).collect()] == ["6.1.3-6", "1.3-6", "1.11-12", None]


def test_reader_languages_and_addresses(spark):
    from lexiloom.functions import markup as M
    from lexiloom.operators import reader as R

    both = '<div class="chapter_block iast">sa</div><div class="chapter_block translation">ru</div>'
    assert [M.normalize_lang(x) for x in (" RU ", "sa", "de", "", None)] == ["ru", "sa", None, None, None]
    r = spark.createDataFrame([(both,)], "h string").select(M.only_language(F.col("h"), "ru"), M.only_language(F.col("h"), "sa"), M.only_language(F.col("h"), None), M.is_parallel(F.col("h")), M.is_parallel(F.lit(None).cast("string"))).first()
    assert tuple(r) == ('<div class="chapter_block translation">ru</div>', '<div class="chapter_block iast">sa</div>', both, True, False)
    assert R.variant_url("https://x/", "a b", "1.1", "ru") == "https://x/sources/a%20b?highlight=1.1&lang=ru" and R.variant_url("", "s") == "/sources/s"
    assert [a["url"] for a in R.alternates("", "s", True)] == ["/sources/s", "/sources/s?lang=ru", "/sources/s?lang=sa"] and R.alternates("", "s", False) == []
    sources = spark.createDataFrame([(1, "a", 2), (2, "b", 1), (3, "1", 3)], "source_id int, slug string, sort_order int")
    assert [sorted(r["slug"] for r in R.resolve_filter(sources, t).collect()) for t in (["a"], ["2"], ["1"], ["zzz"], [])] == [["a"], ["b"], ["1"], ["1", "a", "b"], ["1", "a", "b"]]


def test_dictionary_queries_in_any_script():
    from lexiloom.operators import dictionary as D

    assert D.query_keys(" धर्म ") == {"raw": "धर्म", "iast": "dharma", "slp1": "Darma"}
    assert D.query_keys("Darma") == {"raw": "Darma", "slp1": "Darma", "iast": "dharma"}
    assert D.query_keys("kṛṣṇa")["slp1"] == "kfzRa" and D.query_keys(" ") == {"raw": ""}


def test_scan_stops_where_a_reader_would(corpus):
    hits, stats = search.search_regex_scan(*corpus, ["foo|карма|pit"], max_rows=3)
    assert found(hits) == ["b:1", "b:3"] and tuple(stats.first()) == (4, True, True)
    hits, stats = search.search_regex_scan(*corpus, ["foo|карма|pit"], limit=2)
    assert found(hits) == ["b:1", "b:3"] and tuple(stats.first()) == (3, False, False)
    hits, stats = search.search_regex_scan(*corpus, ["nothing"])
    assert found(hits) == [] and tuple(stats.first()) == (6, False, False)
    assert found(search.dispatch(*corpus, "foo\n", mode="regex")[0]) == ["a:2", "a:2h"] and found(search.dispatch(*corpus, "krsna")[0]) == ["a:1"]
    with pytest.raises(ValueError, match="unknown mode"):
        search.dispatch(*corpus, "x", mode="other")


def test_stored_norm_gives_the_same_hits(corpus):
    lines, sources = corpus
    for spec in (search.SearchSpec("krsna\nfoo ba"), search.SearchSpec("карма", whole_word=True), search.SearchSpec("kṛṣṇa", fold_diacritics=False)):
        assert found(search.search_plain(search.with_norm(lines, spec.fold_diacritics), sources, spec)) == found(search.search_plain(lines, sources, spec))


def test_snippets_exports_and_overview(spark, corpus):
    df = spark.createDataFrame([("x" * 50 + " beta " + "y" * 50 + " alpha",), ("",), ("q" * 90,)], "t string")
    got = [tuple(r[0]) for r in df.select(X.kwic_parts(F.col("t"), ["beta"])).collect()]
    assert got == [("…" + "x" * 39 + " ", "beta", " " + "y" * 39 + "…"), ("", "", ""), ("", "", "q" * 80 + "…")]
    assert search.export_filename("foo: bar/б", "csv") == "foo_bar_б.csv" and search.export_filename("///", "json") == "search.json"
    text = search.overview_text(search.search_plain(*corpus, search.SearchSpec("a\nк")), "a", elapsed_ms=260)
    assert text.split("\n")[0] == "Запрос: «a» · 2 записей · 2 источников · 0,3 с" and len(text.split("\n")) == 3
    assert search.source_ids_of(None) is None and search.source_ids_of("") == () and search.source_ids_of("1, 2") == (1, 2)


def test_conllu_rules_and_surface(spark):
    from lexiloom.operators import annotation as N

    def row(i, form="f", lemma="l", upos="NOUN", feats="_", head="_", misc="_", deps="_"):
        return [i, form, lemma, upos, "_", feats, head, "_", deps, misc]

    good = [["1-2", "ab", *"________"], row("1", "a"), row("2", "b"), row("3", "c")]
    cases = [("1", "ab c", good), ("2", "x", good), ("3", "a", [row("1", "a"), row("3", "a")]), ("4", "a", [["1", "a"]]), ("5", "a", [row("1", "a", upos="")]), ("6", "a", [row("1", "a", feats="x y")]), ("7", "a", [row("1", "a", head="h")]), ("8", "", good), ("1", "ab c", good), ("9", "a", []), ("10", "ab", [row("1", "a", misc="SpaceAfter=No"), row("2", "b")]), ("11", "f", [["2-1", "f", *"________"]]), ("12", "f", [["1-1", "f", "x", *"_______"]])]
    df = spark.createDataFrame([("f", k, *c) for k, c in enumerate(cases)], "file string, pos int, sent_id string, text string, rows array<array<string>>")
    got = sorted((r["sent_id"], r["code"], r["place"]) for r in N.conllu_faults(df).collect())
    assert got == sorted([("2", "E8", 0), ("3", "E2", 2), ("3", "E8", 0), ("4", "E1", 1), ("5", "E4", 1), ("6", "E5", 1), ("7", "E6", 1), ("8", "E7", 0), ("1", "E7", 0), ("9", "E7", 0), ("11", "E2", 1), ("12", "E2", 1), ("12", "E3", 1)])


def test_published_versions_roll_back(spark, tmp_path):
    root = f"file://{tmp_path}/pub2"
    with pytest.raises(ValueError, match="nothing is published"):
        export.read_published(spark, root)
    assert export.publish(spark.range(3), root, "1") == 3 and export.publish(spark.range(5), root, "2") == 5
    assert export.roll_back(spark, root) == "1" and export.read_published(spark, root).count() == 3


def test_stream_to_files_equals_batch(spark, tmp_path):
    e = spark.sql("SELECT id AS event_id, id % 3 AS user_id, timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 7) AS ts FROM range(200)")
    e.repartition(4).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    got = windows.run_to_files(windows.windowed_counts(stream, "user_id"), str(tmp_path / "out"), ["window_start", "user_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, windows.windowed_counts(e, "user_id").collect()))


def test_manifest_files_are_hashed(spark, tmp_path):
    import hashlib

    for k, data in (("a", b"one"), ("b", b"two")):
        (tmp_path / k).write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    path = {r["path"].rsplit("/", 1)[1]: r["path"] for r in files.select("path").collect()}
    rows = [("a", path["a"], 3, hashlib.sha256(b"one").hexdigest()), ("b", path["b"], 3, "0"), ("c", path["b"], 4, "0"), ("d", "nowhere", 1, "0")]
    got = refs.file_faults(spark.createDataFrame(rows, "slug string, path string, bytes long, sha256 string"), files).collect()
    assert sorted(map(tuple, got)) == [("missing", "d"), ("sha256", "b"), ("size", "c")]


def test_no_phrases_match_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert align.phrase_matches(docs, []).count() == 0 and align.phrase_matches(docs, ["", "b"]).count() == 1


def test_each_tier_has_its_partners(spark):
    left = [(1, "dharmakṣetre"), (2, "saṃgṛhya"), (3, "abhijñānaśākuntalamx"), (4, "nothing"), (5, ""), (6, "dharmakṣetre"), (7, "kmr"), (8, "sukhatantronacālasaḥ")]
    right = [(10, "dharmakṣetre"), (11, "dharmakṣetre"), (12, "saṅgṛhya"), (13, "abhijñānaśākuntalamz"), (14, "abhijñānaśākuntalamxx"), (15, ""), (16, "kāmaraiḥāūuuuu"), (17, "sukhatantraḥnacaalasaḥ")]
    got = align.tiers(spark.createDataFrame(left, "left_id int, left_key string"), spark.createDataFrame(right, "right_id int, right_key string")).collect()
    assert {r["left_id"]: (r["right_id"], r["tier"], r["n_right"]) for r in got} == {1: (10, "exact", 2), 6: (10, "exact", 2), 2: (12, "sandhi", 1), 3: (14, "fuzzy", 1), 8: (17, "sandhi", 1)}


def test_tei_is_read_in_order(spark, tmp_path):
    from lexiloom.operators import parsing as P

    f = tmp_path / "x.xml"
    f.write_text('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><p>prose <hi>one</hi> tail<lg><l>a b</l><l>c // Hit_4.142 //</l></lg> after</p><lg><l>d</l></lg><p/></div></body></text></TEI>')
    units = P.read_tei(spark, str(f))
    assert [(r["kind"], r["text"]) for r in units.orderBy("seq").collect()] == [("prose", "prose one tail after"), ("verse", "a b c // Hit_4.142 //"), ("verse", "d")]
    assert [(r["passage"], r["text"], r["needs_review"]) for r in P.tei_passages(units).orderBy("seq").collect()] == [("c0.p1", "prose one tail after", False), ("4.142", "a b c", False), ("c4.p1", "d", True)]


def test_names_are_trusted_by_their_capital_or_by_the_lists(spark):
    from lexiloom.operators import parsing as P

    docs = spark.createDataFrame([(1, "Кали пришла. Арджуна и Кришна! йога кали-юга стол"), (2, None), (3, "")], "id int, text string")
    words = P.words_in_place(docs, "id")
    assert [(r["surface"], r["start"], r["sentence_initial"]) for r in words.orderBy("k").collect()][:4] == [("Кали", 0, True), ("пришла", 5, False), ("Арджуна", 13, True), ("и", 21, False)]
    lists = [spark.createDataFrame([(x,) for x in xs], "form string") for xs in (["йога"], ["кали", "пришла", "и", "стол"], ["стол"])]
    got = {r["surface"]: r["trusted"] for r in P.trusted_names(words, *lists).collect()}
    assert got == {"Кали": False, "пришла": False, "Арджуна": True, "и": False, "Кришна": True, "йога": False, "кали-юга": True, "стол": True}


def test_tokens_are_repaired_only_as_a_whole(spark):
    from lexiloom.operators import parsing as P

    df = spark.createDataFrame([("слoво",), ("щq",), ("слово",), ("кrсна",), ("dhаrma",)], "t string")
    assert [tuple(r) for r in df.select(P.repaired(F.col("t"), latin=False), P.repaired(F.col("t"), latin=True)).collect()] == [("слово", None), (None, None), (None, None), (None, None), (None, "dharma")]


def test_places_of_equal_and_single_values(spark):
    from lexiloom.operators.ranks import values_at

    df = spark.createDataFrame([("a", 5.0)] * 9 + [("b", 1.0), ("b", 1e9), ("b", 2.0), ("c", None)], "g string, x double")
    n = F.col("n")
    got = {r["g"]: (r["n"], r["lo"], r["mid"], r["hi"]) for r in values_at(df, ["g"], "x", {"lo": F.lit(0), "mid": F.floor(n / 2), "hi": n - 1}).collect()}
    assert got == {"a": (9, 5.0, 5.0, 5.0), "b": (3, 1.0, 2.0, 1e9)}


def test_documents_convert_back_to_their_records(spark, tmp_path):
    """Records to citation blocks to a document, and the document back to the same records."""
    from lexiloom.operators import conversion as C
    from lexiloom.operators import documents as D
    from lexiloom.operators import ingest as I

    records = [("w", "w:1.1", "1.1", "sa", 1, "1", "dharma kṣetre", "saṃjaya", None), ("w", "w:1.1", "1.1", "ru", 2, "1", "на поле &amp; дхармы", "Санджая", None), ("w", "w:1.1", "1.1.comm1", "comm1", 3, "1", "note <div>x</div>", None, "1.1"), ("w", "w:1.2", "1.2", "ru", 4, "1", "два", None, None), ("w", "w:2.10", "2.10", "sa", 6, "2", "b", None, None), ("w", "w:2.9", "2.9", "sa", 5, "2", "a", None, None)]
    df = spark.createDataFrame(records, "work string, group string, passage string, seg string, seq int, chapter string, html string, author string, annotates string")
    lines = D.document_lines(D.citation_blocks(df, "T"), spark.createDataFrame([("w", "Title")], "work string, title string"))
    D.write_documents(lines, str(tmp_path / "out"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "out" / "work=w").glob("part-*"))).splitlines()
    assert text[0] == "<!-- Title --!>" and text[-1] == "</body></html>" and [x for x in text if "chapter_title" in x] == ['<div class="chapter_title" id="1">1</div>', '<div class="chapter_title" id="2">2</div>']
    (tmp_path / "w.html").write_text("\n".join(text) + "\n")
    read = I.read_corpus_lines(spark, str(tmp_path / "w.html"))
    assert [r["line"] for r in read.orderBy("line_no").collect()] == text and C.source_titles(read).collect()[0]["title"] == "Title"
    back = {(r["id"], r["group"], r["seg"], r["text"], r["author"], r["annotates"], r["chapter"]) for r in C.verse_records(read).collect()}
    assert back == {("w:1.1#sa", "w:1.1", "sa", "dharma kṣetre", "saṃjaya", None, "1"), ("w:1.1#ru", "w:1.1", "ru", "на поле & дхармы", "Санджая", None, "1"), ("w:1.1.comm1", "w:1.1", "comm1", "note x", None, "1.1", "1"), ("w:1.2#ru", "w:1.2", "ru", "два", None, None, "1"), ("w:2.9#sa", "w:2.9", "sa", "a", None, None, "2"), ("w:2.10#sa", "w:2.10", "sa", "b", None, None, "2")}


def test_lines_keep_their_numbers_over_splits(spark, tmp_path):
    from lexiloom.operators import ingest as I

    for name, n in (("a.txt", 900), ("b c.html", 50)):
        (tmp_path / name).write_text("".join(f"line {k} of {name}\n" for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        rows = I.read_corpus_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["work"], r["line_no"], r["line"]) for r in rows) == sorted([("a", k, f"line {k} of a.txt") for k in range(900)] + [("b c", k, f"line {k} of b c.html") for k in range(50)])


def test_a_corpus_is_loaded_whole_or_not_at_all(spark, corpus, tmp_path):
    from lexiloom.operators import ingest as I

    lines, sources = corpus
    root = f"file://{tmp_path}/corpus"
    with pytest.raises(ValueError, match="missing_id"):
        I.load(lines, sources, root, "1")
    good = lines.where("canonical_id is not null")
    listed = sources.where("slug <> 'c'")
    assert I.load(good, listed, root, "1") == 5
    held = export.read_published(spark, root)
    assert found(search.search_plain(held, sources, search.SearchSpec("krsna"))) == ["a:1"]
    with pytest.raises(ValueError, match="wrong_count"):
        I.load(good, listed, root, "2", good.groupBy("source_slug").agg((F.count("*") + 1).alias("record_count")))
    folder = f"file://{tmp_path}/by_source"
    I.reload_source(good, folder)
    for _ in range(2):
        I.reload_source(good.where("source_slug = 'a' and line_num = 1"), folder)
    assert {(r["source_slug"], r["n"]) for r in spark.read.parquet(folder).groupBy("source_slug").agg(F.count("*").alias("n")).collect()} == {("a", 1), ("b", 2)}


def test_jobs_load_and_search(spark, tmp_path, capsys):
    from lexiloom import jobs

    (tmp_path / "x.jsonl").write_text('{"id":"w:1#sa","work":"w","passage":"1","seg":"sa","text":"kṛṣṇa uvāca","seq":1}\n')
    args = ["--input", str(tmp_path / "x.jsonl"), "--output", f"file://{tmp_path}/c"]
    assert jobs.main(["load", *args]) == 0 and jobs.main(["search", "--input", f"file://{tmp_path}/c", "--query", "krsna"]) == 0
    out = capsys.readouterr().out
    assert out.split("\n")[0] == "1" and '"canonical_id":"w:1#sa"' in out
    (tmp_path / "x.conllu").write_text("# sent_id = 1\n# text = a\n1\ta\ta\tNOUN\t_\t_\tx\t_\t_\t_\n\n")
    assert jobs.main(["validate-conllu", "--input", str(tmp_path / "x.conllu")]) == 1


def test_false_verses_go_back(spark):
    from lexiloom.operators import parsing as P

    v = [(1, 1, "a", False, False), (2, 3, "b", False, False), (1, 1, "back", False, False), (30, 30, "note", True, False), (4, 4, "c", False, False), (40, 40, "colophon", True, True), (None, None, "free", False, False), (99, 99, "far", False, False), (5, 5, "d", False, False)]
    df = spark.createDataFrame([(1, v), (2, []), (3, [(7, 7, "x", True, True)])], "id int, verses array<struct<start:int,end:int,text:string,debris:boolean,colophon:boolean>>")
    got = {r["id"]: [(x["start"], x["text"]) for x in r["verses"]] for r in P.collapse_verses(df).collect()}
    assert got == {1: [(1, "a"), (2, "b back note"), (4, "c"), (None, "free"), (5, "d")], 2: [], 3: [(7, "x")]}


def test_errata_are_read_and_reported(spark):
    from lexiloom.operators import parsing as P

    text = ["# errata", "- id: 'w:1.2#ru'", '  read: "a: b"', "  instead: c", "", "- passage: 1.10", "  read: x", "  read: y"]
    got = P.errata_entries(spark.createDataFrame([("w", k, x) for k, x in enumerate(text)], "work string, line_no int, line string")).orderBy("entry").collect()
    assert [r["fields"] for r in got] == [{"id": "w:1.2#ru", "read": "a: b", "instead": "c"}, {"passage": "1.10", "read": "y"}]
    rows = spark.createDataFrame([("w", "1.10", "a", "b", "missing"), ("w", "1.9", "c", "d", "applied")], "work string, passage string, read string, instead string, status string")
    assert [r["line"] for r in P.errata_report(rows).orderBy("natural").collect()] == ["- [x] 1.9: c → d", "- [ ] 1.10: a → b (missing)"]


def test_a_passage_met_27_times(spark):
    """The 27th takes the next number of the work, which comments without a verse take too; or the letters run on."""
    from lexiloom.operators import conversion as C

    def block(passage, k, *anchors):
        notes = "".join(f'<div class="comment_item" id="{a}">n</div>' for a in anchors)
        return ("w", k, f'<div class="citation_block" id="{passage}"><div class="chapter_content"><div class="chapter_block iast">a</div></div><div class="comments">{notes}</div></div>')

    lines = spark.createDataFrame([block("1.1", k, *(["foo", "foo"] if k == 3 else ["foo", "comment_1_1", "foo"] if k == 27 else [])) for k in range(1, 29)] + [block("1.2", 29, "foo")], "work string, line_no int, line string")
    rows = C.verse_records(lines).collect()
    got = {r["line_no"]: r["passage"] for r in rows if r["seg"] == "sa"}
    assert [got[k] for k in (1, 2, 26, 27, 28, 29)] == ["1.1", "1.1b", "1.1z", "p3", "p6", "1.2"]
    assert sorted((r["line_no"], r["annotates"]) for r in rows if r["annotates"]) == [(3, "c.0.p1"), (3, "c.0.p2"), (27, "1.1"), (27, "c.0.p4"), (27, "c.0.p5"), (29, "c.0.p7")]
    rows = C.verse_records(lines, after_z="running").collect()
    got = {r["line_no"]: r["passage"] for r in rows if r["seg"] == "sa"}
    assert [got[k] for k in (1, 2, 26, 27, 28, 29)] == ["1.1", "1.1b", "1.1z", "1.1{", "1.1|", "1.2"]
    assert {r["annotates"] for r in rows if r["line_no"] == 29 and r["annotates"]} == {"c.0.p5"}
    assert [r[0] for r in spark.createDataFrame([(31,), (300,), (60000,)], "n int").select(X.running_suffix(F.col("n"))).collect()] == [chr(128), chr(397), chr(60097)]


def test_ranges_with_the_same_ends_share_a_body(spark):
    """Texts are gathered by the ranges' ends; gathered by range they would be shuffled once for each of many ranges."""
    from lexiloom.operators import building as B

    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "c"), (1, 1, "b"), (1, 3, "d"), (2, 0, "e")], "g int, seq long, text string")
    ranges = spark.createDataFrame([(10, 1, 0, 1), (11, 1, 0, 1), (12, 1, 2, 4), (13, 2, 1, 3), (14, None, 0, 1), (15, 2, 0, 0)], "range_id int, g int, lo long, hi long")
    df = B.concatenate_ranges(ranges, rows, "g")
    assert {r["range_id"]: (r["body"], r["n"]) for r in df.collect()} == {10: ("a b c", 3), 11: ("a b c", 3), 12: ("d", 1), 13: ("", 0), 14: ("", 0), 15: ("e", 1)}
    gathers = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in x]
    assert gathers and not any("range_id" in x for x in gathers)


def test_a_frequent_name_is_joined_by_several_tasks(spark):
    from lexiloom.operators import parsing as P

    names = spark.createDataFrame([("w", k, "Имя", "" if k == 0 else "āb" if k % 2 else "c") for k in range(64)], "work string, line_no int, headword string, iast string").coalesce(1)
    table = spark.createDataFrame([("Имя", "s1", "ab"), ("Имя", "s2", "c"), ("Имя", "s3", None), ("x", "s4", "ab")], "cyrillic string, slp1 string, witness string").coalesce(1)
    joined, counts = P.join_names(names, table)
    assert joined.columns == ["work", "line_no", "headword", "iast", "slp1", "witness", "agreement"]
    got = {(r["line_no"], r["slp1"]): r["agreement"] for r in joined.collect()}
    assert len(got) == 64 * 3 and joined.count() == 64 * 3
    assert [got[k, s] for k in (0, 1, 2) for s in ("s1", "s2", "s3")] == ["NO_SPAN"] * 3 + ["MATCH", "MISMATCH", "MISMATCH"] + ["MISMATCH", "MATCH", "MISMATCH"]
    assert [tuple(r) for r in counts.collect()] == [("w", 64, 64, 192)]
    assert joined.select(F.spark_partition_id()).distinct().count() > 1


def test_gold_tokens_of_verses_are_joined_by_several_tasks(spark):
    from lexiloom.operators import annotation

    units = spark.createDataFrame([(k, "w", f"w:1.{k}-{k + 1}", f"1.{k}-{k + 1}") for k in range(8)] + [(9, "w", "w\tx", "1.3")], "unit int, work string, group_id string, passage string").coalesce(1)
    tokens = spark.createDataFrame([("w", "1", v, 5, "a\tb", "a", None, "Nom", "", None) for v in range(8)], "work string, chapter string, verse int, idx int, form string, lemma string, upos string, case string, gender string, number string").coalesce(1)
    rows = annotation.gold_rows(annotation.gold_tokens(units, tokens), "unit")
    got = sorted(map(tuple, rows.collect()))
    assert got == sorted([(k, f"w:1.{k}-{k + 1}\t{v}\t5\ta b\ta\t\tNom\t\t") for k in range(8) for v in (k, k + 1) if v < 8] + [(9, "w x\t3\t5\ta b\ta\t\tNom\t\t")])
    assert rows.select("row", F.spark_partition_id().alias("p")).select("p").distinct().count() > 1
