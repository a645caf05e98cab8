"""Every query of the catalogue against its SQL, on the smallest driver tables; and the driver's contract."""

import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lexiloom.plans import building, catalogue, corpus, parsing  # noqa: F401 (the others register their queries in the catalogue)

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver tables are not here")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return plain(v.item()) if hasattr(v, "item") else v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, wanted = catalogue.queries()[name](spark, str(DATA)).toPandas(), duck.execute(catalogue.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


def test_entry_runs_without_the_llm_subpackage(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_tiers_against_difflib(spark):
    """The three tiers by plain loops: the first that has a partner wins, ties go as the reference's lookups do."""
    from collections import Counter
    from difflib import SequenceMatcher

    drop, nasal = set("aāiīuūṛṝḷḹeoḥyv"), str.maketrans("ṅñṇnṃ", "mmmmm")
    left, right = (s.collect() for s in corpus._sides(spark, str(DATA)))
    keys, times = {}, Counter(r["right_key"] for r in right)
    for r in sorted(right, key=lambda r: r["right_id"]):
        keys.setdefault(r["right_key"], r["right_id"])
    keys.pop("", None)

    def bones(k):
        return "".join(c for c in k.translate(nasal) if c not in drop)

    by_bones, by_head = {}, {}
    for k in keys:
        by_bones.setdefault(bones(k), []).append(k)
        by_head.setdefault(k[:10], []).append(k)
    known, wanted = {}, set()
    for r in left:
        key = r["left_key"]
        if key and key not in known:
            found = ("exact", 1.0, key) if key in keys else None
            if not found and (near := [(SequenceMatcher(None, key, k).ratio(), -keys[k], k) for k in by_bones.get(bones(key), [])]) and max(near)[0] >= 0.7:
                found = ("sandhi", max(near)[0], max(near)[2])
            if not found and (near := [(SequenceMatcher(None, key, k).ratio(), k) for k in by_head.get(key[:10], [])]) and max(near)[0] >= 0.9:
                found = ("fuzzy", *max(near))
            known[key] = found
        if key and known[key]:
            tier, score, k = known[key]
            wanted.add((r["left_id"], keys[k], tier, round(score, 9), times[k]))
    got = [tuple(r) for q in ("tiered_match_exact_skeleton", "tiered_match_fuzzy") for r in catalogue.queries()[q](spark, str(DATA)).collect()]
    assert {(a, b, t, round(s, 9), n) for a, b, t, s, n in got} == wanted and len(got) == len(wanted)
    assert any(t == "exact" for _, _, t, _, _ in got)


def test_phrases_against_a_plain_scan(spark):
    phrases = sorted(["Licensed under the Apache License", "of the", "the", "password", "token", "pour le", "der ein", "que le"], key=len, reverse=True)
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    wanted = []
    for i, text in docs:
        at = 0
        while at < len(text):
            hit = next((p for p in phrases if text.startswith(p, at)), None)
            if hit:
                wanted.append((i, hit, at))
            at += len(hit) if hit else 1
    assert sorted(map(tuple, catalogue.phrase_automaton(spark, str(DATA)).collect())) == sorted(wanted)


def test_endnote_starts_of_all_rows_against_a_fold(spark):
    rows, wanted, last = duckdb.sql(f"SELECT l_suppkey, l_quantity::BIGINT FROM '{DATA}/lineitem.parquet' ORDER BY l_suppkey, l_orderkey, l_linenumber, l_extendedprice").fetchall(), {}, {}
    at = dict.fromkeys((g for g, _ in rows), 0)
    for g, number in rows:
        at[g] += 1
        wanted.setdefault(g, [])
        if last.get(g, 0) < number <= last.get(g, 0) + 8:
            last[g] = number
            wanted[g].append(str(at[g]))
    got = dict(map(tuple, catalogue.queries()["endnote_starts"](spark, str(DATA)).collect()))
    assert got == {g: ",".join(x) for g, x in wanted.items()}


def test_streamed_windows_stay_in_files(spark, tmp_path):
    """The result is read from files, not held by the driver; the events may be a file or a folder of files."""
    spark.read.parquet(str(DATA / "events.parquet")).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    batch = sorted(map(tuple, catalogue.queries()["rate_limit_windows"](spark, str(DATA)).collect()))
    for d in (DATA, tmp_path):
        got = catalogue.queries()["rate_limit_windows_stream"](spark, str(d))
        assert got.inputFiles() and sorted(map(tuple, got.collect())) == batch
