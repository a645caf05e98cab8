"""Nearest neighbours, packing, the n-gram join and the pipeline against brute force."""

import re
import zlib
from array import array
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lexiloom.llm import nearest, packing, shingle_join

from .conftest import CASES, prose


def test_neighbours_reach_the_recall_and_scores_are_exact(spark):
    d = "/root/testdata/sf0.01/embeddings.parquet"
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(d).collect()}
    got = nearest.nearest(spark.read.parquet(d)).collect()
    hits = total = 0
    for q in (i for i in rows if i % 100 == 0):
        near = sorted((float(np.sqrt(np.square(rows[i] - rows[q]).sum())), i) for i in rows if i != q)[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 11)) and [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        for _, i, s in mine:
            assert s == float(np.sqrt(np.square(rows[i] - rows[q]).sum()))
        hits, total = hits + len({i for _, i in near} & {i for _, i, _ in mine}), total + 10
    assert hits >= 0.9 * total


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [inf, 1.0]), (1, [1.0, None]), (2, [1.0, 1.0]), (3, []), (None, [1.0, 0.0]), (4, [1.0, 0.0, 0.0]), (7, [0.0, 1.0]), (8, [0.0, -1.0])]
    rows += [(k, [2.0, 0.0]) for k in range(20, 60)]  # one vector many times
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in nearest.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {0, 100}
    assert got[0][:2] == [(100, 0.0), (2, 1.0)] and [i for i, _ in got[0][2:]] == list(range(20, 28))
    few = nearest.nearest(df.where("vec_id in (0, 2, 7)")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1, 2), (0, 2, 7)]
    assert nearest.nearest(df.limit(0)).count() == 0 and nearest.nearest(df.where("vec_id = 200")).count() == 0


def test_rows_of_one_id_do_not_push_out_neighbours(spark):
    rows = [(0, [1.0, 0.0])] * 12 + [(5, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 5), (0, 2, 6), (0, 3, 7)]


@pytest.mark.parametrize(("kind", "share", "budget"), [("uniform", 0.3, None), ("clustered", 0.1, None), ("clustered", 0.3, 1200)])
def test_recall_on_more_vectors_than_the_sample(spark, kind, share, budget):
    r = np.random.default_rng(5)
    n, dim = 12_000, 24
    x = r.standard_normal((n, dim)) if kind == "uniform" else r.standard_normal((60, dim))[r.integers(0, 60, n)] * 3 + r.standard_normal((n, dim))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = nearest.nearest(df, share=share, budget=budget, sample=2048).groupBy("query_id").agg({"vec_id": "collect_set"}).collect()
    assert len(got) == n // 100
    hits = 0
    for row in got:
        d = np.square(x - x[row[0]]).sum(1)
        d[row[0]] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & set(row[1]))
    assert hits >= 0.9 * 10 * len(got)


def check_packing(rows, wanted, capacity):
    pieces = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr)
    assert pieces == sorted(wanted, key=repr)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in held.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    return len(held)


def cut(texts, capacity):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = []
    for i, x in texts:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        out += [(i, k, s, len(own := ids[s : s + capacity]), zlib.crc32(array("I", own).tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    return out


def test_packing_of_odd_documents(docs, none):
    for capacity in (16, 2048):
        wanted = cut(CASES, capacity)
        n = check_packing(packing.pack_documents(docs, capacity=capacity).collect(), wanted, capacity)
        assert n <= 1.1 * -(-sum(w[3] for w in wanted) // capacity) + 1
    assert packing.pack_documents(none).count() == 0
    ids = {r["doc_id"]: r["input_ids"] for r in packing.pack_documents(docs.where("doc_id = 7"), with_ids=True).collect()}
    assert ids[7] == [*Tokenizer.from_file(P.path("word_bpe_49k.json")).encode("short text", add_special_tokens=False).ids, 0]


def test_packing_is_close_to_the_lower_bound(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = cut([(r["doc_id"], r["text"]) for r in d.collect()], 2048)
    assert check_packing(packing.pack_documents(d).collect(), wanted, 2048) <= 1.01 * -(-sum(w[3] for w in wanted) // 2048)


@pytest.mark.parametrize("seed", range(20))
def test_plans_place_every_length_once(seed):
    r = np.random.default_rng(seed)
    capacity = int(r.choice([8, 64, 500]))
    h = Counter(r.integers(1, capacity + 1, int(r.integers(1, 4000))).tolist())
    p = packing.Plan(dict(h), capacity)
    room, ranks = Counter(), Counter()
    for n, first, count, seq, offset in p.runs:
        assert ranks[n] == first and offset + n <= capacity
        ranks[n] += count
        for k in range(count):
            room[seq + k] += n
    assert ranks == h and max(room.values()) <= capacity and set(room) == set(range(p.sequences))


def brute_components(texts, words, num, den):
    sets = []
    for _, x in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(texts)):
        groups.setdefault(find(k), []).append(k)
    out = []
    for members in groups.values():
        low = min((texts[k][0] for k in members if texts[k][0] is not None), default=None)
        out += [(texts[k][0], len(sets[k]), low) for k in members]
    return out


def edited(text, share, seed):
    r = np.random.default_rng(seed)
    w = text.split()
    for k in r.choice(len(w), max(1, int(share * len(w))), replace=False):
        w[k] = f"new{r.integers(1000)}"
    return " ".join(w)


@pytest.mark.parametrize(("words", "num", "den"), [(4, 85, 100), (5, 80, 100), (1, 60, 100)])
def test_join_equals_brute_force(spark, words, num, den):
    texts = []
    for base, n in enumerate([5, 8, 12, 20, 40, 80, 150, 300, 700]):
        t = prose(100 + base, n)
        for k in range(9):
            texts.append((1000 * base + k, edited(t, 0.004 * k * (1 if n > 40 else 3), k) if k else t))
        texts.append((1000 * base + 500, t.upper()))
        texts.append((1000 * base + 501, t + " tail" * 3))
        texts.append((1000 * base + 502, " ".join(t.split()[1:])))
    texts += CASES
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = shingle_join.jaccard_components(df, words=words, num=num, den=den).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_components(texts, words, num, den), key=repr)


@pytest.mark.parametrize("block", [4, 1024])
def test_large_groups_and_shared_passages_equal_brute_force(spark, block, monkeypatch):
    """Chains of copies that link with their neighbours only, a group around one text, and texts that share a passage: for every round, and for keys that are dealt over blocks."""
    r = np.random.default_rng(11)
    texts, at = [], 0

    def add(t):
        nonlocal at
        at += 1
        texts.append((at, t))

    t = prose(50, 120)
    for k in range(60):
        add(t := edited(t, 0.012, 1000 + k))
    base = prose(51, 150)
    for k in range(60):
        add(edited(base, float(r.uniform(0.005, 0.06)), 2000 + k))
    passage = prose(52, 60)
    for k in range(60):
        add(passage + " " + prose(3000 + k, int(r.integers(5, 40))))
    whole = shingle_join.links
    monkeypatch.setattr(shingle_join, "links", lambda *a, **k: whole(*a, **{**k, "block": block}))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    got = shingle_join.jaccard_components(df, words=4, num=80, den=100).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(texts, 4, 80, 100))


def test_keys_of_linked_sets_meet():
    """The pigeonhole, directly: sets at the threshold share a key, for many sizes."""
    r = np.random.default_rng(3)
    for num, den in ((85, 100), (80, 100)):
        b = shingle_join.Bands(num, den)
        for _ in range(400):
            n = int(r.integers(7, 600))
            x = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            drop = int(r.integers(0, len(x) // 8 + 1))
            y = np.unique(np.concatenate([x[drop:], r.integers(0, 2**63, int(r.integers(0, len(x) // 8 + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if not np.array_equal(x, y) and Fraction(both, len(x) + len(y) - both) >= Fraction(num, den):
                k = shingle_join.keys_of(b, [x, y])
                assert np.intersect1d(*k).size


def test_labels_agree_in_one_task_and_over_tables(spark):
    r = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 400, (300, 2)) if a != b] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, 2000 + k) for k in range(1, 200)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    one, many = (sorted(map(tuple, shingle_join.labels(df, one_task=n).collect())) for n in (10**6, 0))
    assert one == many and dict(one)[1040] == 1000 and dict(one)[2199] == 2000


def test_keep_one_of_each_group(docs, none):
    kept = shingle_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((repr((r["doc_id"], r["text"])) for r in kept.collect()))
    gone = [(2, prose(1, 300)), (2, prose(1, 300)), (8, "short text"), (13, "a b c d")]
    left = list(CASES)
    for g in gone:
        left.remove(g)
    # 3 differs from 1 in case only, which the join folds
    left = [x for x in left if x[0] != 3]
    assert got == sorted(map(repr, left))
    assert shingle_join.keep_one(none).count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as c

    assert [k for k, _ in c.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    now = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, n = now.columns, now.count()
    for _, stage in c.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == columns
    rows = now.collect()
    assert 0.5 * n < len(rows) < n and len({r["doc_id"] for r in rows}) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    packed = c.run(spark, "/root/testdata/sf0.001").collect()
    check_packing(packed, cut([(r["doc_id"], r["text"]) for r in rows], 2048), 2048)


def test_pipeline_equals_plain_versions_of_its_stages(spark):
    import corpus_pipeline as c

    from lexiloom.llm import secret_scans

    from .test_texts import plain_em

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = [i for i, (_, failed, quality) in zip(rows, plain_em(rows.values()), strict=True) if not failed and quality >= 0.5]
    now = c.quality_stage(spark, docs, sf)
    assert sorted(map(tuple, now.collect()), key=repr) == sorted((tuple(r) for r in docs.collect() if r["doc_id"] in set(good)), key=repr)
    one = {low for _, _, low in brute_components([(i, rows[i]) for i in good], 5, 80, 100)}
    now = c.near_duplicate_stage(spark, now, sf)
    assert {r["doc_id"]: r["text"] for r in now.collect()} == {i: rows[i] for i in one}
    masked = {i: secret_scans.mask(rows[i]) for i in one}
    now = c.secrets_stage(spark, now, sf)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in now.collect()} == {i: (x, len(x)) for i, x in masked.items()}
    assert any(x != rows[i] for i, x in masked.items()) and not any(secret_scans.scan(x) for x in masked.values())
    check_packing(c.run(spark, sf).collect(), cut(list(masked.items()), 2048), 2048)
