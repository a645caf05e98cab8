"""Sharding, chat formatting and WARC: laws, exact round trips and brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.llm import chat_formatting as chat
from lexiloom.llm import sharding, warc

from .conftest import CASES


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_feistel_is_a_permutation_with_an_inverse(n, seed):
    f = sharding.Feistel(n, seed)
    image = f.forward(np.arange(n))
    assert sorted(image) == list(range(n)) and (f.inverse(image) == np.arange(n)).all()


def test_shards_obey_their_law(docs, none):
    rows = sharding.assign_shards(docs, shards=8).collect()
    n = len(CASES)
    assert sorted(r["row_number"] for r in rows) == list(range(n))
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in CASES)
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None and sharding.row_of(r["shard"], r["slot"], n) == r["row_number"]
    again = sharding.assign_shards(docs.repartition(7), shards=8).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)
    assert sharding.assign_shards(none).count() == 0


TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "[INST] a \\ b </s>"), (2, 0, "assistant", None), (2, 1, None, "x"), (2, 1, None, "x"), (3, 0, "system", "s"), (3, 2, "assistant", "late"), (3, 1, "user", "<<SYS>>"), (None, 0, "user", ""), (4, None, "tool</s>", "<<END>>"), (5, 0, "user", "no answer"), (6, 0, "user", "[/INST"), (6, 1, "assistant", "z" * 200_000)]


def test_chat_reads_back(spark):
    df = spark.createDataFrame([(*t, 9, "v") for t in TURNS], "conv_id long, turn long, role string, text string, position int, loss string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.chat_segments(df)).collect()}
    by = {}
    for c, t, r, x in sorted(TURNS, key=lambda t: (t[0] or -1, -1 if t[1] is None else t[1], t[2] or "", t[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: (r["valid"], r["first_violation"]) for c, r in got.items()} == {1: (True, None), 2: (False, 0), 3: (True, None), None: (False, None), 4: (False, 0), 5: (False, None), 6: (True, None)}
    whole = chat.chat_segments(df).collect()
    assert sum(len(r["text"]) for r in whole if r["conv_id"] == 1) == got[1]["formatted_chars"]
    assert chat.read_back(chat.chat_segments(df.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "<s>"]), st.text(alphabet="<>/[]\\sINSTYRED| é", max_size=30)), max_size=6))
def test_any_text_survives_the_template(turns):
    f = chat.Formatter(chat.Template())
    out = "".join(s for r, x in turns for s, _ in f.segments(r, x))
    assert f.read(out) == turns
    for r, x in turns:
        assert not any(m in f.escape(x) for m in f.template.markers())


def test_markers_that_cannot_be_told_apart_are_refused():
    with pytest.raises(ValueError):
        chat.Formatter(chat.Template(parts=(("user", chat.Part("aba", "<e>")),)))


PAGES = [(5, "u5", "p" * 150), (3, "u3", "p" * 150), (4, None, "p" * 150), (9, "u9", "q" * 99), (8, "u8", "q" * 99), (1, "u1", None), (2, "u2", ""), (7, "u 7\r\n", "\x1f\x8b\x08 WARC/1.1\r\n" * 50), (None, "un", "p" * 150), (6, "é", "漢" * 40_000)]


def test_archives_give_back_every_record(spark):
    pages = spark.createDataFrame([(*p, "c", 1) for p in PAGES], "page_id long, url string, html string, record_type string, k int").repartition(3)
    want = []
    for i, _, x in PAGES:
        raw = (x or "").encode()
        same = [j for j, _, y in PAGES if y == x and j is not None]
        first = min(same) if len(same) > 1 and len(raw) >= 100 else None
        revisit = first is not None and i != first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    for split in (1, 64, 1000, 1 << 23):  # any split gives every record once
        if split >= 64:
            got = warc.through_archives(pages, split=split).collect()
            assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert warc.through_archives(pages.limit(0)).count() == 0


def test_false_magic_is_not_taken_for_a_record(tmp_path):
    noise = b"\x1f\x8b\x08junk" + zlib.compress(b"x")
    good = [warc.record(str(k), "u", bytes([65 + k]) * 300 + noise, "0" * 64, None) for k in range(5)]
    f = tmp_path / "x.warc.gz"
    f.write_bytes(b"\x1f\x8b\x08\x00" + noise + b"".join(good))
    size = f.stat().st_size
    for split in (1, 7, 50, size):
        found = []
        with open(f, "rb") as h:
            for start in range(0, size, split):
                found += [warc.parsed(m.whole())[0]["X-Row-Key"] for m in warc.starts(h, start, min(start + split, size))]
        assert found == ["0", "1", "2", "3", "4"]


def foreign_record(version: str, kind: str, ident: str, extra: str, block: bytes, newline: str = "\r\n") -> bytes:
    import gzip

    head = newline.join([f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{ident}>", "WARC-Date:2020-01-01T00:00:00Z", *([extra] if extra else []), f"Content-Length: {len(block)}", "", ""])
    return gzip.compress(head.encode() + block + b"\r\n\r\n")


def test_archives_of_other_writers_are_read(spark, tmp_path):
    page = b"<p>" + b"x" * 500
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    parts = [
        foreign_record("1.0", "warcinfo", "a", "", b"software: any\r\n"), foreign_record("1.0", "request", "b", "WARC-Target-URI: http://x/", b"GET / HTTP/1.1\r\n\r\n"),
        foreign_record("1.0", "response", "c", "WARC-Target-URI:\r\n  http://x/\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:ABC", http + page), foreign_record("1.1", "revisit", "d", "WARC-Refers-To: <urn:uuid:c>\r\nContent-Type: application/http", http),
        foreign_record("0.18", "metadata", "e", "", b"k: v", newline="\n"), warc.record("7", "u", b"own", hashlib.sha256(b"own").hexdigest(), None),
    ]
    # Members that look like records at first: no id, no length, a broken line, a version line alone.
    import gzip

    noise = [gzip.compress(x) for x in (b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc", b"WARC/1.0\r\nWARC-Type: x\r\nWARC-Record-ID: y\r\n\r\n", b"WARC/1.1\r\nno colon\r\n\r\n", b"WARC/1.1\r\n", b"text")]
    f = tmp_path / "other.warc.gz"
    f.write_bytes(b"".join(x for k, p in enumerate(parts) for x in (p, noise[k % len(noise)])))
    files = spark.createDataFrame([(str(f), f.stat().st_size)], "path string, bytes long")
    for split in (50, 1 << 20):
        got = warc.read_records(files, split, tasks=4).collect()
        assert sorted((r["record_type"], r["record_id"]) for r in got if not r["row_key"]) == [("metadata", "<urn:uuid:e>"), ("request", "<urn:uuid:b>"), ("response", "<urn:uuid:c>"), ("revisit", "<urn:uuid:d>"), ("warcinfo", "<urn:uuid:a>")]
        assert len(got) == 6
        by = {r["record_id"]: r for r in got}
        c = by["<urn:uuid:c>"]
        assert (c["url"], c["payload_bytes"], c["payload_digest"], c["date"]) == ("http://x/", len(page), hashlib.sha256(page).hexdigest(), "2020-01-01T00:00:00Z")
        assert by["<urn:uuid:d>"]["refers_to_id"] == "<urn:uuid:c>"
        own = warc.read_archives(files, spark.createDataFrame([], "k long").schema["k"].dataType, split, tasks=4).collect()
        assert [tuple(r)[:5] for r in own] == [(7, 3, hashlib.sha256(b"own").hexdigest(), "response", None)]


def test_ids_of_any_kind_read_back(spark):
    pages = spark.createDataFrame([('a"b', "p" * 120), ("ü", "p" * 120), ("12", "q")], "page_id string, html string").withColumn("url", F.lit("u"))
    got = sorted(tuple(r)[:1] + (r["record_type"], r["refers_to"]) for r in warc.through_archives(pages).collect())
    assert got == [("12", "response", None), ('a"b', "response", None), ("ü", "revisit", 'a"b')]
