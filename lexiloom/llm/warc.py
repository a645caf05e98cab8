"""WARC archives: a writer with revisit records and a reader that can split files anywhere.

Writing: records with equal payloads of at least `least` bytes are stored once; the smallest id is the
response and the others are revisits that name it. Each task writes one file of gzip members, a record
each, under a name of its own attempt; only the files that finished tasks report are read, so retries
leave no half records behind.

Reading: every file is cut into byte ranges. A task looks for the gzip magic in its range, decodes each
candidate member up to the end of its headers and takes it for a record only if these are whole: a version
line (any version), lines of name and value, and among them a type, an id and a length. It owns the records
that start inside its range, reading past its end to finish the last one. Archives of other writers are read
too, with all their kinds of records; read_archives keeps those that carry a key of this writer.

Files are reached through the local file system or any store that pyarrow.fs knows.

Defined cases: null payload counts as empty; null ids are never chosen as the response of others and a
payload that only null ids have is all responses; rows repeated with the smallest id are responses
each; an empty table gives an empty result; further input columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, new_folder, salted_join, ship

LEAST_PAYLOAD = 100
MAGIC = b"\x1f\x8b\x08"
HEAD = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
#: What a record begins with in any version of the format, the headers that every record has, and how long they may be.
VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r?\n")
NEEDED, LONGEST_HEAD = ("warc-type", "warc-record-id", "content-length"), 1 << 20


def opened(uri: str, mode: str):
    """A binary file in a store."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        path = unquote(parts.path) if parts.scheme else uri
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)  # noqa: SIM115
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        store.create_dir(path.rpartition("/")[0])
        return store.open_output_stream(path, compression=None)
    return store.open_input_file(path)


def member(headers: list[tuple[str, str]], block: bytes, level: int = 1) -> bytes:
    """One record as a gzip member."""
    head = HEAD + b"".join(f"{k}: {v}\r\n".encode() for k, v in [*headers, ("Content-Length", str(len(block)))]) + b"\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(head + block + END) + pack.flush()


def record(key: str, url: str, payload: bytes, digest: str, original: str | None, level: int = 1) -> bytes:
    """A response, or a revisit if original names the record that has the payload. Keys are JSON, so any id reads back."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    clean = " ".join(url.split())
    headers = [("WARC-Type", "revisit" if original else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("X-Row-Key", key)]
    if original:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Key", original)]
    return member(headers, http if original else http + payload, level)


def plan(pages: DataFrame, id_col: str, payload_col: str, url_col: str, least: int, salts: int = 16, most_broadcast: int = 100_000) -> DataFrame:
    """(k, u, p, d, o): key, url, payload, digest, and for revisits the smallest id of an equal payload.

    Ids by digest come from a combining aggregate over digests alone, so copies fold before they are
    shuffled. The table of repeated digests is counted: within `most_broadcast` rows it is broadcast and
    payloads are not shuffled; beyond it the join shuffles, with the rows of a digest spread over salts."""
    raw = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    base = pages.select(F.col(id_col).alias("k"), F.col(url_col).alias("u"), raw.alias("p")).withColumn("d", F.sha2("p", 256))
    repeated = materialize(base.where(F.octet_length("p") >= least).groupBy("d").agg(F.min("k").alias("o"), F.count("*").alias("n")).where("n > 1 and o is not null").select("d", "o"), "warc-repeated")
    joined = base.join(F.broadcast(repeated), "d", "left") if repeated.count() <= most_broadcast else salted_join(base, repeated, "d", "left", salts)
    return joined.select("k", "u", "p", "d", F.when(F.col("k") == F.col("o"), F.lit(None)).otherwise(F.col("o")).alias("o"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least: int = LEAST_PAYLOAD, level: int = 1) -> DataFrame:
    """Write one archive a task; returns (path, bytes, records) of the files, made when it is computed, so materialise it once."""
    ship(pages.sparkSession)
    rows = plan(pages, id_col, payload_col, url_col, least)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, at, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for b in batches:
            for k, u, p, d, o in zip(*(b.column(i) for i in range(5)), strict=True):
                if out is None:
                    out = opened(path, "wb")
                data = record(json.dumps(k.as_py(), default=str), u.as_py() or "", p.as_py(), d.as_py(), None if o.as_py() is None else json.dumps(o.as_py(), default=str), level)
                out.write(data)
                at, n = at + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at], pa.int64()), pa.array([n], pa.int64())], names=["path", "bytes", "records"])

    return rows.mapInArrow(kernel, "path string, bytes long, records long")


def ranges(files: DataFrame, split: int) -> DataFrame:
    """(path, start, end) ranges of at most `split` bytes."""
    return files.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"), "bytes").select("path", "start", F.least(F.col("start") + split, F.col("bytes")).alias("end"))


class Member:
    """Decodes one gzip member from a position, reading on in steps."""

    def __init__(self, f, at: int, step: int = 1 << 16):
        self.f, self.first, self.at, self.step, self.make = f, at, at, step, zlib.decompressobj(31)
        self.out = bytearray()

    def more(self) -> bool:
        """Decode another step; False at the member's or the file's end, or if this is no gzip data."""
        if self.make.eof:
            return False
        self.f.seek(self.at)
        data = self.f.read(self.step)
        if not data:
            return False
        try:
            self.out += self.make.decompress(data)
        except zlib.error:
            return False
        self.at += len(data) - len(self.make.unused_data)
        return True

    def is_record(self) -> bool:
        """Whether the member begins with whole headers of a record; decodes no more than it takes to tell."""
        while not VERSION.match(self.out):
            if len(self.out) > 20 or not self.more():
                return False
        end = -1
        while (end := head_end(self.out)) < 0:
            if len(self.out) > LONGEST_HEAD or not self.more():
                return False
        headers = headers_of(bytes(self.out[:end]))
        return headers is not None and all(headers.get(k) for k in NEEDED) and headers["content-length"].isdigit()

    def whole(self) -> bytes:
        while self.more():
            pass
        if not self.make.eof:
            raise OSError("a record is cut off")
        return bytes(self.out)


def starts(f, start: int, end: int, window: int = 1 << 20) -> Iterator[Member]:
    """Members whose magic starts in [start, end) and whose head decodes to a WARC record."""
    at = start
    while at < end:
        f.seek(at)
        data = f.read(min(window, end - at) + len(MAGIC) - 1)
        hit = data.find(MAGIC)
        if hit < 0 or at + hit >= end:
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        found = Member(f, at + hit)
        if found.is_record():
            yield found
            at = found.at
        else:
            at += hit + 1


def head_end(data: bytes | bytearray) -> int:
    """Where the blank line after the headers ends; -1 if there is none yet."""
    found = [at + len(mark) for mark in (END, b"\n\n") if (at := data.find(mark)) >= 0]
    return min(found, default=-1)


class Headers(dict):
    """Headers by name, in whatever case it is written."""

    def __setitem__(self, name: str, value: str) -> None:
        super().__setitem__(name.lower(), value)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def __contains__(self, name: object) -> bool:
        return super().__contains__(str(name).lower())

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)


def headers_of(head: bytes) -> Headers | None:
    """Headers by name; a line that begins with a blank continues the one before. None if a line is neither."""
    out = Headers()
    name = None
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").rstrip("\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] = f"{out[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            return None
        out[name] = value.strip()
    return out


def parsed(data: bytes) -> tuple[Headers, bytes]:
    end = head_end(data)
    headers = headers_of(data[:end])
    return headers, data[end : end + int(headers["content-length"])]


#: What is read of any record. payload_digest is of the payload as it stands here; for revisits it is what the record says, as hexadecimal SHA-256.
RECORD = "path string, offset long, record_type string, record_id string, url string, date string, content_type string, refers_to_id string, block_bytes long, payload_bytes long, payload_digest string, row_key string, refers_to_key string"


def described(path: str, offset: int, data: bytes) -> tuple:
    headers, block = parsed(data)
    kind, content = headers["warc-type"].lower(), headers.get("content-type", "")
    if len(block) != int(headers["content-length"]):
        raise OSError(f"the record {headers['warc-record-id']} is cut off")
    said = headers.get("warc-payload-digest", "")
    digest = said.partition(":")[2].lower() if said.lower().startswith("sha256:") else None
    body = block
    if content.lower().startswith("application/http"):
        end = head_end(block)
        body = block[end:] if end >= 0 else b""
    if kind == "revisit":
        own = headers_of(block[: head_end(block)]) if head_end(block) >= 0 else None
        size = int(own["content-length"]) if own and own.get("content-length", "").isdigit() else None
    else:
        size, found = len(body), hashlib.sha256(body).hexdigest()
        if digest and "x-row-key" in headers and found != digest:
            raise OSError(f"the payload of {headers['warc-record-id']} is damaged")
        digest = found
    return path, offset, kind, headers["warc-record-id"], headers.get("warc-target-uri"), headers.get("warc-date"), content or None, headers.get("warc-refers-to"), len(block), size, digest, headers.get("x-row-key"), headers.get("x-refers-to-key")


def read_records(files: DataFrame, split: int = 8 << 20, tasks: int | None = None) -> DataFrame:
    """Every record of archives (path, bytes) of any writer, in the columns of RECORD; a record that is cut off or damaged stops the read."""
    spark = files.sparkSession
    ship(spark)
    splits = ranges(files, split).repartition(tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields]
        for b in batches:
            for path, start, end in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                with opened(path, "rb") as f:
                    rows = []
                    for m in starts(f, start, end):
                        rows.append(described(path, m.first, m.whole()))
                        if len(rows) == 1000:
                            yield batch(rows, kinds)
                            rows = []
                    if rows:
                        yield batch(rows, kinds)

    def batch(rows: list[tuple], kinds: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    schema = T.StructType.fromDDL(RECORD)
    return splits.mapInArrow(kernel, schema)


def read_archives(files: DataFrame, id_type: T.DataType, split: int = 8 << 20, tasks: int | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of the records that this writer made; payload digests of responses are recomputed and checked."""
    records = read_records(files, split, tasks).where("row_key is not null")

    def key(name: str):
        # A key is JSON: a number, true or false as it stands, else a string in quotes.
        text = F.when(F.col(name).startswith('"'), F.from_json(F.concat(F.lit('{"k":'), name, F.lit("}")), "k string")["k"]).otherwise(F.when(F.col(name) != "null", F.col(name)))
        return text.cast(id_type)

    return records.select(key("row_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key("refers_to_key").alias("refers_to"), "url")


def through_archives(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least: int = LEAST_PAYLOAD, split: int = 8 << 20) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    files = materialize(write_archives(pages, new_folder(pages.sparkSession, "warc"), id_col, payload_col, url_col, least), "warc-files")
    back = read_archives(files, pages.schema[id_col].dataType, split)
    return back.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
