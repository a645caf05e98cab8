"""SentencePiece encoding and decoding that keeps offsets.

Normalisation walks the text by longest prefix through the compiled character map (a double-array
trie) and records for every byte it writes the source byte that it came from. Pieces are then made by
best-score pair merging over a linked list with a heap, bytes stand in for unknown characters, and
each piece is projected through the recorded alignment to a span of the original bytes.

Encoding works on chunks that no piece of the vocabulary can cross, so equal chunks are merged once;
where a vocabulary allows no such cut, the chunk is the whole text.

Defined cases: null and empty texts give the end id alone and decode to the empty string; null ids stay
null; repeated rows each get their row; an empty table gives an empty result; further columns are not
read. Memory is linear in the longest text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Memo, field, ship, tokenizer_path

SPACE = "▁"
#: Types of pieces in the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def wire(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protocol-buffer message; values are ints, bytes or 4-byte strings."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            at, value, shift = at + 1, value | (b & 0x7F) << shift, shift + 7
            if b < 0x80:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            if tag & 7 == 2:
                n, at = varint(at)
            else:
                n = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class CharacterMap:
    """Longest-prefix replacement by a compiled character map; an empty map changes nothing."""

    def __init__(self, blob: bytes):
        self.units, self.texts = (), b""
        if blob:
            n = int.from_bytes(blob[:4], "little")
            self.units = struct.unpack(f"<{n // 4}I", blob[4 : 4 + n])
            self.texts = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """(length, place of the replacement) of the longest key that data has at the byte `at`."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        return found

    def steps(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(start, end, replacement) over all of data; a character without an entry stands for itself."""
        at = 0
        while at < len(data):
            hit = self.longest(data, at) if self.units else None
            if hit:
                n, place = hit
                yield at, at + n, self.texts[place : self.texts.index(b"\0", place)]
            else:
                lead = data[at]
                n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                yield at, at + n, data[at : at + n]
            at += n


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(wire(f.read()))
        self.pieces: list[tuple[str, float, int]] = []
        for number, value in parts:
            if number == 1:
                x = dict(wire(value))
                self.pieces.append((x.get(1, b"").decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
        trainer = dict(wire(next(v for k, v in parts if k == 2)))
        norm = dict(wire(next((v for k, v in parts if k == 3), b"")))
        if trainer.get(3) != 2:
            raise ValueError("only BPE models are read here")
        self.map = CharacterMap(norm.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        self.byte_ids = {int(s[3:5], 16): i for i, (s, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.unknown_surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.end = next(i for i, p in enumerate(self.pieces) if p[0] == trainer.get(47, b"</s>").decode())
        if any(p[2] == USER_DEFINED for p in self.pieces):
            raise ValueError("user-defined pieces are not supported")
        usable = [(s, -score, i) for i, (s, score, kind) in enumerate(self.pieces) if kind in (NORMAL, UNUSED)]
        order = {score: r for r, score in enumerate(sorted({x[1] for x in usable}))}
        self.rank = {s: order[score] for s, score, _ in usable}
        self.ids = {s: i for s, _, i in usable}
        self.unused = {i for i, p in enumerate(self.pieces) if p[2] == UNUSED}
        if self.unused:
            raise ValueError("unused pieces are not supported")
        self.cut = self.cutter(s for s, _, _ in usable if len(s) > 1)
        self.surface = [b"" if kind == CONTROL else self.unknown_surface.encode() if kind == UNKNOWN else bytes([int(s[3:5], 16)]) if kind == BYTE else s.replace(SPACE, " ").encode() for s, _, kind in self.pieces]
        self.memo = Memo(self.chunk, most=256 << 20)

    @staticmethod
    def cutter(pieces) -> re.Pattern | None:
        """Chunks are spaces with the letters, or the other characters, that follow them, and single line feeds.
        Valid if every piece is found whole within one chunk; checked on the vocabulary, else coarser or no cuts."""
        pieces = list(pieces)
        for pattern in (f"{SPACE}*[^\\W\\d_²³¹¼½¾]+|{SPACE}*(?:[\\W\\d_²³¹¼½¾](?<![{SPACE}\\n]))+|{SPACE}+|\\n", f"{SPACE}*[^{SPACE}]+|{SPACE}+"):
            cut = re.compile(pattern)
            if all(cut.fullmatch(s) for s in pieces) and not any(SPACE in s.lstrip(SPACE) for s in pieces):
                return cut
        return None

    # -- normalisation ------------------------------------------------------------------------------

    def normalize(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised text, and for each of its characters, and for its end, the source byte where it starts;
        None stands for the plain case in which only blanks are escaped and one is put in front."""
        if not self.map.units and not self.squeeze:
            return ((SPACE if self.dummy and text else "") + text.replace(" ", SPACE) if self.escape else (" " if self.dummy and text else "") + text), None
        data, blank = text.encode(), SPACE if self.escape else " "
        out: list[str] = []
        where: list[int] = []
        steps = list(self.map.steps(data))
        first = 0
        while self.squeeze and first < len(steps) and steps[first][2] == b" ":
            first += 1
        if first == len(steps):
            return "", [len(data)]
        if self.dummy:
            out.append(blank)
            where.append(steps[first][0])
        after_blank, end = self.squeeze, len(data)
        for start, stop, written in steps[first:]:
            if after_blank:
                written = written.lstrip(b" ")
            for c in written.decode():
                out.append(blank if c == " " else c)
                where.append(start)
            if written:
                after_blank = self.squeeze and written.endswith(b" ")
            end = stop
        while self.squeeze and out and out[-1] == blank:
            out.pop()
            end = where.pop()
        return "".join(out), [*where, end]

    # -- merging ------------------------------------------------------------------------------------

    def merge(self, chunk: str) -> list[str]:
        """Symbols of a chunk: repeatedly the adjacent pair whose joined piece has the best score, leftmost first."""
        symbols: list[str] = list(chunk)
        n, rank_of = len(symbols), self.rank.get
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, 2) for i in range(n - 1) if (rank := rank_of(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = following[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] = joined = symbols[i] + symbols[j]
            symbols[j] = ""
            following[i] = k = following[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(joined + symbols[k])) is not None:
                    heapq.heappush(heap, (rank, i, size + len(symbols[k])))
            if (h := before[i]) >= 0 and (rank := rank_of(symbols[h] + joined)) is not None:
                heapq.heappush(heap, (rank, h, size + len(symbols[h])))
        return [s for s in symbols if s]

    def units(self, chunk: str) -> list[tuple[int, int]]:
        """(id, characters of the chunk it takes); of byte ids, the first takes the character and the others none."""
        found = []
        for s in self.merge(chunk):
            if s in self.ids:
                found.append((self.ids[s], len(s)))
            elif self.byte_ids:
                found += [(self.byte_ids[b], len(s) * (k == 0)) for k, b in enumerate(s.encode())]
            else:
                found.append((self.unknown, len(s)))
        return found

    def chunk(self, chunk: str) -> tuple[str, int, bytes, int, bytes]:
        """Of a chunk: decimal ids joined, their number, its decoded bytes, and for the plain case its source bytes and its pieces' spans in them."""
        units, spans, at, last = self.units(chunk), [], 0, (0, 0)
        place = range(len(chunk) + 1) if chunk.replace(SPACE, "").isascii() else [0, *accumulate(1 if c < "\x80" or c == SPACE else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4 for c in chunk)]
        for _, n in units:
            if n:
                last = place[at], place[at + n]
            spans += last
            at += n
        ids = [i for i, _ in units]
        return " ".join(map(str, ids)), len(ids), b"".join(map(self.surface.__getitem__, ids)), place[-1], array("i", spans).tobytes()

    def chunks(self, normal: str) -> list[str]:
        return self.cut.findall(normal) if self.cut else [normal] if normal else []

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of every piece; start and end are bytes of the original text. Pieces of one source character share its span."""
        normal, where = self.normalize(text)
        if where is None:
            where, at = [], 0
            plain = normal if not (self.dummy and text) else normal[1:]
            if self.dummy and text:
                where.append(0)
            for c, o in zip(plain, text, strict=True):
                where.append(at)
                at += len(o.encode())
            where.append(at)
        out, at, last = [], 0, (0, 0)
        for c in self.chunks(normal):
            for i, n in self.units(c):
                if n:
                    last = where[at], where[at + n]
                out.append((i, *last))
                at += n
        return out

    def digest(self, text: str) -> tuple[int, str, str, int, str]:
        """Number of ids with the end id, digests of the ids and of the decoded text, the source bytes that the spans of the pieces cover,
        and a digest of these spans, each start and end as eight bytes with the lowest first, the end id's last."""
        normal, where = self.normalize(text)
        got = [self.memo[c] for c in self.chunks(normal)]
        ids = " ".join([*(g[0] for g in got), str(self.end)])
        decoded = self.strip(b"".join(g[2] for g in got), normal.startswith(SPACE))
        spans = self.spans(text, got if where is None and SPACE not in text else None)
        ends = np.maximum.accumulate(spans[:, 1])
        covered = int(np.maximum(ends - np.maximum(spans[:, 0], np.concatenate([[0], ends[:-1]])), 0).sum())
        return len(spans), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest(), covered, hashlib.sha256(spans.tobytes()).hexdigest()

    def spans(self, text: str, got: list | None) -> np.ndarray:
        """Start and end in the source of every piece and of the end id: of memoised chunks in the plain case, else through the recorded alignment."""
        if got is None:
            found = np.array([(a, b) for _, a, b in self.encode(text)], "<i8").reshape(-1, 2)
        else:
            size, n = np.array([g[3] for g in got], np.int64), np.array([g[1] for g in got], np.int64)
            first = np.cumsum(size) - size - bool(self.dummy and text)  # the blank put in front takes no source byte
            found = np.frombuffer(b"".join([g[4] for g in got]), np.int32).reshape(-1, 2) + np.repeat(first, n)[:, None]
            np.maximum(found[:1], 0, out=found[:1])
        out = np.empty((len(found) + 1, 2), "<i8")
        out[:-1], out[-1] = found, len(text.encode())
        return out

    # -- decoding -----------------------------------------------------------------------------------

    def strip(self, data: bytes, starts_blank: bool) -> bytes:
        """The blank put in front goes; with squeezing, all leading ones."""
        if starts_blank and (self.dummy or self.squeeze):
            return data.lstrip(b" ") if self.squeeze else data[1:]
        return data

    def decode(self, ids: list[int]) -> str:
        spoken = [i for i in ids if self.pieces[i][2] != CONTROL]
        data = b"".join(map(self.surface.__getitem__, spoken))
        return self.strip(data, bool(spoken) and self.pieces[spoken[0]][0].startswith(SPACE)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def piece_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, spans: bool = False) -> DataFrame:
    """One row per document: id, n_tokens with the end id, ids_sha256, decoded_sha256, the original bytes that the pieces span, and with
    `spans` also spans_sha256, of every piece's start and end in the original bytes. Narrow."""
    ship(docs.sparkSession)
    path = model or tokenizer_path("piece_bpe_32k.model")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        e.memo.alone()
        digest = e.digest
        for b in batches:
            rows = [digest(t.as_py() or "") for t in b.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kind) for c, kind in list(zip(cols, kinds, strict=True))[: len(names)])], names=[f.name for f in schema.fields])

    kinds = pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()
    names = ("n_tokens", "ids_sha256", "decoded_sha256", "spanned_bytes", *(["spans_sha256"] if spans else []))
    schema = T.StructType([field(docs, id_col), *(T.StructField(k, T.StringType() if k.endswith("sha256") else T.LongType()) for k in names)])
    return docs.select(id_col, text_col).mapInArrow(kernel, schema)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """The operator's full output: one row per document with the array of (id, start, end) over original bytes, the end id last."""
    ship(docs.sparkSession)
    path = model or tokenizer_path("piece_bpe_32k.model")
    kind = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                n = len(text.encode())
                rows.append([{"id": i, "start": s, "end": x} for i, s, x in [*e.encode(text), (e.end, n, n)]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=[id_col, "pieces"])

    piece = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(kernel, T.StructType([field(docs, id_col), T.StructField("pieces", T.ArrayType(piece))]))
