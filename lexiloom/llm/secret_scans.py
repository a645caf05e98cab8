"""Secret scans over a recursive decoding worklist.

The text is the first layer. Each layer is scanned with the three patterns; then its encodings are
undone and the results go on the worklist: percent escapes and Unicode escapes in place (so that a
key word in clear keeps its encoded value beside it), base64 runs, joined across line breaks and read from
all four alignments, as layers of their own (the printable stretches where the bytes are no text), and bytes
with a gzip, zlib, bzip2 or xz head (also those of percent and \\x escapes) decompressed. A layer that was met before (same content, same place in
the text) is not taken again, so cycles end and the worklist reaches a fixpoint. Every layer carries a
map from its characters to code points of the original text, and findings are reported as spans there.

Compressed streams are read to their end, with the members behind them, in windows of bounded memory that
overlap. What cannot be read whole is counted in layers_cut and masked by mask(): broken or unfinished
streams, more than 100 streams within each other, and a single run in a stream (without any blank) of over
`largest` characters or 200 times the input, whichever is more; such a run is still read, but in parts.

Defined cases: null text counts as empty; null ids stay null; repeated rows get their rows; an empty
table gives an empty result; further input columns are not read by the report, and kept by the filter.
"""

from __future__ import annotations

import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, ship

KINDS = ("assign", "access", "hex")
#: The base patterns and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of [0-9a-f]+ is taken whole, so this is the base pattern and its least length in one
LEAST_VALUE, LEAST_ACCESS = 12, 18
WORDS = ("passw", "secret", "token", "api")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"([A-Za-z0-9+/_-]{16,})={0,2}")
LETTERS = re.compile(r"[A-Za-z0-9+/_-]+")
BREAK = re.compile(r"[ \t]*+(?:\r\n?|\n|(?:\\r)?\\n)[ \t]*+")
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{BREAK.pattern}[A-Za-z0-9+/_-]++)+")
URL_SAFE, LEAST_RUN = str.maketrans("-_", "+/"), 16
STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{16,}")
#: Heads of gzip, bzip2, xz and (two bytes with a check sum, no preset dictionary) zlib.
MAGIC = re.compile(rb"\x1f\x8b\x08[\0-\x1f]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\0|" + b"|".join(re.escape(bytes([c, f])) for c in range(0x08, 0x80, 16) for f in range(256) if (256 * c + f) % 31 == 0 and not f & 32))
LEAST_STREAM, DEEPEST, PIECE, WINDOW = 10, 100, 1 << 16, 1 << 20
#: Squeezed as in windows(), no match needs more than OVERLAP characters; RUN_OVERLAP is that through layers of encodings.
OVERLAP, RUN_OVERLAP = 64, 1 << 16
SPACES, CLEAR = re.compile(" {3,}"), re.compile(r"[\t\n\r\x20-\x7e]{16,}")
END = re.compile(r"""(?<=\S)\x20(?=\S)|[^A-Za-z0-9+/_=%\\{}&#;.:"'\s-]""")
PERCENT_RUN, PERCENT_TOKEN = re.compile(r"(?<![!-$&-~])[!-$&-~]*+(?:%[0-9A-Fa-f]{2}[!-$&-~]*+)+"), re.compile(r"%([0-9A-Fa-f]{2})|[!-$&-~]")
HEX_TOKEN = re.compile(r"""\\x([0-9A-Fa-f]{2})|\\[\\'"abfnrtv0]|[\x20!#-&(-\[\]-~]""")
HEX_RUN = re.compile(rf"""[\x20!#-&(-\[\]-~]{{0,10}}\\x[0-9A-Fa-f]{{2}}(?:{HEX_TOKEN.pattern.replace("x([0-9A-Fa-f]{2})", "x[0-9A-Fa-f]{2}")})*+""")
SIMPLE = {rf"\{k}": v for k, v in zip("abfnrtv0", "\a\b\f\n\r\t\v\0", strict=True)}
HEX_CLASS = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, leftmost and not overlapping within a kind; failing matches are dropped."""
    found = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if b"x" * 16 in text.encode("utf-8", "surrogatepass").translate(HEX_CLASS):
        found += [(*m.span(), 2) for m in HEX.finditer(text)]
    return found


class Flat(Sequence):
    """One number many times."""

    def __init__(self, value: int, n: int):
        self.value, self.n = value, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k):
        return Flat(self.value, len(range(self.n)[k])) if isinstance(k, slice) else self.value

    def __iter__(self) -> Iterator[int]:
        return repeat(self.value, self.n)


class Layer:
    """Text with, for each character, the code points [start, end) of the original text that it comes from."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts=None, ends=None):
        self.text = text
        self.starts = range(len(text)) if starts is None else starts
        self.ends = range(1, len(text) + 1) if ends is None else ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        if isinstance(self.starts, Flat):
            return self.starts.value, self.ends.value
        return min(self.starts[start:end]), max(self.ends[start:end])

    def replaced(self, pattern: re.Pattern, decode) -> Layer | None:
        """The layer with every match that `decode` can read put in clear, in place."""
        out, starts, ends, at, changed = [], [], [], 0, False
        for m in pattern.finditer(self.text):
            got = decode(m)
            if got is None:
                continue
            a, b = m.span()
            out.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            for c, x, y in got:
                s, e = self.span(a + x, a + y)
                out.append(c)
                starts.append(s)
                ends.append(e)
            at, changed = b, True
        if not changed:
            return None
        return Layer("".join([*out, self.text[at:]]), [*starts, *self.starts[at:]], [*ends, *self.ends[at:]])


def percent(m: re.Match) -> list[tuple[str, int, int]]:
    """Characters of a run of percent escapes with the places they take in it; broken UTF-8 becomes U+FFFD byte by byte."""
    raw, out, at = bytes.fromhex(m[0].replace("%", "")), [], 0
    while at < len(raw):
        lead = raw[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            c = raw[at : at + n].decode()
        except UnicodeDecodeError:
            c, n = "\ufffd", 1
        out.append((c, 3 * at, 3 * (at + n)))
        at += n
    return out


def escape(m: re.Match) -> list[tuple[str, int, int]] | None:
    code = int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return [(chr(code), 0, len(m[0]))]


def opened(head: bytes):
    """A decompressor for the stream that begins with head, and whether its mark is too long to be met by chance; None if there is none."""
    m = MAGIC.match(head) if len(head) >= LEAST_STREAM else None
    if not m:
        return None
    if head[0] == 0x1F:
        return zlib.decompressobj(31), True
    if m[0] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor(lzma.FORMAT_XZ), True
    return (bz2.BZ2Decompressor(), True) if head[:3] == b"BZh" else (zlib.decompressobj(15), False)


def pieces_of(data: bytes, start: int = 0) -> Iterator[bytes]:
    return (data[k : k + PIECE] for k in range(start, len(data), PIECE))


class Inflated:
    """The content of a compressed stream and of the members right behind it, piece by piece, up to a fault if there is one.

    `used` bytes were read by whole streams, `rest` is what no stream read of the pieces taken, `faulty` tells of a broken or
    unfinished stream, `sure` of a long mark."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.used, self.rest, self.faulty, self.sure = iter(pieces), 0, b"", False, False

    def __iter__(self) -> Iterator[bytes]:
        stream, fed = None, 0
        for piece in self.pieces:
            self.rest += piece
            fed += len(piece)
            while self.rest or not getattr(stream, "needs_input", True):
                if stream is None:
                    if self.used:
                        self.rest = self.rest.lstrip(b"\0")  # padding
                    if len(self.rest) < LEAST_STREAM:
                        break
                    if not (got := opened(self.rest)):
                        return
                    stream, sure = got
                    self.sure |= sure
                again = stream.copy() if hasattr(stream, "copy") else None
                try:
                    out = stream.decompress(self.rest, PIECE)
                except (zlib.error, OSError, lzma.LZMAError, EOFError):
                    self.faulty = True
                    yield from before_fault(again, self.rest)
                    return
                self.rest = stream.unused_data if stream.eof else getattr(stream, "unconsumed_tail", b"")
                if stream.eof:
                    stream, self.used = None, fed - len(self.rest)
                if out:
                    yield out
        if hasattr(stream, "flush"):
            yield stream.flush()
        self.faulty |= stream is not None


def before_fault(stream, data: bytes) -> Iterator[bytes]:
    try:
        for k in range(len(data) if stream else 0):
            yield stream.decompress(data[k : k + 1])
    except zlib.error:
        pass


def windows(pieces: Iterable[bytes], most: int, faults: list) -> Iterator[str]:
    """The text of the pieces in overlapping windows that end where no run goes on. A run of over `most` is read in parts and noted."""
    decoder, text, limit = codecs.getincrementaldecoder("utf-8")("replace"), "", min(WINDOW, most)
    for piece in pieces:
        text += decoder.decode(piece)
        if "   " in text:  # the patterns take any number of spaces, and places within are not reported
            text = SPACES.sub("  ", text)
        while len(text) >= limit:
            end, back = END.search(text[::-1]), OVERLAP
            at = len(text) - 1 - end.start() if end else 0
            if at <= 2 * OVERLAP:
                if limit < most:
                    limit = min(2 * limit, most)
                    continue
                faults.append("run")
                at, back = limit, min(RUN_OVERLAP, limit // 2)
            yield text[:at]
            text, limit = text[at - back :], min(WINDOW, most)
    yield text + decoder.decode(b"", True)


def unpacked(stream: Inflated, most: int, faults: list, seen: frozenset = frozenset(), depth: int = 0) -> Iterator[str]:
    """Windows of the content of a stream and of the streams at its head; content that was met before on the way in ends the way."""
    source, first = iter(stream), b""
    for piece in source:
        first += piece
        if len(first) >= WINDOW:
            break
    whole, mark = len(first) < WINDOW, hashlib.blake2b(first, digest_size=16).digest()
    if whole and mark in seen:
        return
    rest, clear = chain([first], source), False
    if got := opened(first):
        within = Inflated(chain(pieces_of(first), source))
        if depth >= DEEPEST:
            faults.append("depth")
        elif whole or got[1] or next(iter(Inflated([first[:PIECE]])), b""):
            yield from unpacked(within, most, faults, seen | {mark}, depth + 1)
            rest = [first] if whole else chain([within.rest], within.pieces)
    for w in windows(pieces_of(first) if whole else rest, most, faults):
        clear = clear or bool(CLEAR.search(w))
        yield w
    if stream.faulty and (stream.sure or clear):
        faults.append("stream")


def streams(data: bytes, span: Callable[[int], tuple[int, int]], largest: int, unread: set) -> Iterator[Layer]:
    """Layers of the compressed streams in data; span(k) is the place of the bytes from k on. Places of streams not read to their end go to `unread`."""
    at = 0
    while m := MAGIC.search(data, at):
        at = m.start()
        stream, faults, place = Inflated(pieces_of(data, at)), [], span(at)
        for w in unpacked(stream, max(largest, 200 * (len(data) - at)), faults):
            yield Layer(w, Flat(place[0], len(w)), Flat(place[1], len(w)))
        if faults:
            unread.add(place)
        at += max(1, stream.used)


def unwrap(letters: str) -> bytes:
    """Bytes of base64 letters of the common or the URL alphabet, without padding."""
    body = letters[: len(letters) - (len(letters) % 4 == 1)]
    return binascii.a2b_base64(body.translate(URL_SAFE) + "=" * (-len(body) % 4))


def readable(data: bytes) -> list[tuple[int, str]]:
    """(first byte, text): all of data if it is text, else its printable stretches; nothing shorter can hold a secret."""
    if not STRETCH.search(data):
        return []
    try:
        text = data.decode()
    except UnicodeDecodeError:
        text = ""
    if text and sum(map(str.isprintable, text)) + sum(map(text.count, "\t\n\r")) >= 0.95 * len(text):
        return [(0, text)]
    return [(m.start(), m[0].decode()) for m in STRETCH.finditer(data)]


def runs(text: str) -> Iterator[tuple[str, Sequence[int], bool]]:
    """Base64 runs: letters, their places, and whether compressed bytes are read from it. A wrapped block is read as a whole, its lines
    also one by one (they may be values of their own), but then for text only: a line holds no whole stream."""
    blocks = []
    if "\n" in text or "\r" in text or "\\n" in text:
        for m in WRAPPED.finditer(text):
            places = [k for part in LETTERS.finditer(BREAK.sub(lambda x: " " * len(x[0]), m[0])) for k in range(m.start() + part.start(), m.start() + part.end())]
            if len(places) >= LEAST_RUN:
                blocks.append(m.span())
                yield "".join(map(text.__getitem__, places)), places, True
    k = 0
    for m in BASE64.finditer(text):
        a, b = m.span(1)
        while k < len(blocks) and blocks[k][1] <= a:
            k += 1
        yield m[1], range(a, b), not (k < len(blocks) and blocks[k][0] < b)


def escaped_bytes(text: str) -> Iterator[tuple[bytes, list[int], int]]:
    """Bytes of runs of percent and \\x escapes with the characters left in clear between them, the place of each byte, and the run's end."""
    for mark, run, token in (("%", PERCENT_RUN, PERCENT_TOKEN), ("\\x", HEX_RUN, HEX_TOKEN)):
        for m in run.finditer(text) if mark in text else ():
            tokens = list(token.finditer(text, *m.span()))
            yield bytes(int(x[1], 16) if x[1] else ord(SIMPLE.get(x[0], x[0][-1])) for x in tokens), [x.start() for x in tokens], m.end()


def inner(layer: Layer, largest: int, unread: set) -> list[Layer | Iterator[Layer]]:
    """The layers one step inside, and iterators over those that are inflated."""
    text, out = layer.text, []
    for data, places, end in escaped_bytes(text):
        if MAGIC.search(data):
            out.append(streams(data, lambda k, places=places, end=end: layer.span(places[k], end), largest, unread))
    if "%" in text and (x := layer.replaced(PERCENT, percent)):
        out.append(x)
    if ("\\" in text or "&#" in text) and (x := layer.replaced(UNICODE, escape)):
        out.append(x)
    for letters, places, whole in runs(text):
        for shift in range(4):  # what is in front may have joined the run: of its starts, those of equal remainder by 4 give the same bytes
            data, last = unwrap(letters[shift:]), len(letters) - shift
            if whole and MAGIC.search(data):
                out.append(streams(data, lambda k, places=places, shift=shift: layer.span(places[shift + k * 4 // 3], places[-1] + 1), largest, unread))
            for at, clear in readable(data):
                starts, ends = [], []
                for c in clear:  # byte k of the clear text comes from the base64 letters k * 4 // 3 to (k + 1) * 4 / 3
                    n = len(c.encode())
                    s, e = layer.span(places[shift + at * 4 // 3], places[shift + min(-(-(at + n) * 4 // 3), last) - 1] + 1)
                    starts.append(s)
                    ends.append(e)
                    at += n
                out.append(Layer(clear, starts, ends))
    return out


def search(text: str, largest: int) -> tuple[list[tuple[int, int, int]], set[tuple[int, int, int]], int, set[tuple[int, int]]]:
    """Base spans, all spans, layers read, and places of what could not be read to its end."""
    base = sorted(scan(text), key=lambda x: (x[0], x[2], x[1]))
    every, met, unread, layers = set(base), set(), set(), 1
    work: list = inner(Layer(text), largest, unread)
    while work:
        layer = work[-1] if isinstance(work[-1], Iterator) else work.pop()
        if isinstance(layer, Iterator) and (layer := next(layer, None)) is None:
            work.pop()
            continue
        if not layer.text:
            continue
        mark = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), layer.starts[0], layer.ends[-1]
        if mark not in met and layer.text != text:
            met.add(mark)
            layers += 1
            every.update((*layer.span(a, b), kind) for a, b, kind in scan(layer.text))
            work += inner(layer, largest, unread)
    return base, every, layers, unread


def find(text: str, largest: int = 64 << 20) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Base spans, all spans (both sorted by start, kind, end), layers read and places not read to their end."""
    base, every, layers, unread = search(text, largest)
    return base, sorted(every, key=lambda x: (x[0], x[2], x[1])), layers, len(unread)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: int = 64 << 20) -> DataFrame:
    """Per row: id, base counts by kind, base_sha256, all spans joined, and the layers read and cut. Narrow: no shuffle."""
    ship(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for b in batches:
            rows = []
            for t in b.column(1):
                base, every, layers, cut = find(t.as_py() or "", largest)
                rows.append((*([x[2] for x in base].count(k) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest() if base else empty, joined(every), layers, cut))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string() if k in (3, 4) else pa.int64()) for k, c in enumerate(cols))], names=[f.name for f in schema.fields])

    names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "layers_read", "layers_cut")
    schema = T.StructType([field(docs, id_col), *(T.StructField(k, T.StringType() if k in ("base_sha256", "spans") else T.LongType()) for k in names)])
    return docs.select(id_col, text_col).mapInArrow(kernel, schema)


def mask(text: str, by: str = "[secret]") -> str:
    """text with every span, base or unwrapped, replaced, and so is what could not be read to its end; overlapping spans are replaced as one."""
    _, every, _, unread = search(text, 64 << 20)
    spans = sorted({(a, b) for a, b, _ in every} | unread)
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with secrets in text_col masked, null texts left null; count_col, if docs has it, follows the new number of code points."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if (t := x.as_py()) is None else mask(t) for x in b.column(at)]
            yield b.set_column(at, b.schema.field(at).name, pa.array(texts, b.schema.field(at).type))

    masked = docs.mapInArrow(kernel, docs.schema)
    if count_col and count_col in docs.columns:
        masked = masked.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType))
    return masked
