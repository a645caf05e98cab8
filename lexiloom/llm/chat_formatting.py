"""Chat formatting: a finite-state machine over roles and a declarative template with loss flags.

Turns of a conversation, in order, become text segments: markers carry no loss, the text of roles
that the template trains on does. Control strings inside texts are escaped reversibly, so the output
reads back to the same roles and texts. The machine validates the order of turns; a conversation that
breaks it is still formatted whole, and its first violation is reported.

Turns are brought together by one shuffle on the conversation and sorted within partitions; formatting
and reading stream over the sorted rows with the state of one conversation, so a conversation of any
length needs no more memory than its longest turn.

Defined cases: null text and null role count as empty; null turns sort first; turns with one number are
all kept, ordered by role and text; a null conversation id is a conversation of its own; an empty table
gives an empty result; further input columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, ship

ESCAPE = "\\"


@dataclass(frozen=True)
class Part:
    """Markers around the text of a role, and whether the text is trained on."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles with their parts; other roles are written with their name between `other` and `named`, ended by other_end."""

    parts: tuple[tuple[str, Part], ...] = (("system", Part("<<SYS>>", "<</SYS>>")), ("user", Part("[INST]", "[/INST]")), ("assistant", Part("<s>", "</s>", loss=True)))
    other: str = "<<ROLE>>"
    named: str = "<</ROLE>>"
    other_end: str = "<<END>>"
    #: state: {role: next state}; anything else is a violation, after which the machine goes on from the role.
    moves: tuple[tuple[str, tuple[tuple[str, str], ...]], ...] = (
        ("start", (("system", "system"), ("user", "user"))),
        ("system", (("user", "user"),)),
        ("user", (("assistant", "assistant"),)),
        ("assistant", (("user", "user"),)),
    )
    final: tuple[str, ...] = ("assistant",)

    def markers(self) -> list[str]:
        return [*(m for _, p in self.parts for m in (p.before, p.after)), self.other, self.named, self.other_end]


class Formatter:
    def __init__(self, template: Template):
        self.template, self.parts, self.moves = template, dict(template.parts), {k: dict(v) for k, v in template.moves}
        marks = template.markers()
        for m in marks:  # else the end of a text and a marker could look like an earlier marker
            if len(m) < 2 or ESCAPE in m or any(m.endswith(m[:k]) for k in range(1, len(m))) or sum(m in x for x in marks) > 1:
                raise ValueError(f"marker {m!r} can't be told apart")
        self.control = re.compile("|".join(map(re.escape, [*marks, ESCAPE])))
        self.opening = {p.before: r for r, p in self.parts.items()}
        self.start = re.compile("|".join(map(re.escape, [*self.opening, template.other])))

    def escape(self, text: str) -> str:
        """The escape character doubles; a control string gets one behind its first character."""
        return self.control.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text) if ESCAPE in text else text

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of a turn; empty segments are left out."""
        p = self.parts.get(role)
        found = [(p.before, False), (self.escape(text), p.loss), (p.after, False)] if p else [(self.template.other + self.escape(role) + self.template.named, False), (self.escape(text), False), (self.template.other_end, False)]
        return [x for x in found if x[0]]

    def move(self, state: str, role: str) -> tuple[str, bool]:
        """The next state and whether the move is allowed."""
        to = self.moves.get(state, {}).get(role)
        return (to, True) if to else (role if role in self.parts else "other", False)

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """Roles and texts of formatted turns."""
        out, at = [], 0
        while at < len(formatted):
            m = self.start.match(formatted, at)
            if not m:
                raise ValueError(f"no turn starts at {at}")
            at = m.end()
            if role := self.opening.get(m[0]):
                end = self.parts[role].after
            else:
                stop = formatted.index(self.template.named, at)
                role, end, at = self.unescape(formatted[at:stop]), self.template.other_end, stop + len(self.template.named)
            stop = formatted.index(end, at)
            out.append((role, self.unescape(formatted[at:stop])))
            at = stop + len(end)
        return out


SEGMENT_COLUMNS = (("position", T.LongType()), ("segment", T.IntegerType()), ("text", T.StringType()), ("loss", T.BooleanType()), ("role_ok", T.BooleanType()), ("closed_ok", T.BooleanType()))


def chat_segments(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:  # noqa: B008
    """Rows (conversation, position of the turn from 0, segment of the turn, text, loss, role_ok, closed_ok), in order within partitions.

    role_ok: the machine allows the turn; closed_ok: a conversation may end after it."""
    ship(turns.sparkSession)
    picked = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.coalesce(role_col, F.lit("")).alias("r"), F.coalesce(text_col, F.lit("")).alias("x"))
    ordered = picked.repartition("c").sortWithinPartitions("c", "t", "r", "x")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fmt, last, state, position = Formatter(template), object(), "start", 0
        for b in batches:
            rows = []
            for c, r, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if c != last:
                    last, state, position = c, "start", 0
                state, ok = fmt.move(state, r)
                rows += [(c, position, k, s, loss, ok, state in template.final) for k, (s, loss) in enumerate(fmt.segments(r, x))]
                position += 1
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [b.schema.field(0).type, pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names=names)

    names = [conv_col, *(k for k, _ in SEGMENT_COLUMNS)]
    return ordered.mapInArrow(kernel, T.StructType([field(turns, conv_col), *(T.StructField(k, t) for k, t in SEGMENT_COLUMNS)]))


class Reading:
    """What is read back of one conversation, turn by turn."""

    def __init__(self, conv):
        self.conv, self.n, self.turns, self.loss = conv, 0, hashlib.sha256(), hashlib.sha256()
        self.loss_chars = self.formatted = 0
        self.violation, self.closed = None, False

    def take(self, fmt: Formatter, texts: list[tuple[str, bool]], role_ok: bool, closed: bool) -> None:
        whole = "".join(t for t, _ in texts)
        for role, text in fmt.read(whole):
            self.turns.update(f"{role}\n{text}\n".encode())
        for t, loss in texts:
            if loss:
                clear = fmt.unescape(t)
                self.loss.update(clear.encode())
                self.loss_chars += len(clear)
        self.formatted += len(whole)
        if not role_ok and self.violation is None:
            self.violation = self.n
        self.n, self.closed = self.n + 1, closed

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted, self.violation is None and self.closed, self.violation


def read_back(segments: DataFrame, template: Template = Template(), conv_col: str = "conv_id") -> DataFrame:  # noqa: B008
    """Per conversation, from its segments in order: n_turns, digests, sizes, valid and the first violation. Narrow over chat_segments' order."""
    ship(segments.sparkSession)
    long, text = T.LongType(), T.StringType()
    schema = T.StructType([field(segments, conv_col), *(T.StructField(k, t) for k, t in (("n_turns", long), ("turns_sha256", text), ("loss_chars", long), ("loss_sha256", text), ("formatted_chars", long), ("valid", T.BooleanType()), ("first_violation", long)))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fmt, kind = Formatter(template), None
        now, place, texts, flags = None, None, [], (True, True)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names=schema.names)

        for b in batches:
            kind, done = b.schema.field(0).type, []
            for c, p, t, loss, ok, closed in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6)), strict=True):
                if texts and (p != place or c != now.conv):
                    now.take(fmt, texts, *flags)
                    texts = []
                if now is None or c != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = Reading(c)
                place, flags = p, (ok, closed)
                texts.append((t, loss))
            if done:
                yield out(done)
        if now is not None:
            now.take(fmt, texts, *flags)
            yield out([now.row()])

    return segments.mapInArrow(kernel, schema)
