"""Chat formatting: a state machine over roles, and segments with loss flags from a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are marked, which roles may follow each other, and whose texts are learned.

    ``opens`` has the marker that opens a turn of each known role; other roles stand, escaped,
    between the two markers of ``other``; ``close`` ends every turn. ``moves`` has the state
    that each role leads to, by state; a role that it doesn't have is a fault there, after which
    the machine goes on from ``after`` (the role's own state; a role without one changes nothing). A conversation
    is whole where it ends in one of ``ends``. Texts of the roles in ``learned`` are under the
    loss mask, their markers aren't.

    Markers found in texts are escaped: each character that begins one, and each backslash, gets
    a backslash after it. So no text holds a marker any more, and what is read back is exact.
    """

    opens: Mapping[str, str]
    other: tuple[str, str]
    close: str
    learned: frozenset[str]
    start: str
    moves: Mapping[str, Mapping[str, str]]
    after: Mapping[str, str]
    ends: frozenset[str]

    def __post_init__(self):
        marks = self.markers
        if len(set(marks)) < len(marks) or any(len(m) < 2 or "\\" in m for m in marks):
            raise ValueError("markers differ, have two characters or more, and no backslash")
        if any(a != b and b.startswith(a) for a in self.openers for b in self.openers):
            raise ValueError("no opening marker may begin another")
        for m in marks:
            for end in (self.close, self.other[1]):
                if any(end.startswith(m[k:]) or m[k:].startswith(end) for k in range(1, len(m))):
                    raise ValueError(f"{m!r} could begin in a text and end in {end!r}")

    @property
    def openers(self) -> list[str]:
        return [*self.opens.values(), self.other[0]]

    @property
    def markers(self) -> list[str]:
        return [*self.openers, self.other[1], self.close]

    @cached_property
    def _risky(self) -> re.Pattern:
        return re.compile(r"\\|(?=" + "|".join(map(re.escape, self.markers)) + r")[\s\S]")

    def escape(self, text: str) -> str:
        return self._risky.sub(lambda m: m[0] + "\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def opening(self, role: str) -> str:
        return self.opens[role] if role in self.opens else self.other[0] + self.escape(role) + self.other[1]

    def step(self, state: str, role: str) -> tuple[str, str | None]:
        """The state that role leads to, and what is wrong with it there, if anything."""
        if (to := self.moves.get(state, {}).get(role)) is not None:
            return to, None
        return self.after.get(role, state), f"{role} after {state}" if role in self.opens else "unknown role"


#: Turns marked by headings, as in instruction data; a system turn may only come first.
HEADINGS = ChatTemplate(
    opens={"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "},
    other=("### Role ", "</role> "),
    close="</turn>\n",
    learned=frozenset({"assistant"}),
    start="start",
    moves={"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}},
    after={"system": "system", "user": "user", "assistant": "assistant"},
    ends=frozenset({"assistant"}),
)

SEGMENT = "turn long, role string, kind string, text string, loss boolean, start long, stop long, state string, fault string"


def format_chat(conversations: DataFrame, template: ChatTemplate = HEADINGS) -> DataFrame:
    """The segments of every conversation in order: its formatted text is what they have, one after the other.

    conversations: conv_id, turn, role, text; turns go by ``turn``, null first, ties by role and text. Returns conv_id,
    turn (its place, from 0), role, kind (open, text or close), text (escaped), loss, start and stop
    (code points of the conversation), state of the machine after the turn, and fault (why the
    turn may not stand there, or null). Turns at fault are formatted all the same.

    A null role or text is an empty one; rows without conv_id are one conversation; rows that
    repeat are turns of their own; texts may be of any length; other columns are ignored,
    whatever their names; an empty table gives no segments. A conversation is one sequence, so one task
    goes over its turns, batch by batch and with the machine's state alone in memory; rows of a partition stay in
    order (conv_id, turn), as read_chat needs them.
    """
    c = conversations.select("conv_id", F.col("turn").alias("_at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = c.repartition("conv_id").sortWithinPartitions("conv_id", "_at", "role", "text")
    kind = c.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turn, at, state, first = None, 0, 0, template.start, True
        for b in batches:
            rows = []
            for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if first or conv != now:
                    now, turn, at, state, first = conv, 0, 0, template.start, False
                state, fault = template.step(state, role)
                learned = role in template.learned
                for part, piece, loss in (("open", template.opening(role), False), ("text", template.escape(text), learned), ("close", template.close, False)):
                    rows.append((conv, turn, role, part, piece, loss, at, at + len(piece), state, fault))
                    at += len(piece)
                turn += 1
            yield _batch(rows, b.schema.field("conv_id").type, FORMATTED)

    return c.mapInArrow(run, f"conv_id {kind}, {SEGMENT}")


FORMATTED = [("turn", pa.int64()), ("role", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64()), ("state", pa.string()), ("fault", pa.string())]
READ = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_faults", pa.int64()), ("whole", pa.bool_())]


def _batch(rows: list[tuple], kind: pa.DataType, fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * (len(fields) + 1)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(columns, [("conv_id", kind), *fields], strict=True)], ["conv_id", *[n for n, _ in fields]])


class Reader:
    """Reads one conversation back from its formatted text, as it comes, and from the loss mask over it.

    Turns are found by the template's markers alone, wherever pieces of text begin and end.
    """

    def __init__(self, template: ChatTemplate):
        self.template = template
        self.pending, self.seen, self.learning = "", 0, ""
        self.n_turns, self.loss_chars, self.chars, self.faults, self.state, self.turn = 0, 0, 0, 0, template.start, -1
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, loss: bool) -> None:
        self.chars += len(piece)
        if loss:
            self.learning += piece
        else:
            self._learned()
        self.pending += piece
        close = self.template.close
        while (end := self.pending.find(close, max(0, self.seen - len(close)))) >= 0:
            self._turn(self.pending[:end])
            self.pending, self.seen = self.pending[end + len(close) :], 0
        self.seen = len(self.pending)

    def _learned(self) -> None:
        text = self.template.unescape(self.learning)
        self.loss_chars += len(text)
        self.loss.update(text.encode())
        self.learning = ""

    def _turn(self, text: str) -> None:
        t = self.template
        for role, mark in t.opens.items():
            if text.startswith(mark):
                body = text[len(mark) :]
                break
        else:
            before, mark, body = text.partition(t.other[1])
            if not text.startswith(t.other[0]) or not mark:
                raise ValueError("a turn begins with no marker")
            role = t.unescape(before[len(t.other[0]) :])
        self.state, fault = t.step(self.state, role)
        self.faults += fault is not None
        self.turns.update(f"{role}\n{t.unescape(body)}\n".encode())
        self.n_turns += 1

    def result(self) -> tuple:
        self._learned()
        if self.pending:
            raise ValueError("a turn has no end")
        whole = not self.faults and self.state in self.template.ends
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.faults, whole


def read_chat(segments: DataFrame, template: ChatTemplate = HEADINGS) -> DataFrame:
    """What each conversation's formatted text and loss mask say, one row for each.

    segments: conv_id, text and loss, in order within partitions and with a conversation in one
    partition, as format_chat returns them (a table of them is dealt by conv_id and sorted by conv_id and start first). Returns conv_id, n_turns,
    turns_sha256 (of role, newline, text and newline for each turn), loss_chars and loss_sha256
    (of all text under the mask, nothing between), formatted_chars, n_faults (turns that may not
    stand where they do) and whole (none of these, and an end where one may be).
    """
    kind = segments.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, of = None, None, None
        for b in batches:
            rows, of = [], b.schema.field("conv_id").type
            for conv, piece, loss in zip(b.column("conv_id").to_pylist(), b.column("text").to_pylist(), b.column("loss").to_pylist(), strict=True):
                if reader is None or conv != now:
                    if reader is not None:
                        rows.append((now, *reader.result()))
                    now, reader = conv, Reader(template)
                reader.feed(piece, loss)
            yield _batch(rows, of, READ)
        if reader is not None:
            yield _batch([(now, *reader.result())], of, READ)

    return segments.select("conv_id", "text", "loss").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_faults long, whole boolean")
