"""Chat formatting: a finite-state machine over roles, and segments with a loss flag from a declarative template.

A ``Template`` is plain data: the control strings that open and close a turn of each role,
the roles whose texts are trained on, which role may follow which, and after which a
conversation may end. Control strings inside texts (and role names) are escaped: a
backslash follows their first character, and backslashes are doubled, so that no control
string is left and the text can be read back. Roles without control strings of their own
are written by name.

``format_conversations`` sorts the rows of all conversations by id and turn over ranges
and cuts every conversation into parts of about ``PART_CHARS`` characters, so that a
conversation of any length is spread over tasks and none is held whole. The machine's
state at the start of a part isn't known there; a part therefore keeps, for every state
it may start in, the state it ends in and the turns that are out of order on the way, and
these moves are composed when parts meet. ``read_back`` parses the formatted text (not the
rows) again. Conversations of one whole part, which nearly all are, are read where they
stand; parts of others go to one task a conversation, which keeps only running digests (a
SHA-256 can't be split).

A null role counts as the empty name, a null text as empty. Rows without a conversation id
are one conversation without id; null turns come first; rows of one turn are ordered by
role and text, and repeated rows are turns of their own. Turns out of order are reported
and formatted all the same. A very long text is one segment of one part. Other input columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import written

PART_CHARS = 1 << 20


@dataclass(frozen=True)
class Template:
    """What is written around turns, by role, and which turns may follow each other."""

    marks: dict[str, tuple[str, str]]  # control strings before and after a turn's text
    named: tuple[str, str, str]  # of other roles: before the name, between name and text, after the text
    trained: frozenset[str]  # roles whose texts count in the loss
    order: dict[str, tuple[str, ...]]  # roles that may follow the start ("") and each role
    last: frozenset[str]  # roles after which a conversation may end
    pad: str = " "  # between control strings and texts
    controls: tuple[str, ...] = field(init=False, compare=False)

    def __post_init__(self):
        controls = tuple(sorted({c for pair in self.marks.values() for c in pair} | set(self.named)))
        object.__setattr__(self, "controls", controls)
        if any(len(c) < 2 or "\\" in c or any(c[0] in d[1:] for d in controls) for c in controls):
            raise ValueError("control strings need two characters, no backslash, and a first character that stands nowhere else in them")
        if any(c[0] in self.pad for c in controls) or "\\" in self.pad:
            raise ValueError("what stands between control strings and texts must not look like them")

    @property
    def states(self) -> list[str]:
        return sorted({""} | set(self.order))


INSTRUCT = Template(
    marks={"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")},
    named=("[ROLE]", "[TEXT]", "[/ROLE]"),
    trained=frozenset({"assistant"}),
    order={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    last=frozenset({"assistant"}),
)


def escape(text: str, template: Template) -> str:
    text = text.replace("\\", "\\\\")
    return re.sub("|".join(map(re.escape, template.controls)), lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """A backslash before another stands for one; the others were inserted."""
    return re.sub(r"\\(\\?)", r"\1", text)


def segments(role: str, text: str, template: Template) -> list[tuple[str, bool]]:
    """A turn as written: (text, whether it counts in the loss)."""
    body = escape(text, template)
    if role in template.marks:
        before, after = template.marks[role]
    else:
        begin, between, after = template.named
        before = begin + template.pad + escape(role, template) + template.pad + between
    return [(before + template.pad, False), (body, role in template.trained), (template.pad + after, False)]


def parse(formatted: str, template: Template) -> Iterator[tuple[str, str]]:
    """Roles and texts of formatted turns; raises where the text isn't what ``segments`` writes."""
    opened = {before: (role, after) for role, (before, after) in template.marks.items()}
    begin, between, end = template.named
    pad = template.pad

    def body(piece: str) -> str:
        if len(piece) < 2 * len(pad) or not piece.startswith(pad) or not piece.endswith(pad):
            raise ValueError("a turn without its padding")
        return unescape(piece[len(pad): len(piece) - len(pad)])

    pieces = iter(re.split("(" + "|".join(map(re.escape, template.controls)) + ")", formatted))
    for gap in pieces:
        if gap:
            raise ValueError("text between turns")
        mark = next(pieces, None)
        if mark is None:
            return
        if mark == begin:
            role, mark = body(next(pieces, "")), next(pieces, None)
            if mark != between:
                raise ValueError("a role's name without a text")
            after = end
        elif mark in opened:
            role, after = opened[mark]
        else:
            raise ValueError(f"{mark} opens no turn")
        text = body(next(pieces, ""))
        if next(pieces, None) != after:
            raise ValueError("a turn that isn't closed")
        yield role, text


@dataclass
class Machine:
    """The finite-state machine from every state at once: where it ends, how many turns are out of order, and the first."""

    template: Template
    turns: int = 0

    def __post_init__(self):
        self.moves = {s: (s, 0, None) for s in self.template.states}

    def step(self, role: str) -> None:
        self.turns += 1
        for start, (state, errors, first) in self.moves.items():
            bad = role not in self.template.order.get(state, ())
            self.moves[start] = (role if role in self.template.order else state, errors + bad, self.turns if bad and first is None else first)

    def then(self, turns: int, moves: dict[str, tuple[str, int, int | None]]) -> None:
        """Go on through a part of so many turns with such moves."""
        for start, (state, errors, first) in self.moves.items():
            end, more, at = moves[state]
            self.moves[start] = (end, errors + more, first if first is not None or at is None else self.turns + at)
        self.turns += turns


PARTS = "conv_id long, turn long, seq long, whole boolean, n_turns long, segments array<struct<text:string,loss:boolean>>, moves array<struct<state:string,errors:long,first:long>>"
_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
_MOVES = pa.list_(pa.struct([("state", pa.string()), ("errors", pa.int64()), ("first", pa.int64())]))


class _Part:
    """A part of a conversation while it is written."""

    def __init__(self, conv, turn, seq: int, edge: bool, template: Template):
        self.conv, self.turn, self.seq, self.edge = conv, turn, seq, edge
        self.machine, self.segments, self.chars, self.template = Machine(template), [], 0, template

    def add(self, role: str, text: str) -> None:
        self.machine.step(role)
        for s in segments(role, text, self.template):
            self.segments.append(s)
            self.chars += len(s[0])

    def row(self, whole: bool) -> dict:
        return {"conv_id": self.conv, "turn": self.turn, "seq": self.seq, "whole": whole, "n_turns": self.machine.turns,
                "segments": [{"text": t, "loss": loss} for t, loss in self.segments],
                "moves": [dict(zip(("state", "errors", "first"), self.machine.moves[s], strict=True)) for s in self.template.states]}


def _rows(rows: list[dict]) -> pa.RecordBatch:
    types = {"conv_id": pa.int64(), "turn": pa.int64(), "seq": pa.int64(), "whole": pa.bool_(), "n_turns": pa.int64(), "segments": _SEGMENTS, "moves": _MOVES}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], list(types))


def format_conversations(df: DataFrame, template: Template = INSTRUCT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Parts of formatted conversations (``PARTS``).

    A conversation's text is that of its segments, by ``turn`` and ``seq`` of its parts;
    ``whole`` marks parts that are a whole conversation. ``moves`` has an entry for each of
    the template's states, in their order.
    """
    rows = df.select(df[id_col].cast("long").alias("conv_id"), df[turn_col].cast("long").alias("turn"), F.coalesce(df[role_col].cast("string"), F.lit("")).alias("role"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    # equal keys stay in one partition, so that parts of different tasks never share a turn
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, seq = None, True, 0
        for batch in batches:
            out = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = part is None or part.conv != conv
                if new or part.chars >= PART_CHARS:
                    if part is not None:  # the task's first conversation may have begun in another task
                        out.append(part.row(new and not part.edge and not first))
                        first &= not new
                        seq += 1
                    part = _Part(conv, turn, seq, not new, template)
                part.add(role, text)
            if out:
                yield _rows(out)
        if part is not None:
            yield _rows([part.row(False)])  # its conversation may go on in another task

    return rows.mapInArrow(run, PARTS)


class Reader:
    """Running digests of one conversation, read back part by part."""

    def __init__(self, template: Template):
        self.template, self.machine = template, Machine(template)
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.loss_chars = self.formatted_chars = self.turns = 0

    def read(self, part: dict) -> None:
        whole = "".join(s["text"] for s in part["segments"])
        self.formatted_chars += len(whole)
        for role, text in parse(whole, self.template):
            self.all.update(f"{role}\n{text}\n".encode())
            self.turns += 1
        for s in part["segments"]:
            if s["loss"]:
                text = unescape(s["text"])
                self.loss.update(text.encode())
                self.loss_chars += len(text)
        moves = {s: (m["state"], m["errors"], m["first"]) for s, m in zip(self.template.states, part["moves"], strict=True)}
        self.machine.then(part["n_turns"], moves)

    def result(self, conv: int | None) -> tuple:
        state, errors, first = self.machine.moves[""]
        return (conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, errors, first, state in self.template.last)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_errors long, first_error long, complete boolean"
_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def read_back(parts: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """``READ``: digests of every conversation, from its formatted text.

    ``turns_sha256`` is that of role, newline, text and newline of all turns, ``loss_sha256``
    that of all text under the loss mask. ``n_errors`` turns are out of order, the first is
    turn number ``first_error``; ``complete`` tells whether the conversation may end there.
    """
    fields = [tuple(f.split()) for f in READ.split(", ")]
    kept = PARTS.replace("whole boolean, ", "")

    def batch_of(results: list[tuple], pending: list[dict]) -> pa.RecordBatch:
        columns = list(zip(*results, strict=True)) or [[]] * len(fields)
        empty = [None] * len(pending)
        arrays = [pa.array([*c, *empty], _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)]
        part = pa.struct([("conv_id", pa.int64()), ("turn", pa.int64()), ("seq", pa.int64()), ("n_turns", pa.int64()), ("segments", _SEGMENTS), ("moves", _MOVES)])
        return pa.RecordBatch.from_arrays([*arrays, pa.array([*[None] * len(results), *pending], part)], [*(c for c, _ in fields), "part"])

    def singly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results, pending = [], []
            for part in batch.to_pylist():
                if part.pop("whole"):
                    reader = Reader(template)
                    reader.read(part)
                    results.append(reader.result(part["conv_id"]))
                else:
                    pending.append(part)
            yield batch_of(results, pending)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, conv = None, None
        for batch in batches:
            results = []
            for i in range(batch.num_rows):  # a part at a time
                part = batch.slice(i, 1).to_pylist()[0]
                if reader is None or part["conv_id"] != conv:
                    if reader is not None:
                        results.append(reader.result(conv))
                    reader, conv = Reader(template), part["conv_id"]
                reader.read(part)
            yield batch_of(results, []).drop_columns(["part"])
        if reader is not None:
            yield batch_of([reader.result(conv)], []).drop_columns(["part"])

    # ranges are sampled anew on each evaluation: written, so that both uses see the same parts
    found = written(parts.mapInArrow(singly, f"{READ}, part struct<{kept.replace(' array', ':array').replace(' long', ':long')}>"), "read-parts")
    rest = found.filter("part is not null").select("part.*").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq")
    return found.filter("part is null").drop("part").unionByName(rest.mapInArrow(in_order, READ))
