"""Chat formatting: conversations as marked text with a loss flag for each segment.

A declarative template says how turns of a role are marked, which of them are learned, and which role may follow
which; a finite-state machine over the roles judges the order. Control strings inside texts are broken by an escape
character and come back when read. A conversation of any length is formatted turn by turn in several tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from passagework.lineage import cut

ESCAPE = "\\"
#: The state of a conversation whose order is broken; no role leads out of it.
BROKEN = "broken"


@dataclass(frozen=True)
class Turn:
    """Marks before and after the text of a role's turn, and whether the text is learned."""

    before: str
    after: str
    learned: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of known roles, of any other role (with its name between two marks), and the order of turns."""

    turns: dict[str, Turn]
    #: Before the name, between name and text, after the text.
    other: tuple[str, str, str]
    start: str
    #: state -> role -> next state; a role that is missing breaks the order.
    moves: dict[str, dict[str, str]]
    #: States in which a conversation may end.
    ends: frozenset[str]
    states: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        named = {self.start, *self.moves, *(s for to in self.moves.values() for s in to.values())}
        object.__setattr__(self, "states", (*sorted(named - {BROKEN}), BROKEN))
        for mark in self.marks:
            # Such a mark is never mistaken for another place: it has no escape and cannot overlap itself.
            if not mark or ESCAPE in mark or any(mark.endswith(mark[:i]) for i in range(1, len(mark))):
                raise ValueError(f"{mark!r} cannot be a mark")
        opening = [t.before for t in self.turns.values()] + [self.other[0]]
        if len(set(opening)) < len(opening) or any(a != b and b.startswith(a) for a in opening for b in opening):
            raise ValueError("the marks before turns must tell roles apart")
        if self.start not in self.moves or not self.ends <= set(self.states):
            raise ValueError("start and ends must be states of the machine")

    @property
    def marks(self) -> list[str]:
        return list(dict.fromkeys([m for t in self.turns.values() for m in (t.before, t.after)] + list(self.other)))

    def step(self, state: str, role: str) -> str:
        return self.moves.get(state, {}).get(role, BROKEN)


#: Marks of turns in the style of instruction models.
INSTRUCTIONS = Template(
    turns={"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("<s>", "</s>", True)},
    other=("[ROLE]", "[SAYS]", "[/ROLE]"),
    start="new",
    moves={"new": {"system": "briefed", "user": "asked"}, "briefed": {"user": "asked"},
           "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    ends=frozenset({"answered"}))


class Format:
    """Writing and reading of turns by a template."""

    def __init__(self, template: Template):
        self.template = template
        # A mark's first character, where the rest follows, or the escape character itself.
        broken = "|".join(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in template.marks)
        self._risky = re.compile(f"{re.escape(ESCAPE)}|{broken}")
        self._escaped = re.compile(f"{re.escape(ESCAPE)}({re.escape(ESCAPE)}?)")
        self._opening = {t.before: r for r, t in template.turns.items()} | {template.other[0]: None}
        self._open = re.compile("|".join(map(re.escape, sorted(self._opening, key=len, reverse=True))))

    def escape(self, text: str) -> str:
        """Text without any mark: the escape character is doubled, and put behind the first character of a mark."""
        return self._risky.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0] + ESCAPE, text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, learned) of one turn; an empty text has a segment too."""
        turn = self.template.turns.get(role)
        if turn is None:
            first, between, last = self.template.other
            return [(first + self.escape(role) + between, False), (self.escape(text), False), (last, False)]
        return [(turn.before, False), (self.escape(text), turn.learned), (turn.after, False)]

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of a formatted text."""
        at = 0
        while at < len(formatted):
            mark = self._open.match(formatted, at)
            if not mark:
                raise ValueError(f"no turn begins at {at}")
            role, at, after = self._opening[mark[0]], mark.end(), self.template.other[2]
            if role is None:
                end = formatted.index(self.template.other[1], at)
                role, at = self.unescape(formatted[at:end]), end + len(self.template.other[1])
            else:
                after = self.template.turns[role].after
            end = formatted.index(after, at)
            yield role, self.unescape(formatted[at:end])
            at = end + len(after)


SEGMENTS = "array<struct<text: string, learned: boolean>>"


def ordered(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
            text_column: str = "text") -> DataFrame:
    """(id, role, text) dealt out by ranges of conversation and turn, so that a conversation lies in one partition
    or in neighbouring ones, in order inside each. A null role or text is empty.

    Rows with one turn number come by role and digest of the text; equal rows may lie on both sides of a border.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = turns.select(
        F.col(id_column).alias("id"), F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column), F.lit("")).alias("role"),
        text.alias("text"), F.sha2(text, 256).alias("digest"), F.monotonically_increasing_id().alias("row"))
    keys = "id", "turn", "role", "digest", "row"
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "role", "text")


def format_turns(turns: DataFrame, template: Template = INSTRUCTIONS, id_column: str = "conv_id",
                 turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row per turn: id, ``part`` (partition), ``segments`` (text, learned), in the order of ``ordered``.

    The segments of a conversation's turns, in order of (part, place in it), joined without anything between,
    are its formatted text. A null role or text is empty; a null id is a conversation of its own; a null turn comes
    first; repeated rows are turns of their own; texts of any length and roles that the template does not know
    are kept; other columns are not read; an empty table gives an empty table.
    """
    style = Format(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        for batch in batches:
            done = [[{"text": t, "learned": flag} for t, flag in style.segments(role, text)]
                    for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("text", pa.string()), ("learned", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([here] * len(done), pa.int32()), pa.array(done, kind)], ["id", "part", "segments"])

    rows = ordered(turns, id_column, turn_column, role_column, text_column)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, part int, segments {SEGMENTS}").withColumnRenamed("id", id_column)


class Reading:
    """What is read back from the formatted turns of one conversation, piece by piece in bounded memory."""

    def __init__(self, style: Format):
        self.style, self.turns, self.loss_chars, self.formatted_chars = style, 0, 0, 0
        self.turn_digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()
        self.state, self.first_broken = style.template.start, None

    def add(self, formatted: str, learned: str) -> None:
        """Whole turns, and the learned segments among them."""
        self.formatted_chars += len(formatted)
        for role, text in self.style.read(formatted):
            self.turn_digest.update(f"{role}\n{text}\n".encode())
            self.state = self.style.template.step(self.state, role)
            if self.state == BROKEN and self.first_broken is None:
                self.first_broken = self.turns
            self.turns += 1
        learned = self.style.unescape(learned)
        self.loss_chars += len(learned)
        self.loss_digest.update(learned.encode())

    def row(self) -> tuple:
        return (self.turns, self.turn_digest.hexdigest(), self.loss_chars, self.loss_digest.hexdigest(), self.formatted_chars,
                self.state in self.style.template.ends, self.first_broken)


READ = {"n_turns": "long", "turns_sha256": "string", "loss_chars": "long", "loss_sha256": "string", "formatted_chars": "long",
        "valid": "boolean", "first_broken": "long"}
_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
#: Characters of a conversation that travel in one row, unless one turn has more.
TOGETHER = 1 << 20


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _pieces(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[tuple]:
    """(id, part, formatted, learned): neighbouring turns of a conversation, some at once."""
    held, size = [], 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("id", "part", "segments"))
        for id_, part, segments in zip(*columns, strict=True):
            if held and (held[0][0] != id_ or size >= together):
                yield (*held[0][:2], "".join(h[2] for h in held), "".join(h[3] for h in held))
                held, size = [], 0
            held.append((id_, part, "".join(s["text"] for s in segments), "".join(s["text"] for s in segments if s["learned"])))
            size += len(held[-1][2])
    if held:
        yield (*held[0][:2], "".join(h[2] for h in held), "".join(h[3] for h in held))


def _inner(style: Format, kind: pa.DataType, together: int):
    """Conversations that begin and end inside a partition, and are not long, are read; all others, among them the first
    and the last one, which may go on elsewhere, are handed on in pieces."""
    names = ["id", "part", "piece", "formatted", "learned", *READ]
    kinds = [kind, pa.int32(), pa.int64(), pa.string(), pa.string(), *(_ARROW[k] for k in READ.values())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, first, waiting = [], True, None
        for _, pieces in groupby(_pieces(batches, together), lambda p: (p[0] is None, p[0])):
            if waiting:  # it ends here, as another one begins
                reading = Reading(style)
                reading.add(*waiting[2:])
                done.append((*waiting[:2], None, None, None, *reading.row()))
                waiting = None
            for number, piece in enumerate(pieces):
                if number == 0 and not first:
                    waiting = piece
                    continue
                if waiting:
                    done.append((*waiting[:2], 0, *waiting[2:], *[None] * len(READ)))
                    waiting = None
                done.append((*piece[:2], number, *piece[2:], *[None] * len(READ)))
                yield _batch(done, names, kinds)
                done = []
            first = False
            if len(done) >= 1000:
                yield _batch(done, names, kinds)
                done = []
        if waiting:
            done.append((*waiting[:2], 0, *waiting[2:], *[None] * len(READ)))
        if done:
            yield _batch(done, names, kinds)

    return run


def _outer(style: Format, kind: pa.DataType):
    """Pieces of conversations in order, read one after another."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("id", "formatted", "learned")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in groupby(rows(batches), lambda p: (p[0] is None, p[0])):
            reading = Reading(style)
            for id_, *piece in pieces:
                reading.add(*piece)
            yield _batch([(id_, *reading.row())], ["id", *READ], [kind, *(_ARROW[k] for k in READ.values())])

    return run


def read_back(formatted: DataFrame, template: Template = INSTRUCTIONS, id_column: str = "conv_id",
              together: int = TOGETHER) -> DataFrame:
    """One row per conversation of ``format_turns``: id, n_turns, digests and sizes of all turns and of the learned
    text, ``valid`` (the order of roles) and ``first_broken`` (the first turn that breaks it, from 0, or null).

    Everything is read from the formatted text. A digest of a whole conversation needs its turns one after another,
    so turns of a conversation that lies in several partitions pass through one task, a piece at a time; the
    others stay where they are.
    """
    style = Format(template)
    rows = formatted.withColumnRenamed(id_column, "id")
    kind, spelled = to_arrow_type(rows.schema["id"].dataType), rows.schema["id"].dataType.simpleString()
    results = ", ".join(f"{name} {type_}" for name, type_ in READ.items())
    first = cut(rows.mapInArrow(_inner(style, kind, together),
                                f"id {spelled}, part int, piece long, formatted string, learned string, {results}"))
    keys = "id", "part", "piece"
    apart = first.where("piece is not null").select(*keys, "formatted", "learned").repartition("id").sortWithinPartitions(*keys) \
        .mapInArrow(_outer(style, kind), f"id {spelled}, {results}")
    return first.where("piece is null").select("id", *READ).unionByName(apart).withColumnRenamed("id", id_column)
