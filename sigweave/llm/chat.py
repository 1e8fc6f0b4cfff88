"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns become segments of text with a loss flag. What a template uses to mark turns
is escaped inside texts, so a formatted conversation can be read back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks before and after a turn's text by role, the roles under the loss, and the order of turns.

    Every mark starts with one of `leads`; these characters and the escape character
    get an escape character before them inside texts. `other` marks roles without marks
    of their own; {} is the role.
    """

    marks: dict[str, tuple[str, str]]
    other: tuple[str, str]
    loss: frozenset[str]
    order: dict[tuple[str, str], str]
    ends: frozenset[str]
    start: str = "start"
    escape: str = "\\"
    leads: str = "<["
    closers: str = "]"
    escaped: re.Pattern = field(init=False)
    tokens: re.Pattern = field(init=False)

    def __post_init__(self) -> None:
        chars = "".join(map(re.escape, self.escape + self.leads + self.closers))
        object.__setattr__(self, "escaped", re.compile(f"[{chars}]"))
        marks = sorted({m for pair in self.marks.values() for m in pair} | {self.other[1]}, key=len, reverse=True)
        head, tail = map(re.escape, self.other[0].split("{}"))
        pattern = "|".join([f"(?P<e>{re.escape(self.escape)}(?P<c>.))", f"{head}(?P<r>(?:[^{chars}]|{re.escape(self.escape)}.)*){tail}", f"(?P<m>{'|'.join(map(re.escape, marks))})"])
        object.__setattr__(self, "tokens", re.compile(pattern, re.DOTALL))

    def quote(self, text: str) -> str:
        return self.escaped.sub(lambda m: self.escape + m.group(), text)

    def unquote(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.DOTALL)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(segment, under the loss) of a turn: mark, text, mark."""
        before, after = self.marks.get(role) or (self.other[0].replace("{}", self.quote(role)), self.other[1])
        return [(before, False), (self.quote(text), role in self.loss), (after, False)]

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a formatted conversation."""
        reader = Reader(self)
        return [*reader.feed(formatted), *reader.feed("", True)]


class Reader:
    """Reads a formatted conversation back, from parts of any size that needn't end where turns do."""

    def __init__(self, template: Template) -> None:
        self.template = template
        self.opens = {before: (role, after) for role, (before, after) in template.marks.items()}
        self.longest = max(len(m) for pair in [*template.marks.values(), template.other] for m in pair)
        head, tail = template.other[0].split("{}")
        part = "|".join(re.escape(tail[:k]) for k in range(len(tail) - 1, 0, -1))
        self.begun = re.compile(re.escape(head) + rf"(?:[^\[\]<\\]|\\.)*(?:\\|{part})?$", re.DOTALL)
        self.rest, self.role, self.end, self.text = "", None, "", []

    def feed(self, part: str, last: bool = False) -> list[tuple[str, str]]:
        """(role, text) of the turns that are complete now. A mark that the next part could make longer waits for it."""
        rest, at, found = self.rest + part, 0, []
        safe = len(rest) if last else max(0, len(rest) - self.longest)
        if not last and self.role is None and (m := self.begun.search(rest)):
            safe = min(safe, m.start())
        for m in self.template.tokens.finditer(rest):
            if m.start() >= safe:
                break
            if self.role is not None:
                self.text.append(rest[at : m.start()])
            at = m.end()
            if m.group("e"):
                self.text.append(m.group("c"))
            elif self.role is None:
                self.role, self.end = (self.template.unquote(m.group("r")), self.template.other[1]) if m.group("r") is not None else self.opens[m.group("m")]
                self.text = []
            elif m.group() == self.end:
                found.append((self.role, "".join(self.text)))
                self.role = None
        if at < safe:
            if self.role is not None:
                self.text.append(rest[at:safe])
            at = safe
        self.rest = rest[at:]
        return found


#: Turn order: an optional system turn, then user and assistant by turns, to end with the assistant.
INSTRUCT = Template(
    marks={"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<a> ", " </s>\n")},
    other=("[ROLE {}] ", " [/ROLE]\n"),
    loss=frozenset({"assistant"}),
    order={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    ends=frozenset({"assistant"}),
)
#: Turns whose segments one Arrow batch holds.
BATCH_TURNS = 1000


def formatted(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Columns conv_id, turn_no, role, segments (array of text, loss), state, valid: one row for each turn, in order within a partition.

    `turns` has conv_id, turn, role, text. The rows of a conversation are sorted and
    run through the machine one by one, so a conversation of any length needs the
    memory of one turn. `state` is the machine's state after the turn, null once the
    order was violated; `valid` is known at the last turn (null before): whether all
    turns were in order and the conversation may end there. Null roles and texts
    count as empty; turns of equal number are ordered by role and text. Conversations
    that violate the order are formatted all the same. Rows without conv_id form one
    conversation. Other columns are ignored.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn_no", "role", "segments", "state", "valid"]
        kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        held, state, conv, no = None, template.start, object(), 0

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.string(), kind, pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        out: list[tuple] = []
        for batch in batches:
            for own, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if held is None or own != conv:
                    if held is not None:
                        out.append((*held, state in template.ends))
                    conv, state, no = own, template.start, 0
                else:
                    out.append((*held, None))
                state = template.order.get((state, role)) if state else None
                segments = [{"text": s, "loss": loss} for s, loss in template.segments(role, text)]
                held, no = (own, no, role, segments, state), no + 1
                if len(out) >= BATCH_TURNS:
                    yield batch_of(out)
                    out = []
        if held is not None:
            out.append((*held, state in template.ends))
        yield batch_of(out)

    return rows.mapInArrow(made, "conv_id long, turn_no long, role string, segments array<struct<text:string,loss:boolean>>, state string, valid boolean")


def digests(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Columns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, read back from the output of `formatted`.

    A conversation's segments are joined and parsed as one text, in parts that say
    nothing of where a turn ends; only running digests and one turn's text are kept.
    """
    import hashlib

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, begun = None, False
        for batch in batches:
            for own, segs, valid in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun:
                    conv, begun = own, True
                    n, loss_chars, chars, turns, loss, reader = 0, 0, 0, hashlib.sha256(), hashlib.sha256(), Reader(template)
                text = "".join(s["text"] for s in segs)
                chars += len(text)
                for role, said in [*reader.feed(text), *(reader.feed("", True) if valid is not None else ())]:
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                under = template.unquote("".join(s["text"] for s in segs if s["loss"]))
                loss_chars += len(under)
                loss.update(under.encode())
                if valid is not None:
                    out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))
                    begun = False
        columns = list(zip(*out, strict=True)) or [()] * 7
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return segments.select("conv_id", "segments", "valid").mapInArrow(made, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
