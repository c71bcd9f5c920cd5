"""Chat formatting: a finite-state machine over roles, and segments with loss flags from a declarative template.

The turns of a conversation are read in order in one pass over sorted rows. A
conversation can hold a large part of all rows: the pass keeps the state of the
machine, never the turns. Each turn becomes three segments, its opening mark,
its text and its closing mark, and only the text of a role under the loss has
its flag set. Inside texts and names every character with which a mark or the
escape starts is escaped, so a text can never be read as a mark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from listflow.llm.common import small_batches


@dataclass(frozen=True)
class Template:
    """Marks, roles under the loss, and the machine: which role may follow which (``None``: the beginning)."""

    opening: str = "### "
    named: str = ": "
    closing: str = "</turn>\n"
    escape: str = "\\"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    #: Comes before the name of a role that has no label.
    other: str = "?"
    loss: frozenset[str] = frozenset({"assistant"})
    follow: dict[str | None, frozenset[str]] = field(
        default_factory=lambda: {None: frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})}
    )
    final: frozenset[str] = frozenset({"assistant"})

    def escaped(self, text: str, name: bool = False) -> str:
        special = {self.escape, self.opening[0], self.closing[0]} | ({self.named[0]} if name else set())
        return regex.sub(f"([{regex.escape(''.join(sorted(special)))}])", lambda m: self.escape + m[1], text)

    def plain(self, text: str) -> str:
        return regex.sub(f"{regex.escape(self.escape)}(.)", r"\1", text, flags=regex.DOTALL)

    def segments(self, role: str, text: str) -> tuple[str, str, str]:
        name = self.labels.get(role)
        return f"{self.opening}{self.other + self.escaped(role, True) if name is None else name}{self.named}", self.escaped(text), self.closing

    def role(self, opening: str) -> str:
        """The role that an opening mark names."""
        name = opening[len(self.opening) : -len(self.named)]
        if name.startswith(self.other):
            return self.plain(name[len(self.other) :])
        return {v: k for k, v in self.labels.items()}[name]


def format_chat(conversations: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per segment, in order: ``conv_id``, ``turn_no``, ``part`` (0 open, 1 text, 2 close), ``text``, ``loss``, ``follows``, ``ends``.

    Turns go by ``turn`` (nulls first), then role, then text, so equal turn
    numbers have one order and repeated rows are repeated turns. ``follows`` tells
    whether the machine allows the turn after those before it, ``ends`` whether
    it may be the last. A null role or text is empty; an unknown role is marked as
    such and never allowed. Rows without a conversation id form one conversation. An
    empty table gives no rows.
    """
    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    arrow = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("loss", pa.bool_()), ("follows", pa.bool_()), ("ends", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, state, number, sound = False, None, None, 0, True
        for batch in batches:
            out: list[list] = [[] for _ in arrow]
            for c, r, t in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if not begun or c != now:
                    begun, now, state, number, sound = True, c, None, 0, True
                sound = sound and r in template.follow.get(state, frozenset())
                for part, piece in enumerate(template.segments(r, t)):
                    for column, value in zip(out, (c, number, part, piece, part == 1 and r in template.loss, sound, sound and r in template.final)):
                        column.append(value)
                state, number = r, number + 1
            yield pa.record_batch([pa.array(v, f.type) for v, f in zip(out, arrow)], schema=arrow)

    kinds = [T.LongType(), T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.BooleanType(), T.BooleanType()]
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, T.StructType([T.StructField(f.name, k) for f, k in zip(arrow, kinds)]))


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """What the formatted conversations hold, read from their segments in the order ``format_chat`` gives them.

    ``conv_id``, ``n_turns``, ``turns_sha256`` (role, line end, text, line end per
    turn), ``loss_chars`` and ``loss_sha256`` (the texts under the loss),
    ``formatted_chars``, and ``valid`` (the machine allows it all). Digests grow
    segment by segment; no conversation is held.
    """
    arrow = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now = False, None
        turns = loss = None
        n = chars = total = 0
        valid = False

        def done() -> list:
            return [now, n, turns.hexdigest(), chars, loss.hexdigest(), total, valid]

        for batch in batches:
            out = []
            for c, part, text, flag, ends in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 6))):
                if not begun or c != now:
                    if begun:
                        out.append(done())
                    begun, now, n, chars, total, turns, loss = True, c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                total += len(text)
                if part == 0:
                    turns.update(f"{template.role(text)}\n".encode())
                    n += 1
                elif part == 1:
                    plain = template.plain(text)
                    turns.update(f"{plain}\n".encode())
                    if flag:
                        chars += len(plain)
                        loss.update(plain.encode())
                valid = ends
            yield _table(out, arrow)
        if begun:
            yield _table([done()], arrow)

    kinds = [T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.LongType(), T.BooleanType()]
    return segments.mapInArrow(run, T.StructType([T.StructField(f.name, k) for f, k in zip(arrow, kinds)]))


def _table(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.record_batch([pa.array(list(v), f.type) for v, f in zip(columns, schema)], schema=schema)
