"""Chat formatting by a finite-state machine over roles and a declarative template.

Each conversation becomes a stream of segments: marks of the template and texts, each with a flag
that says whether the loss counts it. Texts are escaped, so a mark of the template never stands in
a text; `turns_of` reads the turns back from marks and texts alone.

Turns stream through each task in order, so memory holds one turn, however long the conversation.

Defined cases: rows of a conversation go by (turn, role, text), nulls first; a null role or text is
empty; a null conv_id is a conversation of its own; repeated rows are turns of their own; a role
the template does not know is written out between marks; turns out of order are formatted all the
same and flagged; an empty table gives no segments; other input columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
SEGMENTS = "conv_id long, seq long, kind string, text string, loss boolean, in_order boolean"
TURNS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean"
)
BATCH_CHARS = 4_000_000


@dataclass(frozen=True)
class Template:
    """Marks around a conversation and around each turn, the roles whose texts are learnt, and the
    machine: state -> role -> next state. A conversation is valid when it ends in `accept`."""

    begin: str = "<s>"
    end: str = "</s>"
    roles: dict = field(default_factory=lambda: {
        "system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "[/ANS]"),
    })
    other: tuple = ("[ROLE]", "[AS]", "[/ROLE]")
    learnt: tuple = ("assistant",)
    moves: dict = field(default_factory=lambda: {
        "start": {"system": "asked", "user": "told"}, "asked": {"user": "told"}, "told": {"assistant": "answered"},
        "answered": {"user": "told"},
    })
    accept: tuple = ("answered",)

    def marks(self) -> list[str]:
        found = [self.begin, self.end, *self.other, *(m for pair in self.roles.values() for m in pair)]
        for m in found:
            if len(m) < 2 or ESCAPE in m or m[0] in m[1:] or any(a[0] in b[1:] for a in found for b in found):
                raise ValueError(f"mark {m!r}: first characters of marks must not stand inside marks")
        if len(set(found)) < len(found):
            raise ValueError("two marks are equal")
        return found


def escaper(template: Template):
    """Text -> text without marks: the escape is doubled and put after the first character of a mark."""
    find = re.compile("|".join(map(re.escape, [ESCAPE, *template.marks()])))

    def escaped(text: str) -> str:
        return find.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)

    return escaped


def unescaped(text: str) -> str:
    out, at = [], 0
    while (hit := text.find(ESCAPE, at)) >= 0:
        out.append(text[at:hit])
        double = text[hit + 1 : hit + 2] == ESCAPE
        out.append(ESCAPE if double else "")
        at = hit + 1 + double
    return "".join([*out, text[at:]])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += 50 + sum(len(x) for x in r if isinstance(x, str))
        if chars > BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in ddl.split(","))])


def segments(
    conversations: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """Rows of one conversation by seq: marks and escaped texts, with their loss flags."""
    template.marks()
    empty = F.lit("")
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def form(batches):
        escaped = escaper(template)

        def stream():
            now, seq, state = (), 0, "start"
            for conv, who, said in _rows(batches):
                if now != (conv,):
                    if now:
                        yield now[0], seq, "mark", template.end, False, state in template.accept
                    now, seq, state = (conv,), 0, "start"
                    yield conv, seq, "mark", template.begin, False, True
                    seq += 1
                state = template.moves.get(state, {}).get(who, "wrong")
                fine = state != "wrong"
                if who in template.roles:
                    opened, closed = template.roles[who]
                    parts = [("mark", opened)]
                else:
                    closed = template.other[2]
                    parts = [("mark", template.other[0]), ("role", escaped(who)), ("mark", template.other[1])]
                parts += [("text", escaped(said)), ("mark", closed)]
                for kind, piece in parts:
                    yield conv, seq, kind, piece, kind == "text" and who in template.learnt, fine
                    seq += 1
            if now:
                yield now[0], seq, "mark", template.end, False, state in template.accept

        yield from _batched(stream(), _schema(SEGMENTS))

    return rows.mapInArrow(form, SEGMENTS)


def rendered(parts: DataFrame) -> DataFrame:
    """One row per conversation: its whole text, and the spans [from, to) that the loss counts."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text", "loss")))
    grouped = parts.groupBy("conv_id").agg(ordered.alias("parts"))
    spans = F.expr(
        "aggregate(parts, struct(0L AS at, array_repeat(struct(0L AS from, 0L AS to), 0) AS spans), (s, p) -> "
        "struct(s.at + length(p.text) AS at, if(p.loss, array_append(s.spans, struct(s.at AS from, s.at + length(p.text) AS to)), s.spans) AS spans)).spans"
    )
    return grouped.select("conv_id", F.array_join("parts.text", "").alias("formatted"), spans.alias("loss_spans"))


def turns_of(parts: DataFrame, template: Template = Template()) -> DataFrame:
    """Reads segments back: per conversation the digests of its turns and of all learnt text."""
    rows = parts.select("conv_id", "seq", "text", "loss", "in_order").repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def read(batches):
        opens = {pair[0]: role for role, pair in template.roles.items()}
        closes = {pair[1] for pair in template.roles.values()} | {template.other[2]}

        def stream():
            now = ()
            for conv, _, piece, loss, fine in _rows(batches):
                if now != (conv,):
                    now, turns, learnt = (conv,), hashlib.sha256(), hashlib.sha256()
                    n = chars = total = 0
                    valid, who, named = True, None, False
                total += len(piece)
                valid &= fine
                if loss:
                    plain = unescaped(piece)
                    learnt.update(plain.encode())
                    chars += len(plain)
                if piece == template.end:
                    yield conv, n, turns.hexdigest(), chars, learnt.hexdigest(), total, valid
                elif piece in opens:
                    who = opens[piece]
                elif piece == template.other[0]:
                    named = True
                elif named:
                    who, named = unescaped(piece), False
                elif piece in closes:
                    who = None
                elif who is not None and piece != template.other[1]:
                    turns.update(f"{who}\n{unescaped(piece)}\n".encode())
                    n += 1

        yield from _batched(stream(), _schema(TURNS))

    return rows.mapInArrow(read, TURNS)
