"""Chat formatting: conversations rendered by a compiled template (chat_template), with the spans of generation markers.

Rows are dealt by conversation and sorted by turn; a task renders them as they come. A template that only loops over its
messages holds a turn or two at a time, so a conversation of any length is rendered in bounded memory: its output is cut into
parts of about part_chars characters, outside generation blocks. Other templates (`messages[0]`, `messages|length`) hold one
conversation. The rows of one conversation, which its formatted text joins anyway, are read by one task.

The template CHAT marks turns by `<|im_start|>` and `<|im_end|>` and escapes these inside texts, so that parse() reads the turns
back from the output, each with the part of it that lies under the loss mask.

Defined cases: null roles and texts are empty; rows of equal turn come by role, then text, null turns first; repeated rows are
repeated turns; a null id is an id of its own; a conversation without assistant turns has an empty mask; long texts are
rendered whole; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat_template import BEGIN, END, Template, unescape, unescape_line

CHAT = """{% for message in messages %}
<|im_start|>{{ message.role | escape_line }}
{% if message.role == 'assistant' %}
{% generation %}{{ message.text | escape }}{% endgeneration %}
{% else %}
{{ message.text | escape }}
{%- endif %}
<|im_end|>
{% endfor %}"""
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
PARTS = "part int, formatted string, spans array<struct<start:int,end:int>>"
BATCH = 4 << 20  # characters or rows of output that are handed over together


@functools.cache
def compiled(source: str, trim_blocks: bool) -> Template:
    return Template(source, trim_blocks)


def _batches(rows: Iterator[tuple], schema: pa.Schema, sizes) -> Iterator[pa.RecordBatch]:
    """Rows as batches; sizes(row) in characters."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += 200 + sizes(row)
        if n > BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _grouped(batches) -> Iterator[tuple]:
    """(id, iterator of rows) for each run of rows with equal first columns."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return itertools.groupby(rows, key=lambda row: row[0])


def parts_of(template: Template, messages, part_chars: int) -> Iterator[tuple[int, str, list[dict]]]:
    """(part, text, spans) of one conversation; at least one part."""
    texts, spans, n, part, start = [], [], 0, 0, None
    for piece in template.render(messages):
        if piece is BEGIN:
            start = n if start is None else start
        elif piece is END:
            spans.append({"start": start, "end": n})
            start = None
        else:
            texts.append(piece)
            n += len(piece)
        if n >= part_chars and start is None:
            yield part, "".join(texts), spans
            texts, spans, n, part = [], [], 0, part + 1
    if n or spans or not part:
        yield part, "".join(texts), spans


def format_conversations(rows: DataFrame, template: str = CHAT, trim_blocks: bool = True, part_chars: int = 1 << 20, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each part of a formatted conversation: its id, part (from 0), formatted, spans (code points under the
    generation markers, end exclusive). The parts of a conversation follow each other in one partition."""
    compiled(template, trim_blocks)  # errors show here
    field = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    chosen = rows.select(F.col(f"`{conv_id}`").alias("id"), F.col(f"`{turn}`").alias("turn"), field(role).alias("role"), field(text).alias("text"))
    chosen = chosen.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    kind = chosen.schema["id"].dataType.simpleString()
    names = [conv_id, "part", "formatted", "spans"]

    def run(batches):
        made = compiled(template, trim_blocks)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([(names[0], first.schema.field(0).type), ("part", pa.int32()), ("formatted", pa.string()), ("spans", span)])
        found = ((id, *part) for id, group in _grouped(itertools.chain([first], batches)) for part in parts_of(made, ({"role": r, "text": t} for _, r, t in group), part_chars))
        yield from _batches(found, schema, lambda row: len(row[2]))

    return chosen.mapInArrow(run, f"`{conv_id}` {kind}, {PARTS}")


def turns_of(parts: Iterator[tuple]) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, text under the mask, characters that the turn takes in the output) of the parts (formatted, spans) of one
    conversation, unescaped. Holds a part and what is left of the one before."""
    rest, masks = "", []
    for formatted, spans in parts:
        moved = len(rest)
        rest += formatted
        masks += [(s["start"] + moved, s["end"] + moved) for s in spans]
        done, k = 0, 0
        for m in TURN.finditer(rest):
            if m.start() != done:
                raise ValueError("text between turns: the output is not of this template")
            loss = []
            while k < len(masks) and masks[k][1] <= m.end():
                loss.append(unescape(rest[slice(*masks[k])]))
                k += 1
            yield unescape_line(m[1]), unescape(m[2]), "".join(loss), m.end() - done
            done = m.end()
        rest, masks = rest[done:], [(a - done, b - done) for a, b in masks[k:]]
    if rest:
        raise ValueError("a turn has no end: the output is not of this template")


def _in_order(formatted: DataFrame, conv_id: str, in_order: bool) -> DataFrame:
    chosen = formatted.select(F.col(f"`{conv_id}`").alias("id"), "part", "formatted", "spans")
    return (chosen if in_order else chosen.repartition("id").sortWithinPartitions("id", "part")).select("id", "formatted", "spans")


def parse(formatted: DataFrame, conv_id: str = "conv_id", in_order: bool = False) -> DataFrame:
    """The turns read back from what format_conversations made with CHAT: id, n (from 0), role, text, loss (its text under the mask).
    in_order: the rows come straight from format_conversations, so that they need no sorting."""
    chosen = _in_order(formatted, conv_id, in_order)
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([(conv_id, first.schema.field(0).type), ("n", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("loss", pa.string())])
        found = ((id, i, *turn[:3]) for id, group in _grouped(itertools.chain([first], batches)) for i, turn in enumerate(turns_of((f, s) for _, f, s in group)))
        yield from _batches(found, schema, lambda row: len(row[3]) + len(row[4]))

    return chosen.mapInArrow(run, f"`{conv_id}` {kind}, n long, role string, text string, loss string")


def digests(formatted: DataFrame, conv_id: str = "conv_id", in_order: bool = False) -> DataFrame:
    """What is read back from each formatted conversation: id, n_turns, turns_sha256 (role, line break, text, line break of each
    turn), loss_chars, loss_sha256 (the text under the mask, unescaped), formatted_chars. Hashes are fed turn by turn."""
    chosen = _in_order(formatted, conv_id, in_order)
    kind = chosen.schema["id"].dataType.simpleString()

    def of(group) -> tuple:
        n, loss_chars, chars, turns, losses = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for role, text, loss, size in turns_of((f, s) for _, f, s in group):
            turns.update(f"{role}\n{text}\n".encode())
            losses.update(loss.encode())
            n, loss_chars, chars = n + 1, loss_chars + len(loss), chars + size
        return n, turns.hexdigest(), loss_chars, losses.hexdigest(), chars

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        long, string = pa.int64(), pa.string()
        schema = pa.schema([(conv_id, first.schema.field(0).type), ("n_turns", long), ("turns_sha256", string), ("loss_chars", long), ("loss_sha256", string), ("formatted_chars", long)])
        yield from _batches(((id, *of(group)) for id, group in _grouped(itertools.chain([first], batches))), schema, lambda row: 200)

    return chosen.mapInArrow(run, f"`{conv_id}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
