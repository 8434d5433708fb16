"""Conversations rendered by a template that is a black box, with the span of every turn.

The template is a function from a list of messages to a string. Prefixes of a conversation of one
turn more each time are rendered; what a prefix adds to the one before is the span of its last
turn. Rendering the last turn with two other texts shows which part of the span is the text: what
the two have in common at the ends is the template's. A template that changes what it wrote for
earlier turns is detected by the same comparison, and then no loss mask is given.

All prefixes are rendered, whatever their number, so the work grows with the square of the turns of
one conversation: a template may look at any of them.

`chatml` is a template with marked turns that escapes its control strings reversibly.

Defined results: null roles and texts are empty; turns are ordered by turn, role and text, nulls
first, and repeated rows are turns of their own; rows of a null conversation id are one
conversation; an empty table gives no row; other columns are ignored. One conversation is one row
of output and is held whole by one task.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonloom.llm.tokens import arrow_rows

Message = dict[str, str]
Template = Callable[[list[Message]], str]

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """A text in which no control string can begin; `unescape` gives it back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def chatml(messages: list[Message]) -> str:
    return "".join(
        f"{START}{escape(m['role']).replace(chr(10), chr(92) + 'n')}\n{escape(m['content'])}{END}\n"
        for m in messages
    )


def parse_chatml(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


@dataclass(frozen=True)
class Span:
    role: str
    start: int
    end: int
    text_start: int
    text_end: int


@dataclass(frozen=True)
class Rendered:
    formatted: str
    spans: list[Span]
    rewrites_history: bool


def _text_place(
    before: list[Message], turn: Message, piece: str, skip: str, render: Template
) -> tuple[int, int]:
    """Where the text of the last turn lies in what that turn adds; nowhere if it cannot be told."""
    probes = []
    for text in ("x", "y"):
        out = render([*before, {**turn, "content": text}])
        if not out.startswith(skip):
            return 0, 0
        probes.append(out[len(skip) :])
    head = len(os.path.commonprefix(probes))
    tail = len(os.path.commonprefix([p[head:][::-1] for p in probes]))
    fits = head + tail <= len(piece) and piece.startswith(probes[0][:head])
    if not fits or (tail and not piece.endswith(probes[0][-tail:])):
        return 0, 0
    return head, len(piece) - tail


def render_incrementally(messages: list[Message], render: Template = chatml) -> Rendered:
    """The rendered conversation and its turns' spans, whatever the template writes around them."""
    seen, spans = "", []
    for k, turn in enumerate(messages):
        before = messages[:k]
        now = render([*before, turn])
        if not now.startswith(seen):
            return Rendered(render(messages), [], True)
        first, last = _text_place(before, turn, now[len(seen) :], seen, render)
        at = len(seen)
        spans.append(Span(turn["role"], at, len(now), at + first, at + last))
        seen = now
    return Rendered(seen, spans, False)


SPAN_TYPE = pa.struct(
    [("role", pa.string())]
    + [(n, pa.int64()) for n in ("start", "end", "text_start", "text_end")]
    + [("loss", pa.bool_())]
)
FORMATTED_SCHEMA = (
    "conv_id long, formatted string, rewrites_history boolean, "
    "spans array<struct<role:string,start:long,end:long,text_start:long,text_end:long,loss:boolean>>"
)


def format_conversations(
    turns: DataFrame, render: Template = chatml, loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """conv_id, formatted, rewrites_history and spans, of which `loss` ones count for training."""

    def one(conv_id: int | None, messages: list[Message]) -> tuple:
        done = render_incrementally(messages, render)
        spans = [{**vars(s), "loss": s.role in loss_roles} for s in done.spans]
        return conv_id, done.formatted, done.rewrites_history, spans

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.bool_(), pa.list_(SPAN_TYPE))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "formatted", "rewrites_history", "spans"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, messages, out, chars = None, [], [], 0
        for batch in batches:
            for conv_id, role, text in arrow_rows(batch):
                if messages and conv_id != open_id:
                    out.append(one(open_id, messages))
                    chars += len(out[-1][1])
                    messages = []
                    if chars > 1_000_000:
                        yield batch_of(out)
                        out, chars = [], 0
                open_id = conv_id
                messages.append({"role": role, "content": text})
        if messages:
            out.append(one(open_id, messages))
        if out:
            yield batch_of(out)

    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(apply, FORMATTED_SCHEMA)


DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def digest(formatted: DataFrame) -> DataFrame:
    """What the rendered conversations hold, read back from them by the marks of `chatml`."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, text, spans in arrow_rows(batch):
                turns, loss = parse_chatml(text), hashlib.sha256()
                whole, chars = hashlib.sha256(), 0
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                for span in spans:
                    if span["loss"]:
                        said = unescape(text[span["text_start"] : span["text_end"]])
                        loss.update(said.encode())
                        chars += len(said)
                out.append((conv_id, len(turns), whole.hexdigest(), chars, loss.hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            values = zip(*out, strict=True) if out else [[]] * len(kinds)
            columns = [pa.array(c, k) for c, k in zip(values, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in DIGEST_SCHEMA.split(", ")])

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(apply, DIGEST_SCHEMA)
