"""Chat formatting with typed content parts.

A visitor flattens a turn's text, image, audio and document parts into one string with ordered
placeholders, recording what each placeholder refers to and how many tokens it expands to. Turns
are marked ``<turn ROLE>`` … ``</turn>``; texts are escaped so that no control string can occur in
them, and reading back undoes that exactly.

A conversation is formatted turn by turn in order, and its output is the concatenation of its
turns' chunks: rows are dealt by conversation and sorted by turn, then stream through, so even a
conversation with a third of all rows needs no more memory than one turn.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

PARTS = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"

_TO_ESCAPE = {"\\": "\\\\", "<": "\\l", ">": "\\g", "\n": "\\n"}
_FROM_ESCAPE = {"\\": "\\", "l": "<", "g": ">", "n": "\n"}


def escape(text: str) -> str:
    """Without ``<`` no turn mark or placeholder can begin inside a text."""
    return text.replace("\\", "\\\\").replace("<", "\\l") if "\\" in text or "<" in text else text


def escape_role(role: str) -> str:
    return re.sub(r"[\\<>\n]", lambda m: _TO_ESCAPE[m[0]], role)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _FROM_ESCAPE.get(m[1], m[1]), text, flags=re.S) if "\\" in text else text


@dataclass
class PartVisitor:
    """Flattens parts; placeholders are numbered through the conversation, each kind by itself."""

    patch: int = 28
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 560
    seen: dict[str, int] = field(default_factory=dict)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0

    def visit(self, part: dict | None) -> str:
        """A null part or an unknown kind of part gives the part's text, if any."""
        if part is None:
            return ""
        return getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        across, down = (math.ceil((part.get(k) or 0) / self.patch) for k in ("width", "height"))
        return self.placeholder("image", part, max(1, across * down))

    def visit_audio(self, part: dict) -> str:
        return self.placeholder("audio", part, max(1, math.ceil((part.get("seconds") or 0) * self.audio_tokens_per_second)))

    def visit_document(self, part: dict) -> str:
        return self.placeholder("document", part, max(1, (part.get("pages") or 0) * self.tokens_per_page))

    def placeholder(self, kind: str, part: dict, tokens: int) -> str:
        n = self.seen[kind] = self.seen.get(kind, -1) + 1
        mark = f"<{kind} {n}>"
        self.attachments.append({"placeholder": mark, "type": kind, "uri": part.get("uri"), "tokens": tokens})
        self.tokens += tokens
        return mark


_ATTACHMENT = pa.struct([("placeholder", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())])


def format_turns(turns: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """Format (conv_id long, turn long, role string, parts ``PARTS``); extra columns are ignored.

    Returns one row a turn, in order within each conversation and partition: conv_id, seq (turns
    from 0), formatted (the turn's chunk of the output), loss_start and loss_length (the part of
    the chunk that a model is to learn, in code points: an assistant's content, escaped; -1 and 0
    for other roles), attachments and expanded_tokens (of the turn's placeholders). Order: turn
    (nulls first), then role and parts, so ties and repeated rows keep one order. Null roles and
    parts count as empty; a null conv_id is a conversation of its own.
    """
    small_batches(turns.sparkSession)
    make = visitor or PartVisitor()
    options = (make.patch, make.audio_tokens_per_second, make.tokens_per_page)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.col("parts").cast(PARTS).alias("parts"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.col("parts").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, seen = object(), 0, {}
        for b in batches:
            out = []
            for conv, role, parts in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if conv != now:
                    now, seq, seen = conv, 0, {}
                visit = PartVisitor(*options, seen=seen)
                head, body = f"<turn {escape_role(role)}>\n", "".join(visit.visit(p) for p in parts or [])
                learn = role == "assistant"
                out.append((conv, seq, f"{head}{body}</turn>\n", len(head) if learn else -1, len(body) if learn else 0, visit.attachments, visit.tokens))
                seq += 1
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(_ATTACHMENT), pa.int64()]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "seq", "formatted", "loss_start", "loss_length", "attachments", "expanded_tokens"])

    return ordered.mapInArrow(
        run,
        "conv_id long, seq long, formatted string, loss_start long, loss_length long, attachments array<struct<placeholder:string,type:string,uri:string,tokens:long>>, expanded_tokens long",
    )


class Reader:
    """Reads a conversation back from its output, which arrives piece by piece."""

    TURN = re.compile(r"<turn ([^<>]*)>\n([^<]*(?:<(?!/turn>)[^<]*)*)</turn>\n")

    def __init__(self):
        self.rest, self.chars, self.turns = "", 0, 0
        self.texts, self.loss, self.loss_chars = hashlib.sha256(), hashlib.sha256(), 0

    def feed(self, output: str, start: int, length: int) -> None:
        """``start`` and ``length``: the loss mask's span in this piece, if ``start`` is not -1."""
        self.chars += len(output)
        if start >= 0:
            learned = unescape(output[start : start + length])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())
        self.rest += output
        end = 0
        while m := self.TURN.match(self.rest, end):
            self.turns += 1
            self.texts.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            end = m.end()
        self.rest = self.rest[end:]


def read_back(formatted: DataFrame) -> DataFrame:
    """Read ``format_turns``' output back: per conversation n_turns, turns_sha256 (of role, newline,
    text, newline of every turn), loss_chars and loss_sha256 (all text under the loss mask,
    unescaped) and formatted_chars. Must follow ``format_turns`` directly, whose order it uses."""
    rows = formatted.select("conv_id", "formatted", "loss_start", "loss_length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, reader = None, None

        def done() -> tuple:
            if reader.rest:
                raise ValueError(f"conversation {now} does not read back")
            return now, reader.turns, reader.texts.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            out = []
            for conv, chunk, start, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if reader is None or conv != now:
                    if reader is not None:
                        out.append(done())
                    now, reader = conv, Reader()
                reader.feed(chunk, start, length)
            if out:
                yield batch(out)
        if reader is not None:
            yield batch([done()])

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def text_parts(text: str = "text"):
    """A plain text column as one text part."""
    nothing = {"uri": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()])).cast(PARTS)
