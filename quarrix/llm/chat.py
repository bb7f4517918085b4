"""Chat formatting with typed content parts.

A visitor flattens the parts of a turn (text, image, audio, document) into one
string with ordered placeholders, and records for every attachment its
reference, place and the number of tokens that it expands to.  The template
marks turns by control strings; the same strings inside texts are escaped by
one backslash more behind their first character, which reading takes away.

A conversation's formatted string is the concatenation of its turns' segments
in order.  Turns are formatted one by one and a conversation is read as a
stream of sorted segments, so none has to fit into memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, isfinite

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>\n"
# Control strings of this template and of common others, none of which may stand inside a text.
_CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\]|/?<?/?SYS>)"
_ESCAPE = re.compile(_CONTROL)
_UNESCAPE = re.compile(_CONTROL.replace(r"(\\*)", r"\\(\\*)"))
_SEGMENT = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.S)

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<kind:string,ref:string,at:int,n_tokens:int>"
SEGMENTS = f"conv_id long, turn long, role string, segment string, loss_start int, loss_end int, attachments array<{ATTACHMENT}>, n_expanded long"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


@dataclass
class Flattener:
    """Visits content parts in order; ``done`` gives the string.

    Neighbouring texts are escaped as one, since a control string may be spread
    over several parts.  Unknown kinds raise; a null part is an empty text;
    measures that are missing, not finite or too small count as their least value.
    """

    patch: int = 14  # pixels of an image on one token's side
    audio_tokens_per_second: float = 12.5
    page_tokens: int = 256
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0
    texts: list[str] = field(default_factory=list)  # neighbours that wait to be escaped

    def visit(self, part: dict | None) -> None:
        part = part or {}
        kind = part.get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown content part {kind!r}")
        method(part)

    def done(self) -> str:
        self._flush()
        return "".join(self.pieces)

    def _flush(self) -> None:
        if self.texts:
            self._add(escape("".join(self.texts)))
            self.texts.clear()

    def _add(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)

    @staticmethod
    def _measure(value: float | None, least: float) -> float:
        return max(least, value) if value is not None and isfinite(value) else least

    def _attach(self, kind: str, part: dict, n_tokens: int) -> None:
        self._flush()
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.length, "n_tokens": n_tokens})
        self._add(f"<|{kind}:{len(self.attachments) - 1}|>")

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        across, down = (ceil(self._measure(part.get(k), 1) / self.patch) for k in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, ceil(self._measure(part.get("seconds"), 0) * self.audio_tokens_per_second)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, self._measure(part.get("pages"), 1) * self.page_tokens)


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), parts_col: str | None = None) -> DataFrame:
    """Rows of ``SEGMENTS``, one for each turn of ``turns(conv_id, turn, role, text)``.

    ``parts_col`` names a column of type ``array<PART>`` that stands in for the
    text where it is not null.  Null texts and roles count as empty.  The loss
    mask is the segment's code points ``[loss_start, loss_end)``: the content of
    turns in ``loss_roles``, without the control strings around it.
    ``n_expanded`` sums the attachments' tokens.
    """
    parts = F.col(parts_col).cast(f"array<{PART}>") if parts_col else F.lit(None).cast(f"array<{PART}>")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_type = {
            "segment": pa.string(), "loss_start": pa.int32(), "loss_end": pa.int32(),
            "attachments": pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("n_tokens", pa.int32())])), "n_expanded": pa.int64(),
        }
        for batch in batches:
            made: dict[str, list] = {k: [] for k in out_type}
            for role, text, content in zip(*(batch.column(k).to_pylist() for k in ("role", "text", "parts")), strict=True):
                flat = Flattener()
                for part in content if content is not None else [{"type": "text", "text": text}]:
                    flat.visit(part)
                whole = flat.done()
                head = START + escape(role or "") + SEP
                for one in flat.attachments:
                    one["at"] += len(head)
                made["segment"].append(head + whole + END)
                made["loss_start"].append(len(head) if role in loss_roles else None)
                made["loss_end"].append(len(head) + flat.length if role in loss_roles else None)
                made["attachments"].append(flat.attachments)
                made["n_expanded"].append(sum(x["n_tokens"] for x in flat.attachments))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(made[k], t) for k, t in out_type.items())], names=["conv_id", "turn", "role", *out_type])

    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), parts.alias("parts")]
    return turns.select(*columns).mapInArrow(build, SEGMENTS)


def _order() -> list[Column]:
    return [F.col("conv_id"), F.col("turn"), F.col("segment")]


def read_conversations(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted string and loss mask alone.

    Segments follow each other by turn (ties by segment; nulls first), as a
    stream: of a conversation only running digests are kept.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        begun, conv, n, chars, loss_chars = False, None, 0, 0, 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            rows = []
            for key, segment, low, high in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "segment", "loss_start", "loss_end")), strict=True):
                if not begun or key != conv:
                    if begun:
                        rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    begun, conv, n, chars, loss_chars = True, key, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for found in _SEGMENT.finditer(segment):
                    n += 1
                    turns.update(f"{unescape(found[1])}\n{unescape(found[2])}\n".encode())
                chars += len(segment)
                if low is not None:
                    plain = unescape(segment[low:high])
                    loss_chars += len(plain)
                    loss.update(plain.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types, strict=True)], names=names)
        if begun:
            last = (conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, types, strict=True)], names=names)

    dealt = segments.select("conv_id", "turn", "segment", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions(*_order())
    return dealt.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
