"""Conversations as one training text each, with typed content parts.

A turn's content is a list of parts: text, image, audio, document. A visitor flattens them in order:
text is escaped, every other part becomes a placeholder that carries its turn and place, with a
reference to the attachment and the number of tokens that it expands to. Each turn is
``<|im_start|>role\\ncontent<|im_end|>\\n``; the loss mask covers the contents of assistant turns.

Escaping is reversible: in a text, ``<``, any number of backslashes and ``|`` get one backslash more, so no text can
hold a control string; reading takes one away. Line ends in a role are written ``\\n``, backslashes doubled.

Defined results: a null text is empty, a null role is an empty role, a null part is left out. Turns are ordered by turn number (null first), then role and
text; repeated rows are turns of their own. Turns without a conversation id form one conversation. An empty table
gives an empty result. One conversation is one output row and so is made in one task; collecting combines before the shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
_PATCH, _AUDIO_RATE, _PAGE_TOKENS = 14, 25, 1024


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Flattener:
    """Visits parts in order and gathers text, attachments and expanded token counts."""

    turn: int = 0
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    n_tokens: int = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['kind'] or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        text = part["text"] or ""
        self.pieces.append(escape(text))
        self.n_tokens += len(text.split())

    def _attach(self, part: dict, tokens: int) -> None:
        place = len(self.pieces)
        self.pieces.append(f"<|{part['kind']}:{self.turn}.{place}|>")
        self.attachments.append({"kind": part["kind"], "ref": part["ref"], "turn": self.turn, "place": place, "n_tokens": tokens})
        self.n_tokens += tokens

    def visit_image(self, part: dict) -> None:
        self._attach(part, math.ceil((part["width"] or 0) / _PATCH) * math.ceil((part["height"] or 0) / _PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil((part["seconds"] or 0) * _AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part["pages"] or 0) * _PAGE_TOKENS)

    def visit_other(self, part: dict) -> None:
        raise ValueError(f"no kind of content part: {part['kind']!r}")


def write(turns: list[dict]) -> dict:
    """Formatted text, loss spans (code points), attachments and expanded token count of ordered turns (role, parts)."""
    out, spans, attachments, n_tokens, at = [], [], [], 0, 0
    for number, turn in enumerate(turns):
        seen = Flattener(number)
        for part in turn["parts"] or ():
            if part is not None:
                seen.visit(part)
        role, content = turn["role"] or "", "".join(seen.pieces)
        head = f"{START}{_role_out(role)}\n"
        out.append(f"{head}{content}{END}\n")
        if role == "assistant":
            spans.append({"from": at + len(head), "to": at + len(head) + len(content)})
        at += len(out[-1])
        attachments += seen.attachments
        n_tokens += seen.n_tokens
    return {"formatted": "".join(out), "loss_spans": spans, "attachments": attachments, "n_tokens": n_tokens}


def read(formatted: str) -> list[tuple[str, str]]:
    """(role, content) of each turn; placeholders stay as they are written."""
    turns = []
    for piece in formatted.split(START)[1:]:
        role, _, content = piece.partition("\n")
        turns.append((_role_in(role), unescape(content.removesuffix("\n").removesuffix(END))))
    return turns


def loss_text(formatted: str, spans: list[dict]) -> str:
    return "".join(unescape(formatted[s["from"] : s["to"]]) for s in spans)


SCHEMA = (
    "n_turns bigint, formatted string, loss_spans array<struct<`from`:bigint,`to`:bigint>>, "
    "attachments array<struct<kind:string,ref:string,turn:bigint,place:bigint,n_tokens:bigint>>, n_tokens bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def text_part(text: Column) -> Column:
    """A text column as the parts of a turn."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()])).cast(PARTS)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, parts)."""
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "parts"))).alias("turns"))
    conv = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}"
    lists = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    refs = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("turn", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64())]))

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                made = [write(row) for row in part.column(1).to_pylist()]
                back = [read(m["formatted"]) for m in made]
                lost = [loss_text(m["formatted"], m["loss_spans"]) for m in made]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(b) for b in back], pa.int64()), pa.array([m["formatted"] for m in made], pa.string()), pa.array([m["loss_spans"] for m in made], lists),
                        pa.array([m["attachments"] for m in made], refs), pa.array([m["n_tokens"] for m in made], pa.int64()),
                        pa.array([hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in b).encode()).hexdigest() for b in back]), pa.array([len(t) for t in lost], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in lost]), pa.array([len(m["formatted"]) for m in made], pa.int64()),
                    ],
                    names=["conv_id", "n_turns", "formatted", "loss_spans", "attachments", "n_tokens", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
                )

    return whole.mapInArrow(run, f"{conv}, {SCHEMA}")
