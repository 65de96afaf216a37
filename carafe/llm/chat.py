r"""Chat formatting of typed content parts, with a reversible template and a loss mask.

A turn's content is a list of parts (text, image, audio, document). A visitor flattens it into one string: text is escaped,
an attachment becomes an ordered placeholder ``<image 0>`` whose number is its place in the conversation, and its reference and
expanded token count are recorded. A turn is written ``### role: content</turn>\n``. In texts, roles and types a backslash goes before
each backslash, ``#``, ``<`` and ``:`` in roles, so no text can forge a mark, and ``read_back`` gets every part back. The loss
mask holds the escaped text of each assistant text part.

Scale. One shuffle by conversation; a conversation is formatted as a row in Arrow batches. One conversation is one output string, so
its size bounds a row; nothing else is gathered.

Defined results: turns are ordered by turn (null first), then role and content, so repeated rows and ties have a fixed order and stay. A
null role or text is empty. A null part list is one empty text. An unknown part type keeps its text as text. Null conversation
ids are left out. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import one_row_per_document

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
FORMATTED = "conv_id long, formatted string, loss array<struct<start:int,end:int>>, attachments array<struct<kind:string,ref:string,place:int,tokens:int>>, n_turns int, expanded_tokens long"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_ATTACHMENT = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("place", pa.int32()), ("tokens", pa.int32())])
_FORMATTED_ARROW = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(_SPAN)), ("attachments", pa.list_(_ATTACHMENT)), ("n_turns", pa.int32()), ("expanded_tokens", pa.int64())])
_SPECIAL = re.compile(r"[\\#<]")
_SPECIAL_ROLE = re.compile(r"[\\#<:]")
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<]|<(?:image|audio|document) \d+>)*)</turn>\n", re.S)
_PIECE = re.compile(r"<(image|audio|document) (\d+)>")


def escape(text: str, special: re.Pattern = _SPECIAL) -> str:
    return special.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def image_tokens(part: dict, tile: int = 512, per_tile: int = 170, base: int = 85) -> int:
    return base + per_tile * math.ceil((part.get("width") or 1) / tile) * math.ceil((part.get("height") or 1) / tile)


def audio_tokens(part: dict, per_second: float = 25.0) -> int:
    return max(1, math.ceil((part.get("seconds") or 0.0) * per_second))


def document_tokens(part: dict, per_page: int = 800) -> int:
    return per_page * max(1, part.get("pages") or 1)


class Flatten:
    """Visits the parts of one conversation in order."""

    def __init__(self, count: Callable[[str], int]):
        self.out: list[str] = []
        self.at = self.tokens = 0
        self.loss: list[dict] = []
        self.attachments: list[dict] = []
        self.count, self.learn = count, False

    def write(self, piece: str) -> None:
        self.out.append(piece)
        self.at += len(piece)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        start = self.at
        self.write(escape(text))
        self.tokens += self.count(text)
        if self.learn and self.at > start:
            self.loss.append({"start": start, "end": self.at})

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        place = len(self.attachments)
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "place": place, "tokens": tokens})
        self.tokens += tokens
        self.write(f"<{kind} {place}>")

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, image_tokens(part))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, audio_tokens(part))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, document_tokens(part))

    def turn(self, role: str, parts: list[dict]) -> None:
        self.write(f"### {escape(role, _SPECIAL_ROLE)}: ")
        self.learn = role == "assistant"
        for part in parts:
            self.visit(part)
        self.write("</turn>\n")


def words(text: str) -> int:
    return len(text.split())


def format_turns(turns: list[dict], count: Callable[[str], int] = words) -> Flatten:
    """turns: dicts with role and either parts or text."""
    seen = Flatten(count)
    for turn in turns:
        seen.turn(turn.get("role") or "", [p or {} for p in turn.get("parts") or [{"type": "text", "text": turn.get("text")}]])
    return seen


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; attachments stand in the text as their placeholders, bare."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not in this template at {at}")
        pieces, end, body = [], 0, m[2]
        for p in re.finditer(r"\\.|<(?:image|audio|document) \d+>", body, re.S):
            pieces.append(body[end : p.start()])
            pieces.append(p[0][1:] if p[0][0] == "\\" else p[0])
            end = p.end()
        turns.append((unescape(m[1]), "".join(pieces) + body[end:]))
        at = m.end()
    return turns


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {f.name: [] for f in _FORMATTED_ARROW}
        for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen = format_turns(turns)
            for name, value in zip(rows, (conv_id, "".join(seen.out), seen.loss, seen.attachments, len(turns), seen.tokens)):
                rows[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _FORMATTED_ARROW], schema=_FORMATTED_ARROW)


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (character spans), attachments, n_turns, expanded_tokens.

    With ``parts_col`` (an array of ``PART`` structs) the content is typed parts, else the text column is one text part.
    """
    content: Column = F.col(parts_col).alias("parts") if parts_col else F.col(text_col).cast("string").alias("text")
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), content)
    whole = one_row_per_document(turns, id_col).groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.mapInArrow(_format, FORMATTED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    for batch in batches:
        rows = []
        for conv_id, formatted, loss in zip(*(batch.column(i).to_pylist() for i in range(3))):
            turns = read_back(formatted)
            told = sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode())
            learnt = "".join(unescape(formatted[s["start"] : s["end"]]) for s in loss)
            rows.append((conv_id, len(turns), told.hexdigest(), len(learnt), sha256(learnt.encode()).hexdigest(), len(formatted)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)


def digests(formatted: DataFrame) -> DataFrame:
    """What ``formatted`` says when read back: counts and digests of its turns and of the text under the loss mask."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_digest, schema)
