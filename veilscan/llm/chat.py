"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor
flattens them, in order, to text with placeholders, and records each
attachment's reference, place and expanded token count. Turns are framed by
control strings; control strings inside texts are escaped reversibly, so the
formatted text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut

START, END = "<|im_start|>", "<|im_end|>"
PIECE_CHARS = 1 << 20

_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """No control string is left: every one begins with <|, which becomes <\\| (a backslash becomes two)."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    """As a text, and on one line."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


@dataclass(frozen=True)
class Text:
    text: str

    def accept(self, visitor: Flattener) -> None:
        visitor.text(self)


@dataclass(frozen=True)
class Image:
    ref: str
    width: int = 0
    height: int = 0

    def accept(self, visitor: Flattener) -> None:
        visitor.attachment("image", self.ref, max(1, -(-self.width // visitor.patch) * -(-self.height // visitor.patch)))


@dataclass(frozen=True)
class Audio:
    ref: str
    seconds: float = 0

    def accept(self, visitor: Flattener) -> None:
        visitor.attachment("audio", self.ref, max(1, round(self.seconds * visitor.audio_rate)))


@dataclass(frozen=True)
class Document:
    ref: str
    pages: int = 1

    def accept(self, visitor: Flattener) -> None:
        visitor.attachment("document", self.ref, max(1, self.pages * visitor.page_tokens))


@dataclass
class Flattener:
    """The visitor: ordered text with placeholders, and what the placeholders stand for."""

    patch: int = 28
    audio_rate: float = 25
    page_tokens: int = 256
    out: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str, int, int]] = field(default_factory=list)
    size: int = 0

    def text(self, part: Text) -> None:
        self._put(escape(part.text))

    def attachment(self, kind: str, ref: str, tokens: int) -> None:
        self.attachments.append((kind, ref, self.size, tokens))
        self._put(f"<|{kind}_{len(self.attachments) - 1}|>")

    def _put(self, s: str) -> None:
        self.out.append(s)
        self.size += len(s)


def parse_parts(content: str) -> list[Text | Image | Audio | Document]:
    """A JSON array of {"type": ..., ...} objects; anything unknown is an error, never dropped."""
    made = {"text": lambda p: Text(p["text"]), "image": lambda p: Image(p["ref"], p.get("width", 0), p.get("height", 0)), "audio": lambda p: Audio(p["ref"], p.get("seconds", 0)), "document": lambda p: Document(p["ref"], p.get("pages", 1))}
    return [made[p["type"]](p) for p in json.loads(content)]


@dataclass
class Formatted:
    """Formatted turns, the spans of assistant texts (the loss mask), and attachments at their places."""

    text: str
    loss: list[tuple[int, int]]
    attachments: list[tuple[str, str, int, int]]


def format_turns(turns: Iterable[tuple[str, list]]) -> Formatted:
    out, loss, attachments, at = [], [], [], 0
    for role, parts in turns:
        visitor = Flattener()
        for part in parts:
            part.accept(visitor)
        head, body = f"{START}{escape_role(role)}\n", "".join(visitor.out)
        start = at + len(head)
        if role == "assistant":
            loss.append((start, start + len(body)))
        attachments += [(kind, ref, start + place, tokens) for kind, ref, place, tokens in visitor.attachments]
        out += [head, body, END, "\n"]
        at = start + len(body) + len(END) + 1
    return Formatted("".join(out), loss, attachments)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from formatted text; placeholders stay in the texts."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


class Digest:
    """What op5 returns, gathered from formatted pieces in order."""

    def __init__(self) -> None:
        self.turns, self.n, self.loss, self.loss_chars, self.chars = hashlib.sha256(), 0, hashlib.sha256(), 0, 0

    def add(self, text: str, loss: Iterable[tuple[int, int]]) -> None:
        for role, said in read_turns(text):
            self.n += 1
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        for a, b in loss:
            said = unescape(text[a:b])
            self.loss_chars += len(said)
            self.loss.update(said.encode("utf-8", "surrogatepass"))
        self.chars += len(text)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGEST = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ATTACHED = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("place", pa.int64()), ("tokens", pa.int64())]))
_PIECES = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("formatted", pa.string()), ("loss", _LOSS), ("attachments", _ATTACHED), ("inside", pa.bool_())])
_PIECES_SQL = "conv_id long, part long, seq long, formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<kind:string,ref:string,place:long,tokens:long>>, inside boolean"
_READ = pa.schema([("conv_id", pa.int64()), *_DIGEST, *[_PIECES.field(i) for i in range(1, 5)]])
_SQL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ_SQL = f"{_SQL}, part long, seq long, formatted string, loss array<struct<start:long,end:long>>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _runs(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, list]]]]:
    """(conversation, some of its turns); at most PIECE_CHARS of text are held."""
    key, held, size = None, [], 0
    for batch in frames:
        cols = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "content")]
        for conv, role, text, content in zip(*cols):
            if held and (conv != key or size > PIECE_CHARS):
                yield key, held
                held, size = [], 0
            key = conv
            held.append((role or "", [Text(text or "")] if content is None else parse_parts(content)))
            size += len(text or "") if content is None else len(content)
    if held:
        yield key, held


def _format(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formatted pieces in order; ``inside`` marks those of conversations that surely begin and end in this range."""
    part = TaskContext.get().partitionId()
    done: list[tuple] = []
    waiting: list[Formatted] = []
    conv_of, first, reaches, seq = None, True, True, 0

    def rows(pieces: list[Formatted], inside: bool) -> list[tuple]:
        nonlocal seq
        out = []
        for p in pieces:
            out.append((conv_of, part, seq, p.text, [{"start": a, "end": b} for a, b in p.loss], [dict(zip(("kind", "ref", "place", "tokens"), x)) for x in p.attachments], inside))
            seq += 1
        return out

    for conv, turns in _runs(frames):
        if first or conv != conv_of:
            done += rows(waiting, True)  # what waited has ended in the range
            waiting, reaches, conv_of, seq = [], first, conv, 0  # the first one may have begun in an earlier range
        first = False
        waiting.append(format_turns(turns))
        if reaches or sum(len(p.text) for p in waiting) > 8 * PIECE_CHARS:  # long: as if it reached a border
            reaches = True
            done += rows(waiting, False)
            waiting = []
        if sum(len(r[3]) for r in done) > PIECE_CHARS or len(done) >= 1000:
            yield _batch(done, _PIECES)
            done = []
    yield _batch(done + rows(waiting, False), _PIECES)  # the last one may go on in a later range


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text and, or instead, content) -> (conv_id, part, seq, formatted, loss, attachments, inside).

    ``content`` is a JSON array of typed parts; where it is not null it takes
    the place of text. An unknown part fails the job; none is dropped.
    A conversation's formatted text is its pieces in the order of (part, seq):
    one piece, unless it is very long or lies on the border of two ranges.
    Places in loss (the assistant's texts, escaped) and attachments (kind,
    reference, placeholder's place, tokens it expands to) count characters from
    the piece's start. ``inside`` tells that a conversation has no piece in
    another range.

    Turns go by turn, then role, then text or content (nulls first), so ties
    and repeated rows have one order. Null role or text counts as empty; null
    conv_id rows are one conversation; extra columns are ignored. Rows are
    dealt by ranges of that order, so a conversation of any length is formatted
    by many tasks.
    """
    pick = lambda c: F.col(c).cast("string") if c in turns.columns else F.lit(None).cast("string")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", pick("role").alias("role"), pick("text").alias("text"), pick("content").alias("content"))
    said = F.left(F.coalesce("content", "text"), F.lit(64))
    dealt = rows.withColumn("said", said).repartitionByRange("conv_id", "turn", "role", "said").sortWithinPartitions("conv_id", "turn", "role", "said", "text", "content")
    return dealt.drop("said").mapInArrow(_format, _PIECES_SQL)


def _read_inside(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations that lie inside their range, read back from the pieces; the other pieces pass."""
    key, d = None, None
    for batch in frames:
        out = []
        for conv, part, seq, text, loss, inside in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "seq", "formatted", "loss", "inside"))):
            if d is not None and (not inside or conv != key):
                out.append((key, *d.row(), None, None, None, None))
                d = None
            if not inside:
                out.append((conv, None, None, None, None, None, part, seq, text, loss))
                continue
            if d is None:
                key, d = conv, Digest()
            d.add(text, [(x["start"], x["end"]) for x in loss])
        yield _batch(out, _READ)
    yield _batch([(key, *d.row(), None, None, None, None)] if d is not None else [], _READ)


def _join(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and place, streamed through one digest at a time."""
    key, d, out = None, None, []
    for batch in frames:
        for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
            if d is None or conv != key:
                if d is not None:
                    out.append((key, *d.row(), None, None, None, None))
                key, d = conv, Digest()
            d.add(text, [(x["start"], x["end"]) for x in loss])
    if d is not None:
        out.append((key, *d.row(), None, None, None, None))
    yield _batch(out, _READ).select([f.name for f in _READ][:6])


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conv_id of turns, read back from what ``format_conversations`` makes of them.

    A conversation that lies inside a range is digested there. Pieces of one
    that reaches a border meet in order in one stream, since a SHA-256 of a
    whole conversation can only be made in order; that stream holds one piece
    at a time.
    """
    made = cut(format_conversations(turns).mapInArrow(_read_inside, _READ_SQL))
    names = [c.split()[0] for c in _SQL.split(", ")]
    pieces = made.where("part is not null").select("conv_id", "part", "seq", "formatted", "loss")
    joined = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "formatted", "loss").mapInArrow(_join, _SQL)
    return made.where("part is null").select(*names).union(joined)
