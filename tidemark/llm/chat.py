"""Chat formatting with typed content parts.

A turn is a role and either a text or a list of typed parts (JSON). A visitor flattens the parts in order: text is
escaped, an image, audio clip or document becomes a placeholder and an attachment record with the number of tokens
that a model spends on it; a document's own parts are visited in their place. The template marks each turn:

    <turn ROLE>BODY</turn>\n

Every control string of the template begins with `<`. In texts and roles, backslash, `<` and `>` are preceded by a
backslash, so no text can form a control string, and removing the backslashes gives the text back. The loss mask covers
the bodies of the trained role's turns.

Scale. `format_turns` works row by row: no shuffle, and no conversation is gathered. Conversations are read back by
`read_back`, which deals turns by conversation, sorts each partition and streams over it with running digests, so
a conversation may have any number of turns (a SHA-256 over a conversation can only be taken in order, by one task).

Defined results. Null text is empty, null role an empty role; malformed parts, or parts nested deeper than the JSON reader goes, are text; sizes that are no
numbers up to 10^9 say nothing. Texts of any length stay whole; other columns, whatever their names, are not read; an empty table gives an empty result. Turns of equal number keep
all their rows, ordered by role and then formatted text; a null turn comes first; null conversation ids form one conversation."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPECIAL = re.compile(r"([\\<>])")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: A piece of a segment: an escaped character, a control string, or plain text.
PIECE = re.compile(r"\\.|<[^<>\\]*>|[^\\<]+", re.DOTALL)
HEADER = re.compile(r"<turn ((?:\\.|[^\\>])*)>", re.DOTALL)
END = "</turn>\n"

#: Tokens per image patch, second of audio and page of a document; fixed defaults of the visitor.
PATCH, AUDIO_TOKENS, PAGE_TOKENS = 28, 25, 512


def escape(text: str) -> str:
    return SPECIAL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


class PartVisitor:
    """Flattens typed parts into body text, attachments and the tokens they expand to."""

    def __init__(self) -> None:
        self.body: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: object) -> None:
        """Visits a part and, in its place, what its visit leaves to be visited: with a stack, so parts may nest to any depth."""
        waiting = [part]
        while waiting:
            part = waiting.pop()
            if isinstance(part, list):
                waiting += reversed(part)
            elif isinstance(part, dict):
                waiting.append({"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}.get(_told(part.get("type")), self.visit_other)(part))
            elif part is not None:
                self.body.append(escape(_told(part)))

    def visit_text(self, part: dict) -> object:
        return part.get("text")

    def visit_image(self, part: dict) -> None:
        wide, high = _number(part.get("width")), _number(part.get("height"))
        self.attach("image", part, max(1, math.ceil(wide / PATCH) * math.ceil(high / PATCH)))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, max(1, math.ceil(_number(part.get("seconds")) * AUDIO_TOKENS)))

    def visit_document(self, part: dict) -> object:
        """The placeholder, then the document's own parts, if it has any, in place of its pages."""
        inner = part.get("parts")
        self.attach("document", part, 0 if inner else max(1, math.ceil(_number(part.get("pages"))) * PAGE_TOKENS))
        return inner

    def visit_other(self, part: dict) -> None:
        self.attach("other", part, 0)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        at = len(self.attachments)
        ref = part.get("ref", part.get("url"))
        self.attachments.append({"position": at, "kind": kind, "ref": None if ref is None else _told(ref), "tokens": tokens})
        self.body.append(f"<{kind} {at}>")


#: A size beyond this says nothing, like one that is no number.
MOST_SIZE = 10**9
SURROGATE = re.compile("[\ud800-\udfff]")


def _number(value: object) -> float:
    return float(value) if isinstance(value, int | float) and 0 < value <= MOST_SIZE else 0.0


def _told(value: object) -> str:
    """Text of a JSON value; halves of surrogate pairs, which no UTF-8 can hold, become U+FFFD."""
    if not isinstance(value, str):
        try:
            value = json.dumps(value) if isinstance(value, dict | list) else str(value)
        except (ValueError, RecursionError):  # a number of too many digits, or nesting beyond what JSON can write
            value = "..."
    return SURROGATE.sub("\ufffd", value)


def _parts(raw: str | None) -> object:
    try:
        return json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return raw


def format_turn(role: str | None, text: str | None, parts: object = None) -> tuple[str, int, int, list[dict]]:
    """(segment, body start, body end, attachments)."""
    visitor = PartVisitor()
    visitor.visit(text)
    visitor.visit(parts)
    head, body = f"<turn {escape(role or '')}>", "".join(visitor.body)
    return head + body + END, len(head), len(head) + len(body), visitor.attachments


def body_text(body: str) -> str:
    """The text of a formatted body, without placeholders."""
    return "".join(p[1:] if p[0] == "\\" else "" if p[0] == "<" else p for p in PIECE.findall(body))


def read_turn(segment: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    head = HEADER.match(segment)
    if head is None or not segment.endswith(END):
        raise ValueError("not a formatted turn")
    return unescape(head[1]), body_text(segment[head.end() : -len(END)])


ATTACHMENT = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, trained_role: str = "assistant") -> DataFrame:
    """One row per turn: conv, turn, role, segment, loss (spans of segment in code points), attachments, attachment_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts, parts = (batch.column(i).to_pylist() for i in (2, 3, 4))
            done = [format_turn(r, t, _parts(p)) for r, t, p in zip(roles, texts, parts, strict=True)]
            loss = [[{"start": a, "end": b}] if r == trained_role else [] for r, (_, a, b, _) in zip(roles, done, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array([x[0] for x in done], pa.string()), pa.array(loss, pa.list_(SPAN)),
                    pa.array([x[3] for x in done], pa.list_(ATTACHMENT)), pa.array([sum(a["tokens"] for a in x[3]) for x in done], pa.int64()),
                ],
                ["conv", "turn", "role", "segment", "loss", "attachments", "attachment_tokens"],
            )

    parts = F.col(parts_col) if parts_col else F.lit(None)
    plain = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("t"), parts.cast("string").alias("p"))
    kinds = {c: plain.schema[c].dataType.simpleString() for c in ("conv", "turn")}
    return plain.mapInArrow(
        run,
        f"conv {kinds['conv']}, turn {kinds['turn']}, role string, segment string, loss array<struct<start: int, end: int>>,"
        " attachments array<struct<position: int, kind: string, ref: string, tokens: long>>, attachment_tokens long",
    )


def read_back(turns: DataFrame) -> DataFrame:
    """One row per conversation, from its formatted turns alone: n_turns, digests of turns and of the text under the mask, sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        for batch in batches:
            done = []
            for conv, segment, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = Conversation(conv)
                now.add(segment, loss)
            yield from out(done)
        yield from out([now.row()] if now else [])

    kind = turns.schema["conv"].dataType.simpleString()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def out(done: list[tuple]) -> Iterator[pa.RecordBatch]:
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done, strict=True)), strict=True)))

    dealt = turns.select("conv", "segment", "loss", "turn", "role").repartition("conv").sortWithinPartitions("conv", "turn", "role", "segment")
    return dealt.select("conv", "segment", "loss").mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


class Conversation:
    """Running digests over the turns of a conversation."""

    def __init__(self, conv: object) -> None:
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, loss: list[dict]) -> None:
        role, text = read_turn(segment)
        self.turns += 1
        self.chars += len(segment)
        self.all.update(f"{role}\n{text}\n".encode())
        for span in loss:
            masked = body_text(segment[span["start"] : span["end"]])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
