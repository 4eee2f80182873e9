"""Chat formatting with typed content parts.

A turn holds text, or JSON content: a list of typed parts, where a document may hold parts of its own. A visitor flattens the
parts in order: texts are escaped, an image, audio or document becomes a placeholder, and an attachment records what the
placeholder stands for and how many tokens it expands to. The turns of a conversation are then streamed in order into
formatted chunks with a loss mask, and ``read_back`` gets turns, parts and loss text from those chunks alone.

Control strings inside texts get one backslash behind their first character, and as many as they have already plus one, so
that every escaped text has exactly one original.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid.llm.runtime import ship, slices

#: What may not stand in a text unescaped: anything that opens like a mark here, and the marks of common chat formats.
_REST = r"(?:\||/?s>|</?SYS>>)"
ESCAPE = re.compile(rf"<(?=\\*{_REST})|\[(?=\\*/?INST\])")
UNESCAPE = re.compile(rf"<\\(?=\\*{_REST})|\[\\(?=\\*/?INST\])")

#: The role whose texts are learnt.
LEARNT = "assistant"
#: Marks of the template: a turn is TURN role SAYS text END.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Code points of a chunk, from which on the next turn starts another one: what a task holds of a long conversation.
CHUNK = 1 << 20


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: m[0][0], text)


@dataclass(frozen=True)
class Expansion:
    """How many tokens a placeholder stands for. Sizes that are missing or aren't positive numbers count as ``unknown``."""

    patch: int = 28  # pixels of an image patch's side
    audio_rate: float = 25.0  # tokens a second
    page: int = 512  # tokens of a document's page
    unknown: int = 256

    def image(self, part: dict) -> int:
        w, h = _size(part.get("width")), _size(part.get("height"))
        return math.ceil(w / self.patch) * math.ceil(h / self.patch) if w and h else self.unknown

    def audio(self, part: dict) -> int:
        s = _size(part.get("seconds"))
        return math.ceil(s * self.audio_rate) if s else self.unknown

    def document(self, part: dict) -> int:
        n = _size(part.get("pages"))
        return math.ceil(n) * self.page if n else self.unknown


def _size(x) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and 0 < x <= 1e9 else None


def _well_formed(text: str) -> str:
    """Lone surrogates, which JSON can escape but UTF-8 can't hold, become replacement characters."""
    return text.encode("utf-8", "surrogatepass").decode("utf-8", "replace")


class Flattener:
    """Visits the parts of one turn in order: ``pieces`` grows by escaped texts and placeholders, ``attachments`` by
    kind, ref, place in the flattened text and tokens. Texts without a placeholder between them are one text, and escaped as
    one, so that no control string arises where they meet."""

    kinds = ("image", "audio", "document")

    def __init__(self, expansion: Expansion):
        self.expansion, self.pieces, self.attachments, self.at, self.held = expansion, [], [], 0, []

    def text(self, text: str) -> None:
        self.held.append(_well_formed(text))

    def put(self, mark: str = "") -> None:
        """The texts held so far, and a mark."""
        self.pieces.append(done := escape("".join(self.held)) + mark)
        self.at, self.held = self.at + len(done), []

    def visit(self, parts: list) -> None:
        """Documents may nest to any depth, so open lists are kept on a stack."""
        open_lists = [iter(parts)]
        while open_lists:
            part = next(open_lists[-1], None)
            if part is None:
                open_lists.pop()
            elif isinstance(part, str):
                self.text(part)
            elif not isinstance(part, dict):
                self.text(json.dumps(part, ensure_ascii=False))
            elif part.get("type") in self.kinds:
                self.attach(part["type"], part)
                if part["type"] == "document" and isinstance(part.get("content"), list):
                    open_lists.append(iter([x for x in part["content"] if x is not None]))
            elif isinstance(part.get("text"), str):
                self.text(part["text"])
            else:
                self.text(json.dumps(part, ensure_ascii=False))

    def attach(self, kind: str, part: dict) -> None:
        self.put()
        ref = next((_well_formed(part[k]) for k in ("ref", "url", "path") if isinstance(part.get(k), str)), None)
        self.attachments.append({"kind": kind, "ref": ref, "at": self.at, "n_tokens": getattr(self.expansion, kind)(part)})
        self.put(f"<|{kind}|>")


def parts_of(text: str | None, content: str | None) -> list:
    """The parts of a turn: ``content`` where it is a JSON list, else the text as one part. Unreadable content is a text."""
    if content is None:
        return [text or ""]
    try:
        found = json.loads(content)
    except (ValueError, RecursionError):
        return [content]
    return [x for x in found if x is not None] if isinstance(found, list) else [content]


def format_turn(role: str | None, text: str | None, content: str | None, expansion: Expansion) -> tuple[str, int, int, list[dict]]:
    """(piece, start and end of the turn's text in it, attachments placed in the piece)."""
    flat = Flattener(expansion)
    try:
        flat.visit(parts_of(text, content))
    except RecursionError:  # parts of an unknown kind that nest too deep to be written as JSON
        flat = Flattener(expansion)
        flat.text(content)
    flat.put()
    head = f"{TURN}{escape(role or '')}{SAYS}"
    body = "".join(flat.pieces)
    for x in flat.attachments:
        x["at"] += len(head)
    return f"{head}{body}{END}", len(head), len(head) + len(body), flat.attachments


ATTACHMENT = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("n_tokens", pa.int64())])
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
FORMATTED = pa.schema(
    [("conv_id", pa.int64()), ("chunk", pa.int64()), ("text", pa.string()), ("loss", pa.list_(SPAN)), ("attachments", pa.list_(ATTACHMENT)), ("n_turns", pa.int64())]
)
FORMATTED_DDL = (
    "conv_id long, chunk long, text string, loss array<struct<start:long,end:long>>, "
    "attachments array<struct<kind:string,ref:string,at:long,n_tokens:long>>, n_turns long"
)


class _Chunk:
    """The chunk that is being filled; one for a task."""

    def __init__(self):
        self.conv, self.k, self.open = None, 0, False
        self._clear()

    def _clear(self) -> None:
        self.texts, self.loss, self.attachments, self.size = [], [], [], 0

    def row(self) -> tuple:
        done = (self.conv, self.k, "".join(self.texts), self.loss, self.attachments, len(self.texts))
        self._clear()
        return done

    def add(self, conv: int | None, turn: tuple[str, int, int, list[dict]], learnt: bool, most: int) -> Iterator[tuple]:
        """Gives the chunk before, where this turn starts another one."""
        new = not self.open or conv != self.conv
        if self.open and (new or self.size >= most):
            yield self.row()
            self.k += 1
        if new:
            self.conv, self.k, self.open = conv, 0, True
        piece, start, end, attached = turn
        if learnt:
            self.loss.append({"start": self.size + start, "end": self.size + end})
        self.attachments += [x | {"at": x["at"] + self.size} for x in attached]
        self.texts.append(piece)
        self.size += len(piece)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def format_chats(spark: SparkSession, turns: DataFrame, expansion: Expansion = Expansion(), chunk: int = CHUNK) -> DataFrame:  # noqa: B008
    """Conversations formatted for training: conv_id, chunk, text, loss, attachments, n_turns.

    ``turns`` has conv_id, turn, role, text and, if wanted, content (JSON). A conversation is one row, or, from ``chunk`` code
    points on, several rows that are cut between turns: their texts in order of ``chunk`` are the whole text. ``loss`` has the
    places of the learnt texts and ``attachments`` those of the placeholders, both as code points of the row's text.

    Turns are shuffled by conversation and sorted by turn, role and text (nulls first), then streamed: a task holds one chunk,
    however long a conversation is. A null text is empty, a null role has no name, turns without conv_id are a conversation of
    their own, repeated turns stay; other columns are left out, an empty table gives no rows."""
    ship(spark)
    content = F.col("content") if "content" in turns.columns else F.lit(None)
    keys = ["conv_id", "turn", "role", "text", "content"]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", content.cast("string").alias("content"))
    rows = rows.repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in keys))

    def run(batches):
        at = _Chunk()
        for batch in slices(batches):
            done = []
            for conv, _, role, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                done += at.add(conv, format_turn(role, text, parts, expansion), role == LEARNT, chunk)
            if done:
                yield _batch(done, FORMATTED)
        if at.open:
            yield _batch([at.row()], FORMATTED)

    return rows.mapInArrow(run, FORMATTED_DDL)


_MARKS = re.compile(r"<\|(turn|says|end|image|audio|document)\|>")


def read_turns(text: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(role, parts) of each turn of a formatted text; a part is ("text", text) or (kind, placeholder)."""
    role, parts, at = None, [], 0
    for m in _MARKS.finditer(text):
        between, mark = text[at : m.start()], m[1]
        at = m.end()
        if mark == "turn":
            if between or role is not None:
                raise ValueError("a turn starts inside another one")
            parts = []
        elif mark == "says":
            role = unescape(between)
        else:
            if role is None:
                raise ValueError("a text without a turn")
            if between:
                parts.append(("text", unescape(between)))
            if mark == "end":
                yield role, parts
                role = None
            else:
                parts.append((mark, m[0]))
    if at != len(text) or role is not None:
        raise ValueError("the text ends inside a turn")


DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
     ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("attachment_tokens", pa.int64())]
)
DIGEST_DDL = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_attachments long, attachment_tokens long"
)


class _Digest:
    """What a conversation's formatted chunks say, fed in order."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.said, self.learnt = conv, 0, sha256(), sha256()
        self.loss_chars = self.chars = self.attached = self.tokens = 0

    def feed(self, text: str, loss: list[dict], attachments: list[dict]) -> None:
        for role, parts in read_turns(text):
            self.turns += 1
            self.said.update(f"{role}\n{''.join(x for _, x in parts)}\n".encode())
        for span in loss:
            said = unescape(text[span["start"] : span["end"]])
            self.loss_chars += len(said)
            self.learnt.update(said.encode())
        self.chars += len(text)
        self.attached += len(attachments)
        self.tokens += sum(x["n_tokens"] for x in attachments)

    def row(self) -> tuple:
        return self.conv, self.turns, self.said.hexdigest(), self.loss_chars, self.learnt.hexdigest(), self.chars, self.attached, self.tokens


def read_back(spark: SparkSession, formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """A row for each conversation, read from its formatted chunks: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_attachments, attachment_tokens. Chunks are streamed, so a long conversation takes no more memory than
    a chunk. ``in_order`` says that they come straight from ``format_chats``, already together and in order. A text that
    isn't a formatted one raises; an empty table gives no rows."""
    ship(spark)
    rows = formatted.select("conv_id", "chunk", "text", "loss", "attachments")
    if not in_order:
        rows = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "chunk")

    def run(batches):
        now = None
        for batch in slices(batches):
            done = []
            for conv, _, text, loss, attachments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.feed(text, loss, attachments)
            if done:
                yield _batch(done, DIGEST)
        if now is not None:
            yield _batch([now.row()], DIGEST)

    return rows.mapInArrow(run, DIGEST_DDL)


#: Both turns of the conversation that the query adds.
PROBE = "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations`` and a probe of control strings, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNT).alias("role"), F.lit(PROBE).alias("text"))
    return read_back(spark, format_chats(spark, turns.unionByName(probe)), in_order=True)


_ESCAPED = r"""regexp_replace(regexp_replace({0}, '<(\\*)(\||/?s>|</?SYS>>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')"""
OP11_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, '{LEARNT}', '{PROBE}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{LEARNT}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = '{LEARNT}'), '')) AS loss_sha256,
  CAST(sum({len(TURN + SAYS + END)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens
FROM c GROUP BY conv_id
"""
