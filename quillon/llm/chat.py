"""Chat formatting with typed content parts.

A message is a list of parts: text, image, audio, document. A visitor flattens the parts, in order,
into text with placeholders, and records for each attachment its reference and the number of tokens
that its placeholder expands to. The template marks turns with control strings; the same strings
inside texts are escaped by backslashes, which ``parse`` takes back exactly, so that a placeholder in
a text is told from one that stands for an attachment.

A conversation's turns are sorted, not gathered: rows are dealt by conversation and streamed, so a
task holds one conversation at a time, and hands formatted ones on in batches.

Defined cases: a null or empty text is an empty turn, as are no parts; a null role is the empty role;
a null conversation id is one conversation; rows with equal turns go by role, then content, each kept;
a null part, a part of an unknown kind and content that is no list of parts give no text and are
recorded as problems; sizes of attachments that are missing or not positive count as the least; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import in_small_batches, map_frames

#: Control strings, escaped inside texts: the template's own and those of common chat templates.
TURN, ROLE_END, END = "<|turn|>", "<|text|>", "</s>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROLS = (TURN, ROLE_END, END, *PLACEHOLDERS.values(), "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_ANY = "|".join(map(re.escape, CONTROLS))
_ESCAPE, _UNESCAPE = re.compile(rf"(\\*)({_ANY}|\Z)"), re.compile(rf"(\\+)({_ANY}|\Z)")
_CONTROL = re.compile(rf"(?<!\\)(?:\\\\)*({_ANY})")

#: What attachments expand to: tokens for an image patch of this side, a second of audio, a page of a document.
IMAGE_PATCH, AUDIO_TOKENS_PER_SECOND, DOCUMENT_TOKENS_PER_PAGE = 28, 25, 400

#: A content part; what a kind doesn't use is null.
PART = "struct<type:string,text:string,ref:string,width:double,height:double,seconds:double,pages:double>"
FORMATTED = (
    "conv_id bigint, formatted string, loss array<struct<start:bigint,end:bigint>>, attachments array<struct<turn:bigint,kind:string,ref:string,tokens:bigint>>, "
    "expanded_tokens bigint, problems array<struct<turn:bigint,problem:string>>"
)
#: Conversations, and characters of them, that a task hands on at a time.
BATCH_ROWS, BATCH_CHARS = 500, 4 << 20


def escape(text: str) -> str:
    """k backslashes before a control string become 2k + 1, at the end of the text 2k."""
    return _ESCAPE.sub(lambda m: m[1] * 2 + ("\\" + m[2] if m[2] else ""), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


class PartVisitor:
    """Flattens parts into escaped text; placeholders are control strings that stay as they are.

    What can't be flattened is noted in ``problems`` and gives no text; without such a list it is an error.
    """

    def __init__(self, problems: list[str] | None = None) -> None:
        self.attachments: list[tuple[str, str, int]] = []
        self.problems = problems

    def visit(self, part: dict | str) -> str:
        if isinstance(part, str):
            return escape(part)
        if not isinstance(part, dict):
            return self._problem("a part that is no object")
        method = getattr(self, f"visit_{part.get('type')}", None)
        return method(part) if method else self._problem(f"unknown content part {part.get('type')!r}")

    def visit_text(self, part: dict) -> str:
        return escape(str(part.get("text") or ""))

    def visit_image(self, part: dict) -> str:
        return self._attach("image", part, self._units(part, "width", IMAGE_PATCH) * self._units(part, "height", IMAGE_PATCH))

    def visit_audio(self, part: dict) -> str:
        return self._attach("audio", part, self._units(part, "seconds", 1 / AUDIO_TOKENS_PER_SECOND))

    def visit_document(self, part: dict) -> str:
        return self._attach("document", part, self._units(part, "pages", 1) * DOCUMENT_TOKENS_PER_PAGE)

    def _units(self, part: dict, size: str, unit: float) -> int:
        """How many units a size takes up, one at least."""
        value = part.get(size)
        if value is not None and not (isinstance(value, (int, float)) and math.isfinite(value)):
            self._problem(f"{size} of {part.get('type')} is no number")
            value = None
        return max(1, math.ceil((value or 0) / unit - 1e-9))

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        self.attachments.append((kind, str(part.get("ref") or ""), tokens))
        return PLACEHOLDERS[kind]

    def _problem(self, problem: str) -> str:
        if self.problems is None:
            raise ValueError(problem)
        self.problems.append(problem)
        return ""


def format_turns(turns: list[tuple[str, list]], trained: tuple[str, ...] = ("assistant",), problems: list[tuple[int, str]] | None = None) -> tuple[str, list, list]:
    """(role, parts) turns -> the formatted string, loss spans [start, end) in it, attachments (turn, kind, ref, tokens).

    A part is a dict, or a text. problems: gets (turn, problem) of what can't be flattened; without it that is an error.
    """
    out, at, loss, attachments = [], 0, [], []
    for i, (role, parts) in enumerate(turns):
        visitor = PartVisitor(None if problems is None else [])
        head, body = TURN + quote(role, safe="") + ROLE_END, "".join(map(visitor.visit, parts))
        at += len(head)
        if role in trained:
            loss.append((at, at + len(body)))
        at += len(body) + len(END)
        out += [head, body, END]
        attachments += [(i, *a) for a in visitor.attachments]
        if problems is not None:
            problems += [(i, p) for p in visitor.problems]
    return "".join(out), loss, attachments


def parse_parts(formatted: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """The turns of a formatted string: role, and (kind, text) of each part; an attachment has no text."""
    kinds = {p: k for k, p in PLACEHOLDERS.items()}
    turns, role, start, parts = [], None, 0, []

    def said(end: int) -> None:
        if end > start:
            parts.append(("text", unescape(formatted[start:end])))

    for m in _CONTROL.finditer(formatted):
        if m[1] == TURN:
            start = m.end()
        elif m[1] == ROLE_END:
            role, start, parts = unquote(formatted[start : m.start(1)]), m.end(), []
        elif m[1] == END:
            said(m.start(1))
            turns.append((role, parts))
        elif m[1] in kinds:
            said(m.start(1))
            parts.append((kinds[m[1]], ""))
            start = m.end()
    return turns


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted string; attachments have no text."""
    return [(role, "".join(text for _, text in parts)) for role, parts in parse_parts(formatted)]


def text_part(text: Column) -> Column:
    """An array of PART with a text as its only one."""
    unused = [F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "double"), ("height", "double"), ("seconds", "double"), ("pages", "double"))]
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *unused))


def parts_of(content: str | list | None) -> tuple[list, str | None]:
    """The parts of a message's content, and what is wrong with it. A string is a JSON list of parts, or one part."""
    if content is None or content == "":
        return [], None
    if isinstance(content, str):
        try:
            content = json.loads(content)
        except ValueError:
            return [], "content is no JSON"
        if isinstance(content, (dict, str)):
            content = [content]
        if not isinstance(content, list):
            return [], "content is no list of parts"
    return content, None


def format_conversations(messages: DataFrame, content: str = "parts", conv_id: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """One row of FORMATTED for each conversation. content: an array of PART, or a JSON list of parts as text."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r["conv_id"], r["role"] or "", r["content"]) for b in batches for r in b.to_pylist())
        held, chars = [], 0
        for conv, own in groupby(rows, key=lambda x: x[0]):
            turns, wrong = [], []
            for i, (_, who, said) in enumerate(own):
                parts, problem = parts_of(said)
                turns.append((who, parts))
                wrong += [(i, problem)] if problem else []
            text, loss, attachments = format_turns(turns, problems=wrong)
            attached = [dict(zip(("turn", "kind", "ref", "tokens"), a, strict=True)) for a in attachments]
            problems = [{"turn": i, "problem": p} for i, p in sorted(wrong)]
            held.append((conv, text, [{"start": a, "end": b} for a, b in loss], attached, sum(a["tokens"] for a in attached), problems))
            chars += len(text)
            if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield table(held)
                held, chars = [], 0
        if held:
            yield table(held)

    schema = to_arrow_schema(StructType.fromDDL(FORMATTED))
    rows = messages.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "content").select("conv_id", "role", "content")
    return in_small_batches(dealt).mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the formatted strings alone."""
    columns = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for conv, text, loss in zip(b["conv_id"], b["formatted"], b["loss"], strict=True):
                turns, sha = parse(text), hashlib.sha256()
                for role, said in turns:
                    sha.update(f"{role}\n{said}\n".encode())
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                rows.append((conv, len(turns), sha.hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return map_frames(formatted.select("conv_id", "formatted", "loss"), run, columns)


def oracle() -> str:
    any_ = "|".join(re.sub(r"([\[\]|/])", r"\\\1", c) for c in CONTROLS).replace("'", "''")
    return rf"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(t) + length(regexp_extract(t, '\\*$')) + coalesce(list_sum(list_transform(regexp_extract_all(t, '\\*(?:{any_})'), lambda x: length(regexp_extract(x, '^\\*')) + 1)), 0) AS n FROM m)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum({len(TURN + ROLE_END + END)} + length(role) + n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
