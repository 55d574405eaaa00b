"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. Rendering the first, the first two, the
first three turns and comparing each output with the one before shows which characters each turn
added: its span. An output that does not begin with the one before shows a template that rewrites
history, which is reported, since the spans of earlier turns would be wrong. Rendering a turn once more
with a mark in place of its text shows which of its characters are the text: the loss mask.

Whole prefixes are rendered of a template of which nothing else is known, one conversation at a time in
one task; that costs the square of the number of turns. A template may declare its ``memory``: the
number of turns before a turn on which that turn's characters depend (the shipped one: none). Then
windows of ``WINDOW`` turns after those are rendered, at a cost in proportion to the conversation and in
bounded memory; where a window ends, the next turn is rendered after both the old and the new window,
and a difference, which refutes the declaration, is reported like a rewriting (what only shows after
more turns than a window holds is not seen: that is what the declaration excludes). Without memory a
conversation can be cut anywhere: turns are range-partitioned by conversation and turn, and a
conversation over several partitions comes together only as its formatted text, for the digests, which
need one pass in order and constant memory. So results do not depend on the partitioning.

The shipped template writes ``<s>[INST] role\\n text [/INST]</s>``-like marks; control strings inside
roles and texts are escaped with a backslash, reversibly, so the output can be read back by itself.

Results in odd cases: a null text or role is empty; turns come by number (nulls first), then role
and text, so repeated rows are turns of their own; a null conv_id is a conversation of its own; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, shuffle_partitions

WINDOW = 16
MARK = "\ue000"
CONTROL = re.compile(r"\\|</?s>|\[/?INST\]")
ESCAPED = re.compile(r"\\(\\|</?s>|\[/?INST\])")
#: a turn as it stands in formatted text; inside, control strings come after a backslash only
_INSIDE = r"((?:[^\\<\[]++|\\(?:\\|</?s>|\[/?INST\])|<(?!/?s>)|\[(?!/?INST\]))*+)"
TURN = re.compile(r"<s>\[INST\]" + _INSIDE + r"\[/INST\]" + _INSIDE + r"</s>")

Turn = tuple[str, str]


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def marked_template(turns: list[Turn]) -> str:
    """The role between the instruction marks, the text up to the end mark."""
    return "".join(f"<s>[INST]{escape(role)}[/INST]{escape(text)}</s>" for role, text in turns)


def read_back(formatted: str) -> Iterator[Turn]:
    """The turns of text that the shipped template wrote."""
    at = 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        body = m[0]
        middle = m.start(2) - at
        yield unescape(body[len("<s>[INST]") : middle - len("[/INST]")]), unescape(body[middle : -len("</s>")])
        at = m.end()


@dataclass(frozen=True)
class Template:
    """A rendering; the turns that a turn's characters depend on (None: not known); how its output is
    read back to turns, and a masked text to what it was (None: it cannot be)."""

    render: Callable[[list[Turn]], str]
    memory: int | None = None
    read: Callable[[str], Iterable[Turn]] | None = None
    plain: Callable[[str], str] = str


MARKED = Template(marked_template, 0, read_back, unescape)


@dataclass
class Span:
    """What a turn added to the output, from ``start`` on; the place of its text in that, if it can be
    told; ``rewrites`` if the output before it changed."""

    start: int
    added: str
    text: tuple[int, int] | None
    rewrites: bool


def _text_in(added: str, marked: str) -> tuple[int, int] | None:
    """Where the text is in what a turn added, from the same with a mark as its text."""
    before, found, behind = marked.partition(MARK)
    if not found or MARK in behind or len(added) < len(before) + len(behind) or not (added.startswith(before) and added.endswith(behind)):
        return None
    return len(before), len(added) - len(behind)


def spans(turns: Iterable[Turn], template: Template, role: str | None = "assistant") -> Iterator[Span]:
    """The span of each turn, and in turns of ``role`` that of the text (None: in all)."""
    render, memory = template.render, template.memory
    window: list[Turn] = []
    old, length = "", 0
    for turn in turns:
        new = render([*window, turn])
        kept = new.startswith(old)
        start = len(old) if kept else len(commonprefix([old, new]))
        if memory is not None and len(window) >= WINDOW + memory:
            window = window[len(window) - memory :] if memory else []
            old = render(window) if window else ""
            again = render([*window, turn])
            kept = kept and again.startswith(old) and again[len(old) :] == new[start:]
            new, start = again, len(commonprefix([old, again]))
        where = None
        if role is None or turn[0] == role:
            marked = render([*window, (turn[0], MARK)])
            where = _text_in(new[start:], marked[start:]) if marked[:start] == new[:start] else None
        added = new[start:]
        yield Span(start if memory is None else length, added, where, not kept)
        length += len(added)
        window.append(turn)
        old = new


SPANS = "array<struct<start: int, end: int, text_start: int, text_end: int, rewrites: boolean>>"
PART = f"conv_id long, task int, part int, whole boolean, formatted string, spans {SPANS}"
PART_CHARS = 1 << 18
DONE = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("rewrites", pa.bool_())]))
_PART = [("conv_id", pa.int64()), ("task", pa.int32()), ("part", pa.int32()), ("whole", pa.bool_()), ("formatted", pa.string()), ("spans", _SPANS)]
_DONE = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.int64())]


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, schema)], [n for n, _ in schema])


def _ordered(rows) -> Iterator[tuple]:
    for batch in rows:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _place(s: Span, at: int) -> dict:
    a, b = s.text or (None, None)
    return {"start": at, "end": at + len(s.added), "text_start": None if s.text is None else at + a, "text_end": None if s.text is None else at + b, "rewrites": s.rewrites}


def formatted_parts(turns: DataFrame, template: Template = MARKED) -> DataFrame:
    """conv_id, task, part, whole, formatted, spans: each conversation's output in order of task and part,
    with the span of each turn in its part and, of assistant turns, that of the text (the loss mask).
    Parts are of bounded size for templates with declared memory; ``whole`` tells that a conversation
    has this one part. A template that rewrites has the output for all turns, and the spans that each
    turn had when it came."""
    parts = shuffle_partitions(turns.sparkSession)
    cut = template.memory == 0  # a partition may begin inside a conversation

    def run(rows):
        task = TaskContext.get().partitionId()
        out: list[tuple] = []
        size = 0
        first = True
        flow = _ordered(rows)
        held = next(flow, None)
        while held is not None:
            conv = held[0]

            def same():
                nonlocal held
                while held is not None and held[0] == conv:
                    yield held[2] or "", held[3] or ""
                    held = next(flow, None)

            part = 0
            if template.memory is None:
                every = list(same())
                found = list(spans(every, template))
                out.append((conv, task, 0, True, template.render(every), [_place(s, s.start) for s in found]))
                size += len(out[-1][4])
            else:
                text: list[str] = []
                places: list[dict] = []
                length = 0
                for s in spans(same(), template):
                    places.append(_place(s, length))
                    text.append(s.added)
                    length += len(s.added)
                    if length >= PART_CHARS:
                        out.append((conv, task, part, False, "".join(text), places))
                        yield _batch(out, _PART)
                        out, size = [], 0
                        part, text, places, length = part + 1, [], [], 0
                alone = not part and not (cut and (first or held is None))  # else it may go on beside this partition
                out.append((conv, task, part, alone, "".join(text), places))
                size += length
            first = False
            if len(out) >= 512 or size >= PART_CHARS:
                yield _batch(out, _PART)
                out, size = [], 0
        yield _batch(out, _PART)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(parts, F.col("conv_id"), F.col("turn")) if cut else rows.repartition(parts, "conv_id")
    return rows.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, PART)


class _Digest:
    """Running digests of a conversation's formatted text."""

    def __init__(self, template: Template):
        self.template = template
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.chars = self.loss_chars = self.rewrites = 0

    def add(self, formatted: str, places: list[dict]) -> None:
        self.chars += len(formatted)
        self.rewrites += sum(p["rewrites"] for p in places)
        if self.template.read:
            for role, text in self.template.read(formatted):
                self.n += 1
                self.turns.update(f"{role}\n{text}\n".encode())
        else:
            self.n += len(places)
        for p in places:
            if p["text_start"] is not None:
                text = self.template.plain(formatted[p["text_start"] : p["text_end"]])
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self, conv_id) -> tuple:
        return conv_id, self.n, self.turns.hexdigest() if self.template.read else None, self.loss_chars, self.loss.hexdigest(), self.chars, self.rewrites


def format_conversations(turns: DataFrame, template: Template = MARKED) -> DataFrame:
    """For each conversation, read back from its formatted text: conv_id, n_turns, turns_sha256 (role,
    line feed, text, line feed for each turn; null if the template has no reader), loss_chars,
    loss_sha256 (assistant texts, unescaped), formatted_chars, rewrites (turns at which the template
    rewrote history)."""
    made = materialize(formatted_parts(turns, template), "chat-parts")
    parts = shuffle_partitions(turns.sparkSession)

    def finish(rows):
        conv, digest, done = None, None, []
        for c, formatted, places in _ordered(rows):
            if digest is None or c != conv:
                if digest is not None:
                    done.append(digest.row(conv))
                conv, digest = c, _Digest(template)
            digest.add(formatted, places)
            if len(done) >= 512:
                yield _batch(done, _DONE)
                done = []
        if digest is not None:
            done.append(digest.row(conv))
        yield _batch(done, _DONE)

    one = made.filter("whole").select("conv_id", "formatted", "spans").mapInArrow(finish, DONE)
    cut = made.filter("NOT whole").select("conv_id", "task", "part", "formatted", "spans")
    cut = cut.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "task", "part").select("conv_id", "formatted", "spans")
    return one.union(cut.mapInArrow(finish, DONE))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(role, '(\\|</?s>|\[/?INST\])', '\\\1', 'g') AS er,
         regexp_replace(text, '(\\|</?s>|\[/?INST\])', '\\\1', 'g') AS et FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(er) + length(et) + 20)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
