"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. The turns are rendered one prefix after the other; what
the next output adds to the one before is the span of the new turn. A probe text in its place shows where the turn's
text lies in that span. A template whose output does not begin with the output before has rewritten history: such
conversations are marked, and the spans of the new turn and of all text that was rewritten stay open.

A template sees the whole prefix at every turn, so a conversation is one segment, held whole, and its rendering grows
with the square of its turns. Only templates declared `turnwise`, which write every turn by itself, are rendered in
segments of at most `SEGMENT` turns (the template is told which is the first): joined, these are the template's output
of the whole. Time and memory per turn are then bounded, and a conversation is never held whole. Spark hands the turns
over in order.

Defined results: NULL texts and roles are empty. Turns with equal numbers are ordered by role and text, NULL numbers
come first, repeated rows are turns of their own. Texts may hold anything, template signs included. An empty table
gives an empty result; further columns are not read. NULL conversation ids form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrove.llm.common import read

Turn = tuple[str, str]
Template = Callable[[list[Turn], bool], str]

SEGMENT = 24

# Characters that no template and no escaping touches.
PROBE = "\ue000probe\ue001"

_CONTROL = re.compile(r"[\\#<]")
_ROLE_CONTROL = re.compile(r"[\\#<:\n]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
# One turn of marked_template: the signs outside the texts never stand escaped.
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<])*) </turn>\n", re.DOTALL)


def turnwise(template: Template) -> Template:
    """Declare that the output is the joined outputs of the turns, each of which depends on its turn alone."""
    template.turnwise = True
    return template


@turnwise
def marked_template(turns: list[Turn], first: bool) -> str:
    """`### role: text </turn>` lines; backslash, `#` and `<` in texts get a backslash before them."""
    return "".join(f"### {_ROLE_CONTROL.sub(r'\\\g<0>', role)}: {_CONTROL.sub(r'\\\g<0>', text)} </turn>\n"
                   for role, text in turns)


def parse_marked(formatted: str) -> list[Turn]:
    """The turns of `marked_template`, unescaped."""
    turns, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((_ESCAPED.sub(r"\1", turn[1]), _ESCAPED.sub(r"\1", turn[2])))
        at = turn.end()
    return turns


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Segment:
    """Successive prefixes of some turns, rendered one by one; of all turns unless the template is turnwise."""

    def __init__(self, template: Template, first: bool, segment: int) -> None:
        self.template, self.first = template, first
        self.limit = segment if getattr(template, "turnwise", False) else None
        self.turns: list[Turn] = []
        self.output = ""
        self.spans: list[tuple[int, int] | None] = []

    @property
    def full(self) -> bool:
        return len(self.turns) == self.limit

    def add(self, role: str, text: str) -> None:
        self.turns.append((role, text))
        after = self.template(self.turns, self.first)
        probe = self.template([*self.turns[:-1], (role, PROBE)], self.first)
        begin = probe.find(PROBE, len(self.output))
        tail = len(probe) - begin - len(PROBE)
        good = (begin >= len(self.output) and after.startswith(self.output) and probe[:begin] == after[:begin]
                and probe[begin + len(PROBE):] == after[len(after) - tail:])
        if not after.startswith(self.output):
            kept = len(commonprefix([after, self.output]))
            self.spans = [s if s is not None and s[1] <= kept else None for s in self.spans]
        self.spans.append((begin, len(after) - tail) if good else None)
        self.output = after


def format_turns(turns: Iterator[Turn], template: Template = marked_template, segment: int = SEGMENT
                 ) -> Iterator[tuple[str, list[tuple[int, int] | None], list[Turn]]]:
    """For each segment (one, unless the template is turnwise) its output, the span of every turn's text in it, and the turns."""
    current = Segment(template, True, segment)
    for role, text in turns:
        if current.full:
            yield current.output, current.spans, current.turns
            current = Segment(template, False, segment)
        current.add(role, text)
    if current.turns:
        yield current.output, current.spans, current.turns


class _Digest:
    """What is read back from a conversation's output, segment by segment."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.rewritten = False

    def take(self, output: str, spans: list, turns: list[Turn], trained: str) -> None:
        self.formatted_chars += len(output)
        for role, text in parse_marked(output):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
            self.n_turns += 1
        for span, (role, _) in zip(spans, turns):
            if span is None:
                self.rewritten = True
            elif role == trained:
                text = unescape(output[span[0]:span[1]])
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "replace"))

    def row(self, conv_id) -> tuple:
        return (conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.formatted_chars, self.rewritten)


REPORT = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, rewritten boolean")
_REPORT_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                           ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                           ("formatted_chars", pa.int64()), ("rewritten", pa.bool_())])
FORMATTED = "conv_id long, segment int, formatted string, spans array<struct<role:string,begin:int,end:int>>"
_FORMATTED_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("segment", pa.int32()), ("formatted", pa.string()),
    ("spans", pa.list_(pa.struct([("role", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])))])


def _conversations(batches: Iterator[pa.RecordBatch], template: Template, segment: int):
    """(conversation id, is it the last segment, its number, output, spans, turns), across batches."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")))

    current, number, conv_id, begun = None, 0, None, False
    for conv, role, text in rows():
        if begun and conv != conv_id:
            yield conv_id, True, number, current.output, current.spans, current.turns
            current = None
        if not begun or current is None:
            current, number, conv_id, begun = Segment(template, True, segment), 0, conv, True
        elif current.full:
            yield conv_id, False, number, current.output, current.spans, current.turns
            current, number = Segment(template, False, segment), number + 1
        current.add(role or "", text or "")
    if begun:
        yield conv_id, True, number, current.output, current.spans, current.turns


def _in_order(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation one after the other in one partition."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
                                F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, template: Template = marked_template, segment: int = SEGMENT,
                         rows: int = 500) -> DataFrame:
    """The formatted segments, with the span of each turn's text (NULL where the template rewrote history)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[dict] = []
        for conv, _, number, output, spans, turns in _conversations(batches, template, segment):
            part.append({"conv_id": conv, "segment": number, "formatted": output, "spans": [
                {"role": role, "begin": None if s is None else s[0], "end": None if s is None else s[1]}
                for s, (role, _) in zip(spans, turns)]})
            if len(part) == rows:
                yield pa.RecordBatch.from_pylist(part, _FORMATTED_ARROW)
                part = []
        yield pa.RecordBatch.from_pylist(part, _FORMATTED_ARROW)

    return _in_order(conversations).mapInArrow(run, FORMATTED)


def conversation_digests(conversations: DataFrame, trained: str = "assistant", segment: int = SEGMENT,
                         rows: int = 2000) -> DataFrame:
    """One row per conversation with what is read back from its formatted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(part: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*part)) or [[]] * len(_REPORT_ARROW)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _REPORT_ARROW)], schema=_REPORT_ARROW)

        part: list[tuple] = []
        digest = _Digest()
        for conv, last, _, output, spans, turns in _conversations(batches, marked_template, segment):
            digest.take(output, spans, turns, trained)
            if last:
                part.append(digest.row(conv))
                digest = _Digest()
            if len(part) == rows:
                yield packed(part)
                part = []
        yield packed(part)

    return _in_order(conversations).mapInArrow(run, REPORT)


# A conversation whose texts hold the template's own signs.
HARD_ID, HARD_TEXT = -7, r"\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    conversations = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(HARD_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    return conversation_digests(conversations.unionByName(hard))


SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ') + length(regexp_replace(role, '([\\#<:\n])', '\\\1', 'g')) + length(': ')
                + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + length(' </turn>') + 1) AS BIGINT)
           AS formatted_chars,
       false AS rewritten
FROM turns GROUP BY conv_id"""
