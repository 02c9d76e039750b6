"""Chat formatting by a template that is only ever called, never read.

A template is a function from (role, text) pairs to one string. The prefixes of a conversation are rendered one after the other; as long as
each output begins with the one before, what is new is the turn's span. Where an output changes what stood before, the template rewrites
history: the sample ends with the output before, and a new one begins in which only later turns are learnt, so that every learnt text
is learnt once, in the form in which it was rendered last before a change. Where a turn's text lies in its span is found by rendering the
turn with two other texts: what both share at the start and at the end is the template's.

Rendering all prefixes takes time with the square of a conversation's turns, as it must where nothing is known about the template; one
conversation, its rendering and that of one prefix are held at a time.

Defined results: turns are ordered by ``turn`` (null first), then role, then text; null roles and texts are empty; rows without conv_id are
one conversation; repeated rows are turns of their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import text_of

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_MARK, _ESCAPED, _TURN = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|"), re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ROLE = {"\\": "\\\\", "\n": "\\n"}
#: Texts that begin and end differently, to find the template's own characters.
PROBES = ("A", "b")

SCHEMA = (
    "conv_id long, sample int, formatted string, first_turn int, n_turns int, "
    "spans array<struct<turn:int,role:string,start:long,end:long,text_start:long,text_end:long>>, loss array<struct<start:long,end:long>>, rewritten_at long"
)


def escape(text: str) -> str:
    """No ``<|`` is left: between the two, one more backslash than there was."""
    return _MARK.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


def marked_turns(turns: Turns) -> str:
    """The template of the query: each turn between marks, its role on a line of its own, control strings escaped."""
    return "".join([f"{OPEN}{escape(re.sub(r'[\\\n]', lambda m: _ROLE[m[0]], role))}\n{escape(text)}{CLOSE}\n" for role, text in turns])


def read_turns(formatted: str) -> Turns:
    """The turns that ``marked_turns`` wrote."""
    role = lambda s: re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(s))
    found, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        found.append((role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return found


def common_prefix(a: str, b: str) -> int:
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def text_place(turns: Turns, k: int, render: Template, now: str) -> tuple[int, int] | None:
    """Where turn k's text stands in the rendering of the turns up to it; none where it can't be told."""
    one, two = (render([*turns[:k], (turns[k][0], probe)]) for probe in PROBES)
    head = common_prefix(one, two)
    tail = common_prefix(one[head:][::-1], two[head:][::-1])
    if head + tail > len(now) or now[:head] != one[:head] or now[len(now) - tail :] != one[len(one) - tail :]:
        return None
    return head, len(now) - tail


def located(turns: Turns, render: Template, learnt: Callable[[str], bool]) -> list[dict]:
    """The samples of a conversation: text, turn spans, learnt spans, and where the next turn rewrote it (null if none did)."""
    samples: list[dict] = []
    before = render([])
    spans, loss, first = [], [], 0
    for k, (role, _) in enumerate(turns):
        now = render(turns[: k + 1])
        start = len(before)
        if not now.startswith(before):
            start = common_prefix(before, now)
            if k > first:
                samples.append({"formatted": before, "first_turn": first, "n_turns": k, "spans": spans, "loss": loss, "rewritten_at": start})
            spans, loss, first = [s for s in spans if s["end"] <= start], [], k
        place = text_place(turns, k, render, now)
        spans.append({"turn": k, "role": role, "start": start, "end": len(now), "text_start": place and place[0], "text_end": place and place[1]})
        if place and learnt(role):
            loss.append({"start": place[0], "end": place[1]})
        before = now
    samples.append({"formatted": before, "first_turn": first, "n_turns": len(turns), "spans": spans, "loss": loss, "rewritten_at": None})
    return samples


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Turns]]:
    """Whole conversations from rows sorted by conv_id and turn; one is held at a time."""
    last, turns = None, []
    for batch in batches:
        for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if turns and conv_id != last:
                yield last, turns
                turns = []
            last = conv_id
            turns.append((role, text))
    if turns:
        yield last, turns


def format_conversations(table: DataFrame, render: Template = marked_turns, learnt: Callable[[str], bool] = "assistant".__eq__, chars: int = 4_000_000) -> DataFrame:
    """One row per sample, as in ``SCHEMA``: the formatted text, each turn's span and its text's, the learnt spans, and where the turn after the
    sample's last rewrote it. A template that only appends gives one sample per conversation."""
    kinds = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("sample", pa.int32()),
            ("formatted", pa.string()),
            ("first_turn", pa.int32()),
            ("n_turns", pa.int32()),
            ("spans", pa.list_(pa.struct([("turn", pa.int32()), ("role", pa.string()), *((x, pa.int64()) for x in ("start", "end", "text_start", "text_end"))]))),
            ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ("rewritten_at", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for conv_id, turns in conversations(batches):
            for i, sample in enumerate(located(turns, render, learnt)):
                held.append({"conv_id": conv_id, "sample": i} | sample)
                size += len(sample["formatted"])
            if size >= chars:
                yield pa.RecordBatch.from_pylist(held, kinds)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, kinds)

    rows = table.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text_of("role").alias("role"), text_of().alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def digests(samples: DataFrame) -> DataFrame:
    """What the formatted texts of ``marked_turns`` say when they are read back: turns by its marks, learnt texts by the loss spans."""
    schema = "conv_id long, sample int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                turns, learnt = read_turns(text), [unescape(text[x["start"] : x["end"]]) for x in loss]
                rows.append((len(turns), sha(x + "\n" for turn in turns for x in turn), sum(map(len, learnt)), sha(learnt), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns, kinds)], names)

    return samples.select("conv_id", "sample", "formatted", "loss").mapInArrow(run, schema)
