"""Operator 5: chat formatting with a grammar round trip.

    record = turn*
    turn   = "<|im_start|>" role "\\n" body "<|im_end|>" "\\n"

A body ends at the first end mark; "<|", with which every control string begins, may stand
nowhere else in a role or a body. "<", k backslashes and "|" stand for "<", k - 1
backslashes and "|" if k > 0; in a role "\\\\" stands for a backslash and "\\n" for a line
end. A conversation is rendered as it is and parsed again; turns at which the grammar fails or
that come back changed are escaped, until all turns come back as they were. Escaped text holds
no "<|", so it always does, and no rendered role or body ever holds a control string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm._shared import frugal

START, END = "<|im_start|>", "<|im_end|>"
#: With which every control string begins.
OPEN = "<|"
PLAIN, MARKED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
FORMATTED = "conv_id long, text string, loss array<struct<start:long,end:long>>"

Turn = tuple[str, str]


def escape(text: str) -> str:
    return PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return MARKED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _turns(text: str) -> tuple[list[Turn], bool]:
    """The turns of a record up to where the grammar fails, and whether it fits to the end."""
    turns, at = [], 0
    while at < len(text):
        line = text.find("\n", at)
        end = text.find(END, line)
        if not text.startswith(START, at) or line < 0 or end < 0 or not text.startswith("\n", end + len(END)):
            return turns, False
        if text.find(OPEN, at + len(START), end) >= 0:
            return turns, False
        turns.append((_unescape_role(text[at + len(START) : line]), unescape(text[line + 1 : end])))
        at = end + len(END) + 1
    return turns, True


def parse(text: str) -> list[Turn] | None:
    """The turns of a record, or None if the grammar does not fit."""
    turns, fits = _turns(text)
    return turns if fits else None


def _render(turns: list[Turn], escaped: set[int]) -> tuple[str, list[tuple[int, int]]]:
    parts, spans, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        if i in escaped:
            role, text = _escape_role(role), escape(text)
        head = f"{START}{role}\n"
        spans.append((at + len(head), at + len(head) + len(text)))
        parts += (head, text, END, "\n")
        at += len(head) + len(text) + len(END) + 1
    return "".join(parts), spans


def format_turns(turns: list[Turn], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The record and its loss mask: the spans, in code points, of the texts of role `learn`."""
    escaped: set[int] = set()
    while True:
        text, spans = _render(turns, escaped)
        back, fits = _turns(text)
        if fits and back == turns:
            return text, [s for s, (role, _) in zip(spans, turns) if role == learn]
        # From the first turn that came back changed on, or at which the grammar failed, what
        # escaping would change; turns before it came back as they were.
        wrong = next((i for i, (a, b) in enumerate(zip(back, turns)) if a != b), min(len(back), len(turns) - 1))
        more = {i for i in range(wrong, len(turns)) if (_escape_role(turns[i][0]), escape(turns[i][1])) != turns[i]} - escaped
        if not more:
            raise ValueError("escaped turns do not come back")
        escaped |= more


def format_conversations(rows: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, text, loss of the conversations of rows (conv_id, turn, role, text).

    Rows are ordered by turn, equal turns by role and text, null turns first; repeated rows
    are turns of their own. Null text or role: empty. Rows with null conv_id are one
    conversation. Empty table: no rows; other columns are not read. Rows are sorted within
    their partition and read as a stream: a task holds the conversation at hand only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        size, now, turns = 0, None, []
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if turns and conv != now:
                    done.append((now, *format_turns(turns, learn)))
                    size += len(done[-1][1])
                    turns = []
                    if size > 4_000_000:
                        yield _formatted(done)
                        done, size = [], 0
                now = conv
                turns.append((role, text))
        if turns:
            done.append((now, *format_turns(turns, learn)))
        if done:
            yield _formatted(done)

    ordered = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(frugal(run), FORMATTED)


def _formatted(done: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_pydict({
        "conv_id": pa.array([d[0] for d in done], pa.int64()),
        "text": pa.array([d[1] for d in done], pa.string()),
        "loss": pa.array([[{"start": a, "end": b} for a, b in d[2]] for d in done], span),
    })


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """What the records hold, read back from them by the parser and the loss mask."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                turns = parse(text)
                if turns is None:
                    raise ValueError(f"conversation {conv} is not a record")
                all_ = hashlib.sha256()
                for role, body in turns:
                    all_.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                out.append((conv, len(turns), all_.hexdigest(), len(learnt), hashlib.sha256(learnt.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            if out:
                conv, n, turns_, chars, learnt_, size = zip(*out)
                yield pa.RecordBatch.from_pydict({
                    "conv_id": pa.array(conv, pa.int64()), "n_turns": pa.array(n, pa.int64()), "turns_sha256": pa.array(turns_, pa.string()),
                    "loss_chars": pa.array(chars, pa.int64()), "loss_sha256": pa.array(learnt_, pa.string()), "formatted_chars": pa.array(size, pa.int64()),
                })

    return formatted.select("conv_id", "text", "loss").mapInArrow(frugal(run), schema)
