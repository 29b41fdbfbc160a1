r"""Chat formatting with a grammar round trip.

A turn is rendered as ``### Role: `` text ``</turn>`` and a line end. The
grammar has a deterministic parser. Each turn is rendered plainly, reparsed
and compared with its source; while they differ, more of its content is
escaped: first the control strings, then backslashes too. The last level always
reads back: after it, each backslash in the output starts a pair of its own.

Turns parse one by one, so a conversation of any length needs the memory of one
turn. Digests stream over the turns of a conversation in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
ROLES = {name: role for role, name in NAMES.items()}
_CONTROL = re.compile(r"</turn>|### (?:User|Assistant|System|=)")
_TURN = re.compile(
    r"### (?P<role>User|Assistant|System|=(?:[^\\:]|\\.)*+): "
    r"(?P<text>(?:[^\\<#]++|\\.|<(?!/turn>)|#(?!## (?:User|Assistant|System|=)))*+)</turn>\n",
    re.DOTALL,
)
_PAIR = re.compile(r"\\([\\#<:])")
FORMAT_SCHEMA = "conv_id long, turn long, role string, text string, formatted string, level int, loss_start long, loss_end long"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str, level: int) -> str:
    """0: as it is; 1: control strings; 2: backslashes and control strings."""
    if level > 1:
        text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: "\\" + m[0], text) if level else text


def unescape(text: str) -> str:
    return _PAIR.sub(r"\1", text)


def _header(role: str) -> str:
    return NAMES.get(role) or "=" + re.sub(r"([\\#<:])", r"\\\1", role)


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """(role, text) of each turn, or None where the text isn't of the grammar."""
    found, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            return None
        found.append((ROLES[m["role"]] if m["role"] in ROLES else unescape(m["role"][1:]), unescape(m["text"])))
        at = m.end()
    return found


class Reader:
    """Parses a conversation's output as it comes; the same turns as ``parse`` of all of it."""

    def __init__(self):
        self.rest = ""

    def feed(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn that is complete now."""
        self.rest += formatted
        found, at = [], 0
        while m := _TURN.match(self.rest, at):
            found.append((ROLES[m["role"]] if m["role"] in ROLES else unescape(m["role"][1:]), unescape(m["text"])))
            at = m.end()
        self.rest = self.rest[at:]
        return found

    def close(self) -> None:
        if self.rest:
            raise ValueError("a conversation doesn't read back")


def render(role: str, text: str) -> tuple[str, int, int, int]:
    """(output, escape level, start and end of the text in it) of one turn."""
    head = f"### {_header(role)}: "
    for level in range(3):
        body = escape(text, level)
        out = f"{head}{body}</turn>\n"
        if parse(out) == [(role, text)]:
            return out, level, len(head), len(head) + len(body)
    raise ValueError("a turn doesn't read back")


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(8)]
        for conv_id, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            role, text = role or "", text or ""
            out, level, start, end = render(role, text)
            masked = role == "assistant"
            for column, value in zip(columns, (conv_id, turn, role, text, out, level, start if masked else None, end if masked else None), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in FORMAT_SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def format_turns(conversations: DataFrame) -> DataFrame:
    """Each turn's output, escape level, and the part of it under the loss mask.

    conversations: conv_id, turn, role, text; other columns are left out. A null
    text or role is empty. A conversation's output is that of its turns, in the
    order of turn (null first), role and text. Repeated rows are turns of their
    own. Loss bounds (code points) are null but for assistant turns. A turn of any
    length is taken whole; an empty table gives no rows.
    """
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return turns.mapInArrow(_formatted, FORMAT_SCHEMA)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, rows = None, None, []

    def closed() -> tuple:
        reader, n, turns, chars, loss, total = state
        reader.close()
        return key, n, turns.hexdigest(), chars, loss.hexdigest(), total

    def packed() -> pa.RecordBatch:
        names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for conv_id, out in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or conv_id != key:
                if state is not None:
                    rows.append(closed())
                key, state = conv_id, [Reader(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in state[0].feed(out):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    state[3] += len(text)
                    state[4].update(text.encode())
            state[5] += len(out)
        yield packed()
        rows = []
    if state is not None:
        rows.append(closed())
    yield packed()


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its whole output: turns, and the assistant's texts under the loss mask.

    Rows of a conversation go to one task, sorted, and stream through running
    digests, so a conversation of any size needs the memory of one batch.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "formatted").mapInArrow(_digested, DIGEST_SCHEMA)
